"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features of a text are rates over its words: how much of it is lexicon words (a short list of insults, and words and
word beginnings learned from labelled texts), how near those stand to words of address, capitals, exclamation and
other marks, and signs of obfuscation (digits or marks inside words, drawn-out letters). They are computed in numpy
over Arrow batches, a batch of documents at a time, and no document is cut.

Learning is bounded: of the labelled rows that ``learns`` admits, at most FIT_ROWS, those with the smallest hash of
their doc_id, then of their text, so the same rows each time and no more of them, however many rows a doc_id stands on.
Their texts stay on the executors, which send word counts and features.
The rows are dealt by hash into three folds, so that no part learns from what another has memorised: a row's features
come from a lexicon of the other two folds, trees are fitted on two folds and calibrated on the third, and texts are
scored with the lexicon of all three. Nothing in this depends on how many rows there are.

Cases: a null or empty text has all features 0 and a score like any other; a label is used once per doc_id (the highest,
if it repeats; null labels and labels of a null doc_id not at all), rows equal in doc_id and text are learned from once;
without any positive or negative label the score is the share of positives (0 without labels); an empty table gives an
empty result; other columns are left alone, and where one has the name of the score, the score gets underscores after
its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.common import bounded_batches, documents, free, saved, small
from pricewright.llm.textkernel import BLANK, NOT_LETTER, split_words, text_bytes

#: Labelled rows that are learned from, at most.
FIT_ROWS = 24_000
FOLDS = 3
#: Toxic texts, at least, that a lexicon word stands in, and the log odds that it has, at least.
SEEN, ODDS = 3, 2.0
THRESHOLD = 0.7
#: Insults to start from, and words of address in the corpus' languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting dumb jerk fool imbecile bastard crap damn shut hate ugly filthy vermin"
ADDRESS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros"
#: Beginnings of words, in bytes, that the lexicon is learned over, and None for whole words.
PREFIXES = (None, 4, 5, 6)
NEAR = 5
FEATURES = ("words", "insults", "insults_near", "lexicon", "lexicon_max", "lexicon_hits", *(f"prefix{p}" for p in PREFIXES[1:]), "prefix_max", "address", "lexicon_near", "capitals", "exclaims", "marks", "digits_inside", "marks_inside", "drawn_out", "beyond_ascii", "word_length")

_LETTER = ~NOT_LETTER
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalnum() and not BLANK[b] for b in range(256)])


def word_hashes(words: str) -> np.ndarray:
    """The sorted hashes of a list's words."""
    return np.unique(split_words(pa.array([words]), lower=True, between=NOT_LETTER).hashes())


@dataclass
class Lexicon:
    """For whole words and for word beginnings: sorted hashes and their log odds of standing in a toxic text."""

    hashes: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64) for _ in PREFIXES])
    odds: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0) for _ in PREFIXES])

    def weigh(self, level: int, h: np.ndarray) -> np.ndarray:
        table, odds = self.hashes[level], self.odds[level]
        if not len(table):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[at] == h, odds[at], 0.0)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    words = split_words(texts, lower=True, between=NOT_LETTER)
    of, count = words.text_of(), np.maximum(words.counts(), 1)
    size = np.maximum(np.diff(offsets), 1)
    total = lambda x: np.bincount(of, x, n) if len(of) else np.zeros(n)

    def highest(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, of, x)
        return out

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[offsets]).astype(float)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words of x with a word of y within NEAR words in the same text."""
        if not len(x):
            return np.zeros(n)
        seen = np.concatenate([[0], np.cumsum(y)])
        i = np.flatnonzero(x)
        a, b = np.maximum(i - NEAR, words.first[:-1][of[i]]), np.minimum(i + NEAR + 1, words.first[1:][of[i]])
        return np.bincount(of[i], (seen[b] - seen[a] > 0).astype(float), n)

    whole = words.hashes()
    insult, address = np.isin(whole, word_hashes(INSULTS)), np.isin(whole, word_hashes(ADDRESS))
    known = lexicon.weigh(0, whole)
    begins = [lexicon.weigh(i, words.hashes(p)) for i, p in enumerate(PREFIXES) if p is not None]
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)  # bytes of a text; a neighbour may be another text's
    full = np.diff(offsets) > 0
    first[offsets[:-1][full]] = last[offsets[1:][full] - 1] = True
    letter = _LETTER[data]
    before, after = np.roll(letter, 1) & ~first, np.roll(letter, -1) & ~last
    between = lambda mask: mask & before & after
    same = (data == np.roll(data, 1)) & ~first
    drawn = same & np.roll(same, 1) & ~first & letter
    columns = {
        "words": np.log1p(words.counts()), "insults": total(insult) / count, "insults_near": near(insult, address) / count,
        "lexicon": total(known) / count, "lexicon_max": highest(known), "lexicon_hits": np.log1p(total(known > 0)),
        **{f"prefix{p}": np.log1p(total(b > 0)) for p, b in zip(PREFIXES[1:], begins, strict=True)}, "prefix_max": np.max([highest(b) for b in begins], axis=0),
        "address": total(address) / count, "lexicon_near": near((known > 0) | insult, address) / count, "capitals": bytes_where(_UPPER[data]) / size, "exclaims": bytes_where(data == 33) / size,
        "marks": bytes_where(_MARK[data]) / size, "digits_inside": bytes_where(between(_DIGIT[data])) / size, "marks_inside": bytes_where(between(_MARK[data])) / size,
        "drawn_out": bytes_where(drawn) / size, "beyond_ascii": bytes_where(data > 127) / size, "word_length": total((words.ends - words.starts).astype(float)) / count,
    }
    return np.stack([columns[name] for name in FEATURES], axis=1) if n else np.zeros((0, len(FEATURES)))


class Trees:
    """Gradient boosting of depth-limited trees on the logistic loss, over quantile bins of the features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, leaf: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int]]] = []
        self.leaves: list[np.ndarray] = []
        self.bias = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        b, p = self._bin(x), np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(p / (1 - p)))
        score, wide = np.full(len(y), self.bias), self.bins + 1
        flat = b + np.arange(x.shape[1]) * wide
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    g, h = (np.bincount(flat[rows].ravel(), np.repeat(w[rows], x.shape[1]), x.shape[1] * wide).reshape(-1, wide).cumsum(1) for w in (grad, hess))
                    gain = g**2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    n = np.bincount(flat[rows].ravel(), minlength=x.shape[1] * wide).reshape(-1, wide).cumsum(1)
                    gain[(n < self.leaf) | (n[:, -1:] - n < self.leaf)] = 0
                    splits.append(divmod(int(gain.argmax()), wide) if len(rows) and gain.max() > 1e-9 else (0, wide))
                first = (1 << level) - 1
                f, cut = np.array(splits[first:]).T
                node = node * 2 + (b[np.arange(len(y)), f[node]] > cut[node])
            g, h = (np.bincount(node, w, 1 << self.depth) for w in (grad, hess))
            self.trees.append(splits)
            self.leaves.append(self.rate * g / (h + self.ridge))
            score = score + self.leaves[-1][node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not len(x) or not self.trees:
            return out
        b, rows = self._bin(x), np.arange(len(x))
        for splits, leaves in zip(self.trees, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                f, cut = np.array(splits[(1 << level) - 1 : (2 << level) - 1]).T
                node = node * 2 + (b[rows, f[node]] > cut[node])
            out += leaves[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y on score, by pooling adjacent violators: knots to interpolate between. Equal scores
    are one point, so that one odd label among many rows of a score does not become the value of that score."""
    points, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v, m in zip(points.tolist(), np.bincount(at, y, len(points)).tolist(), np.bincount(at, minlength=len(points)).tolist(), strict=True):
        blocks.append([v, m, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    knots = [(s, v / n) for v, n, lo, hi in blocks for s in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated scores; a thousandth of the uncalibrated one keeps the order within the steps."""
        p = 1 / (1 + np.exp(-self.trees.raw(features(texts, self.lexicon))))
        return p if self.knots is None else np.clip(0.999 * np.interp(p, *self.knots) + 0.001 * p, 0, 1)


def sample(docs: DataFrame, labels: DataFrame, learns: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows that ``learns`` (a condition on doc_id) admits: text, toxic, _fold. The doc_ids
    are cut first, so that few texts take part; then the rows, of which a doc_id may have any number."""
    admitted = labels.where("toxic is not null and doc_id is not null").where(learns).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = admitted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    found = docs.select("doc_id", "text").join(small(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), "_fold")
    place = [F.col("_k"), F.col("doc_id"), F.col("_h")]
    found = found.withColumns({"_k": F.xxhash64("doc_id"), "_h": F.xxhash64("text")})
    pairs = saved(found.groupBy("_k", "doc_id", "_h").agg(F.count(F.lit(1)).alias("n")), "pairs")
    beyond = pairs.orderBy(*place).offset(rows).limit(1).collect()
    for r in beyond:
        found = found.where(F.struct(*place) < F.struct(F.lit(r["_k"]).alias("_k"), F.lit(r["doc_id"]).alias("doc_id"), F.lit(r["_h"]).alias("_h")))
    if not pairs.where("n > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "_h"])
    return saved(found.select("text", "toxic", "_fold"), "labelled")


def _learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Words and beginnings far more frequent, by documents, in toxic texts: a lexicon without each fold, and one of
    all. Tasks send counts of what they met."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic, fold = split_words(batch.column(0), lower=True, between=NOT_LETTER), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for level, p in enumerate(PREFIXES):
                h, doc = words.hashes(p), words.text_of()
                by_doc = np.lexsort([h, doc])
                h, doc = h[by_doc], doc[by_doc]
                new = np.ones(len(h), bool)  # a word counts once a document
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                by_word = np.lexsort([fold[doc], h])
                h, doc = h[by_word], doc[by_word]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (fold[doc[1:]] != fold[doc[:-1]])
                at, n = np.cumsum(new) - 1, int(new.sum())
                columns = [np.full(n, level, np.int32), h[new].view(np.int64), fold[doc[new]].astype(np.int32), np.bincount(at, toxic[doc], n).astype(np.int64), np.bincount(at, 1 - toxic[doc], n).astype(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["level", "h", "fold", "bad", "good"])

    found = {r._fold: (r.bad, r.n) for r in rows.groupBy("_fold").agg(F.sum("toxic").alias("bad"), F.count("toxic").alias("n")).collect()}
    of = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counted = rows.select("text", "toxic", "_fold").mapInArrow(task, "level int, h long, fold int, bad long, good long").groupBy("level", "h").agg(*(of(c, k) for c in ("bad", "good") for k in range(FOLDS)))
    counted = saved(counted.where(" + ".join(f"bad{k}" for k in range(FOLDS)) + f" >= {SEEN}"), "counts")
    out = []
    for left_out in [*range(FOLDS), None]:
        used = [k for k in range(FOLDS) if k != left_out]
        n_bad, n = (sum(found.get(k, (0, 0))[i] for k in used) for i in (0, 1))
        bad, good = (sum((F.col(f"{c}{k}") for k in used[1:]), F.col(f"{c}{used[0]}")) for c in ("bad", "good"))
        odds = F.log((F.col("bad") + 0.25) / (n_bad + 1.0)) - F.log((F.col("good") + 0.25) / (n - n_bad + 1.0))
        seen = counted.select("level", "h", bad.alias("bad"), good.alias("good")).withColumn("odds", odds)
        top = seen.where((F.col("bad") >= SEEN) & (F.col("odds") >= ODDS)).collect()  # bounded by the words of FIT_ROWS texts
        made = Lexicon()
        for level in range(len(PREFIXES)):
            mine = sorted((np.int64(r.h).view(np.uint64), r.odds) for r in top if r.level == level)
            made.hashes[level], made.odds[level] = np.array([h for h, _ in mine], np.uint64), np.array([o for _, o in mine], float)
        out.append(made)
    return out


def _matrix(rows: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (by the lexicon without the row's fold), labels and folds of at most FIT_ROWS rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for k in np.unique(fold).tolist():
                at = np.flatnonzero(fold == k)
                x[at] = features(batch.column(0).take(pa.array(at)), lexicons[k])
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "fold"])

    got = rows.select("text", "toxic", "_fold").mapInArrow(task, "x array<double>, toxic int, fold int").toArrow()
    x = got.column(0).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y, fold = (got.column(i).combine_chunks().to_numpy() for i in (1, 2))
    order = np.lexsort([*x.T, y, fold])  # the same order in every run
    return x[order], y[order], fold[order]


def train(docs: DataFrame, labels: DataFrame, learns: str = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1", rows: int = FIT_ROWS) -> Model:
    bounded_batches(docs.sparkSession)
    fitted = sample(docs, labels, learns, rows)
    lexicons = _learn_lexicons(fitted)
    x, y, fold = _matrix(fitted, lexicons)
    a, b = fold < FOLDS - 1, fold == FOLDS - 1
    trees = Trees()
    if len(set(y[a])) == 2:
        trees.fit(x[a], y[a].astype(float))
        if len(set(y[b])) < 2:
            return Model(lexicons[-1], trees, None)
        p = 1 / (1 + np.exp(-trees.raw(x[b])))
        knots = isotonic(p, y[b].astype(float))
        if abs(np.interp(p, *knots).mean() - y[b].mean()) > 1e-6:
            raise RuntimeError("the calibrated scores do not average to the labels that they were fitted on")
        return Model(lexicons[-1], trees, knots)
    share = float(y.mean()) if len(y) else 0.0
    trees.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return Model(lexicons[-1], trees, None)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text, as the last column."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS texts
    at, column = docs.columns.index("text"), free(docs.columns, column)[0]
    names = [*docs.columns, column]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(sent.value.score(batch.column(at)), pa.float64())], names=names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots are no names to mapInArrow
    return plain.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from labelled rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

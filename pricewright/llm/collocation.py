"""Phrase collocation mining by hashed passes: bucket counts prune the next length before it is counted exactly.

Pass k reads all texts once. It counts the phrases of k words exactly and, beside that, throws the phrases of k + 1
words into a fixed number of buckets, in an array that a task keeps. The buckets that reach ``least`` make a bitmap;
another bitmap holds the hashes of the frequent phrases of k words. Both are of 2 ** BITS bits whatever the corpus, and
are what is broadcast: in the next pass, a phrase is counted only if its bucket and both its parts of k words are marked.
A false mark costs a row in the exact count and changes no result.

Words are cut and numbered in numpy over bounded chunks of text; a chunk's numbers are checked by the words' bytes, so
equal hashes of different words never meet in a count. The counts of a chunk's phrases are summed by Spark under the
phrase itself, so a phrase of a third of all rows is one row for each chunk by the time it is shuffled.

Cases: null and empty texts hold no words; a null lang is ``und``, and joins a lang of that name; repeated rows count
each; an empty table or one without frequent phrases gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.common import bounded_batches, chunks, discard, documents, is_empty, saved
from pricewright.llm.textkernel import Words, grams, mix, ranges, split_words

LEAST, LONGEST, TOP = 10, 3, 2000
#: Percent of a phrase's occurrences within a longer one from which it is dropped.
INSIDE = 50
#: Buckets are 2 ** BITS; a task sends their counts in runs of SPAN buckets.
BITS, SPAN = 26, 1 << 13
#: Bytes of text that are numbered at once, and of counted phrases that a task puts together before it sends them on.
TEXT, HELD = 2 << 20, 12 << 20
#: Bytes that end a piece, and those between words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[32, 9]] = True
_ROWS = "lang string, phrase string, n long, span int, counts binary"
_NAMES = ["lang", "phrase", "n", "span", "counts"]


def _bytes_of(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = words.ends[at] - words.starts[at]
    return words.data[ranges(words.starts[at], lengths)], lengths


def numbered(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words only, and how many there are."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    mine, lengths = _bytes_of(words, np.arange(len(number)))
    theirs, expected = _bytes_of(words, first[number])
    if np.array_equal(lengths, expected) and np.array_equal(mine, theirs):
        return number, len(first)
    known: dict[bytes, int] = {}
    raw = words.data.tobytes()
    number = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)), np.int64, len(number))
    return number, len(known)


class Phrases:
    """The phrases of a chunk: by length, where they start, their hashes and their numbers."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.words = split_words(texts, lower=True, between=_BETWEEN)
        of = self.words.text_of()
        self.langs = langs.dictionary_encode()
        lang = self.langs.indices.to_numpy()[of] if len(of) else np.zeros(0, np.int64)
        self.lang, self._hashes = lang, self.words.hashes()
        names = split_words(pa.array([x or "_" for x in self.langs.dictionary.to_pylist()], pa.string()), between=np.zeros(256, bool)).hashes()
        self._salt = names[lang] if len(of) else np.zeros(0, np.uint64)
        ends = np.concatenate([[0], np.cumsum(_ENDS[self.words.data])])
        self._piece = ends[self.words.starts] + of  # grows with each end and each text
        self._number, self._many = numbered(self.words, self._hashes)

    def starts(self, k: int) -> np.ndarray:
        """The first words of all phrases of ``k`` words."""
        n = len(self._piece) - k + 1
        return np.flatnonzero(self._piece[k - 1 :] == self._piece[: max(n, 0)]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of ``k`` words at ``at`` with their langs."""
        return mix(grams(self._hashes, k)[at] ^ self._salt[at]) if len(at) else np.zeros(0, np.uint64)

    def counts(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of one of each distinct phrase among those at ``at``, and how often each occurs."""
        number, bound = self.lang[at].astype(np.int64) * self._many + self._number[at], len(self.langs.dictionary) * max(self._many, 1)
        for j in range(1, k):
            if bound * self._many >= 1 << 63:
                known, number = np.unique(number, return_inverse=True)
                bound = len(known)
            number, bound = number * self._many + self._number[at + j], bound * self._many
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        return at[first], n

    def texts(self, k: int, at: np.ndarray) -> pa.Array:
        """The phrases as text, one blank between words."""
        data, blank = np.append(self.words.data, np.uint8(32)), len(self.words.data)
        starts, lengths = np.full((len(at), 2 * k - 1), blank), np.ones((len(at), 2 * k - 1), np.int64)
        for j in range(k):
            starts[:, 2 * j] = self.words.starts[at + j]
            lengths[:, 2 * j] = self.words.ends[at + j] - self.words.starts[at + j]
        offsets = np.concatenate([[0], np.cumsum(lengths.sum(1))]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts.ravel(), lengths.ravel())]))

    def langs_of(self, at: np.ndarray) -> pa.Array:
        return self.langs.dictionary.take(pa.array(self.lang[at]))


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32)  # which sort faster than long ones


class Bitmap:
    """Marked buckets, of a fixed size."""

    def __init__(self, marks: bytes):
        self.marks = np.frombuffer(marks, np.uint8)
        self.bits = len(marks).bit_length() + 2

    def has(self, hashes: np.ndarray) -> np.ndarray:
        b = buckets(hashes, self.bits)
        return (self.marks[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


class Buckets:
    """How often each bucket was met, no more than ``least`` times counted, in a byte for each where that suffices."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least = bits, least
        self.counts = np.zeros(1 << bits, kind(least))

    def add(self, hashes: np.ndarray) -> None:
        b, n = np.unique(buckets(hashes, self.bits), return_counts=True)
        self.counts[b] = np.minimum(self.counts[b] + n, self.least)

    def spans(self) -> Iterator[pa.RecordBatch]:
        """The counts in runs of SPAN that hold any."""
        counts = self.counts.reshape(-1, min(SPAN, len(self.counts)))
        used = np.flatnonzero(counts.any(1))
        for i in range(0, len(used), 256):
            some = used[i : i + 256]
            none = pa.nulls(len(some))
            yield pa.record_batch([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(some, pa.int32()), pa.array([counts[s].tobytes() for s in some], pa.binary())], names=_NAMES)


def kind(least: int) -> str:
    """The type of a bucket's count."""
    return "u1" if least < 256 else "<u4"


def _put_together(rows: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Counted phrases (lang, phrase, n) of chunks, equal ones added up as far as ``held`` bytes of them reach."""

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches(max_chunksize=1 << 16):
            none = pa.nulls(batch.num_rows)
            yield pa.record_batch([*batch.columns, none.cast(pa.int32()), none.cast(pa.binary())], names=_NAMES)

    some: list[pa.Table] = []
    for batch in rows:
        some.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in some) > held:
            table = pa.concat_tables(some).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(_NAMES[:3])
            some = [table]
            if table.nbytes * 2 > held:
                yield from out(table)
                some = []
    if some:
        yield from out(pa.concat_tables(some).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(_NAMES[:3]))


def bitmap(spans: DataFrame, least: int, bits: int = BITS) -> Bitmap:
    """The buckets whose counts, over all tasks, reach ``least``. Spans are summed where they are dealt to, one after
    another; 2 ** bits bits come back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = np.frombuffer(c, kind(least))
                total[s] = np.minimum(total[s].astype(np.int64) + mine, least).astype(mine.dtype) if s in total else mine
        marks = [np.packbits(t >= least, bitorder="little").tobytes() for t in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(marks, pa.binary())], names=["span", "marks"])

    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, min(SPAN, 1 << bits) // 8)
    n = min(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(out))
    for r in spans.select("span", "counts").repartition(n, "span").mapInArrow(task, "span int, marks binary").collect():
        out[r.span] = np.frombuffer(r.marks, np.uint8)
    return Bitmap(out.tobytes())


def _pass(texts: DataFrame, k: int, longest: int, least: int, marked: tuple[Bitmap, Bitmap] | None, bits: int = BITS) -> DataFrame:
    """Rows (lang, phrase, n) of the phrases of ``k`` words that ``marked`` (buckets, frequent phrases of k - 1 words)
    admits, and rows (span, counts) of the buckets of those of k + 1 words whose parts are admitted."""
    sent = texts.sparkSession.sparkContext.broadcast(marked)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = Buckets(bits, least) if k < longest else None

        def counted() -> Iterator[pa.RecordBatch]:
            for table in chunks(batches, TEXT):
                found = Phrases(table.column(0).combine_chunks(), table.column(1).combine_chunks())
                at = found.starts(k)
                if sent.value is not None:
                    bucket, parts = sent.value
                    frequent = np.zeros(len(found.lang) + 1, bool)
                    inner = found.starts(k - 1)
                    frequent[inner] = parts.has(found.hashes(k - 1, inner))
                    at = at[frequent[at] & frequent[at + 1]]
                    at = at[bucket.has(found.hashes(k, at))]
                if filled is not None:
                    open_ = np.zeros(len(found.lang) + 1, bool)
                    open_[at] = True
                    longer = found.starts(k + 1)
                    filled.add(found.hashes(k + 1, longer[open_[longer] & open_[longer + 1]]))
                if len(at):
                    first, n = found.counts(k, at)
                    yield pa.record_batch([found.langs_of(first).cast(pa.string()), found.texts(k, first), pa.array(n, pa.int64())], names=_NAMES[:3])

        yield from _put_together(counted())
        if filled is not None:
            yield from filled.spans()

    return texts.mapInArrow(task, _ROWS)


def _marks(frequent: DataFrame, k: int, bits: int = BITS) -> Bitmap:
    """A bitmap of the hashes of frequent phrases."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = Buckets(bits, 1)
        for batch in batches:
            found = Phrases(batch.column(0), batch.column(1))
            filled.add(found.hashes(k, found.starts(k)))
        yield from filled.spans()

    return bitmap(frequent.select("lang", "phrase").mapInArrow(task, _ROWS), 1, bits)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """For each length, the phrases (lang, phrase, a) that occur ``least`` times; and the words of each lang (lang, n)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found: list[DataFrame] = []
    marked, words = None, None
    for k in range(1, longest + 1):
        raw = saved(_pass(texts, k, longest, least, marked, bits), f"phrases{k}")
        counted = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if words is None:
            words = saved(raw.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        found.append(saved(counted.where(F.col("a") >= least), f"frequent{k}"))
        if k < longest:
            marked = bitmap(raw.where("span is not null"), least, bits), _marks(found[-1], k, bits)
        discard(raw)
    return found, words


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 * a * a / (l * r)) in decimals of 38 digits: exact for counts of up to 16 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def _top(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang by score, a and phrase, with their rank: of parts of a lang first, so that no
    task ranks more than ``top`` rows for each of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    some = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", first).where(F.col("rank") <= top).drop("_part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``top`` phrases of 2 to ``longest`` words."""
    found, words = frequent_phrases(docs, longest, least, bits)
    kept = []
    for k in range(2, longest + 1):
        rows = found[k - 1]
        if k < longest and not is_empty(found[k]):
            # What lies in a phrase longer by two lies in one longer by one, which is as frequent at least.
            longer, cut = found[k], F.substring_index("phrase", " ", k)
            tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
            held = longer.select("lang", F.explode(F.array(cut, tail)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_in"))
            rows = rows.join(held, ["lang", "phrase"], "left").where(F.coalesce(F.col("_in") * 100 < F.col("a") * inside, F.lit(True))).drop("_in")
        cuts = []
        for j in range(1, k):
            first, rest = F.substring_index("phrase", " ", j), F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {j})) + 2)")
            part = lambda i, name: found[i - 1].select("lang", F.col("phrase").alias(f"_{name}"), F.col("a").alias(name))
            rows = rows.withColumns({f"_l{j}": first, f"_r{j}": rest}).join(part(j, f"l{j}"), ["lang", f"_l{j}"]).join(part(k - j, f"r{j}"), ["lang", f"_r{j}"])
            cuts.append(F.struct(_score(F.col("a"), F.col(f"l{j}"), F.col(f"r{j}")).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
        best = F.array_min(F.array(*cuts))
        kept.append(rows.withColumn("_best", best).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    return _top(every, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mines all documents: phrases of 2 and 3 words that occur ten times, the first 2000 of each lang."""
    return collocations(documents(spark, sf_dir))

"""Substring dedup by seed and extend.

Seeds: each document's runs of SEED words are hashed, and of every ``window - SEED + 1`` consecutive ones the
smallest hash is kept (winnowing), so any ``window`` words hold a seed that depends on those words alone. Documents
are joined on seeds: a seed that only one document holds is dropped, which leaves few.

Extension: a shared seed is extended to both sides into the windows of ``window`` words that it was kept for, and
these are joined by (seed, window hash), 128 bits; a window whose first holder has a smaller doc_id is a repeat. So
the words around a seed are compared by hash, for all holders at once: growing each pair of holders word by word would
list the pairs of a hot passage, and growing against a seed's first holder alone would miss windows of other holders.
Overlapping and adjoining repeats of a document grow together into its maximal repeated runs, none shorter than
``window`` words. Both joins are on keys that are first reduced to their smallest doc_id by a combining aggregate,
so nothing lists the holders of a hot passage, and no pairs of documents are made.

Texts equal to that of a smaller doc_id repeat it as a whole and are not seeded.

Cases: null texts have no words; documents of fewer than ``window`` words keep all of them; a null doc_id neither
lends nor loses words; rows with one doc_id are told apart by their text's hash and do not take words from each other; an
empty table gives an empty result; other columns are left alone, and where one has the name of a column that is added,
that one gets underscores after its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.common import bounded_batches, columns, discard, documents, free, saved, small, squeezed
from pricewright.llm.textkernel import Words, grams, ranges, split_words, unsqueeze

WINDOW, SEED = 13, 4


def _window_seeds(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: the index of its first word, its own hash, and its seed's hash."""
    h = words.hashes()
    count = np.maximum(words.counts() - window + 1, 0)
    at = ranges(words.first[:-1], count)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = grams(h, seed)
    least = g
    width, reach = 1, window - seed + 1
    while width * 2 <= reach:  # minima of 1, 2, 4, ... consecutive seeds
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return at, grams(h, window)[at], least[at]


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, _t (the text's hash where its doc_id holds several, else 0), seeds: the distinct winnowed seeds of each document of at least ``window`` words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(2))
            at, _, kept = _window_seeds(words, window, seed)
            change = np.ones(len(at), bool)
            doc = words.text_of()[at] if len(at) else at
            change[1:] = (kept[1:] != kept[:-1]) | (doc[1:] != doc[:-1])
            doc, kept = doc[change], kept[change]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(kept.view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["doc_id", "_t", "seeds"])

    return docs.select("doc_id", "_t", "text").mapInArrow(task, "doc_id long, _t long, seeds array<long>").where("size(seeds) > 0")


def windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, _t, at, seed, hash for every window whose seed is among the document's ``shared`` ones; ``_z`` is its text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(unsqueeze(batch.column(2)))
            at, own, kept = _window_seeds(words, window, seed)
            if not len(at):
                continue
            doc = words.text_of()[at]
            shared = batch.column(3)
            lists, bounds = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy(zero_copy_only=False))])
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hit = np.zeros(len(at), bool)
            for i in range(batch.num_rows):
                a, b = edges[i], edges[i + 1]
                hit[a:b] = np.isin(kept[a:b], lists[bounds[i] : bounds[i + 1]])
            doc, at, own, kept = doc[hit], at[hit], own[hit], kept[hit]
            yield pa.record_batch([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(kept.view(np.int64)), pa.array(own.view(np.int64))], names=["doc_id", "_t", "at", "seed", "hash"])

    return docs.select("doc_id", "_t", "_z", "shared").mapInArrow(task, "doc_id long, _t long, at int, seed long, hash long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, _h, _t): rows (doc_id, _t, at) of windows that a smaller doc_id holds, and rows
    (_h, _first) of texts that several documents hold, with the smallest doc_id."""
    known = docs.where("doc_id is not null")
    texts = known.groupBy("_h", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_m")).agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copied = saved(texts.groupBy("_h").agg(F.min("_first").alias("_first"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_k")).where("_k = 1 and _n > 1").drop("_k", "_n"), "copied")
    fresh = known.join(copied, "_h", "left").where("_first is null or doc_id = _first").select("doc_id", "_t", "text")
    held = saved(seeds(fresh, window, seed), "seeds")
    each = held.select("doc_id", "_t", F.explode("seeds").alias("seed"))
    shared = saved(each.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed"), "shared")
    mine = saved(each.join(shared, "seed").groupBy("doc_id", "_t").agg(F.collect_set("seed").alias("shared")), "mine")
    found = saved(windows(squeezed(fresh).join(mine, ["doc_id", "_t"]), window, seed), "windows")
    discard(held, shared, mine)
    first = saved(found.groupBy("seed", "hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed", "hash", "a"), "first")
    starts = found.join(first, ["seed", "hash"]).where("doc_id > a").groupBy("doc_id", "_t").agg(F.collect_set("at").alias("_at"))
    starts = saved(starts, "starts")
    discard(found, first)
    return starts, copied


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_words, n_removed, repeats (its maximal repeated runs, as start and
    end words) and kept_text, the words left over joined by a blank."""
    spark = docs.sparkSession
    bounded_batches(spark)
    inner = [c if c in ("doc_id", "text") else f"_x{i}" for i, c in enumerate(docs.columns)]  # no name of the input's but these two
    hashed = docs.select(*(c.alias(n) for c, n in zip(columns(docs), inner, strict=True))).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    several = saved(hashed.groupBy("doc_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("_d"), F.lit(True).alias("_s")), "several")
    keyed = hashed.join(small(several), F.col("doc_id") == F.col("_d"), "left").withColumn("_t", F.when(F.col("_s"), F.col("_h")).otherwise(F.lit(0).cast("long"))).drop("_d", "_s")
    starts, copied = repeated_windows(keyed.select("doc_id", "_h", "_t", "text"), window, seed)
    starts, copied = starts.withColumnsRenamed({"doc_id": "_doc", "_t": "_u"}), copied.withColumnsRenamed({"_h": "_c"})
    rows = squeezed(keyed).join(starts, (F.col("doc_id") == F.col("_doc")) & (F.col("_t") == F.col("_u")), "left").drop("_doc", "_u")
    rows = rows.join(small(copied), F.col("_h") == F.col("_c"), "left").withColumn("_whole", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_t", "_h", "_c", "_first")
    added, at_ = free(docs.columns, "n_words", "n_removed", "repeats", "kept_text"), {c: i for i, c in enumerate(rows.columns)}
    names, run = [*docs.columns, *added], T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(added, (T.LongType(), T.LongType(), T.ArrayType(run), T.StringType()), strict=True))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = unsqueeze(batch.column(at_["_z"]))
            words = split_words(text)
            raw, at, whole = words.data.tobytes(), batch.column(at_["_at"]).to_pylist(), batch.column(at_["_whole"]).to_pylist()
            n_removed, runs, kept = [], [], []
            for i, n in enumerate(words.counts().tolist()):
                a = words.first[i]
                s, e = words.starts[a : a + n], words.ends[a : a + n]
                if whole[i] and n >= window:
                    gone = np.ones(n, bool)
                elif at[i]:
                    gone = _covered(np.array(at[i]), n, window)
                else:
                    gone = np.zeros(n, bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                n_removed.append(int(gone.sum()))
                runs.append([{"start": int(x), "end": int(y)} for x, y in edge])
                kept.append(b" ".join([raw[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)]).decode())
            yield pa.record_batch([*(text if c == "text" else batch.column(at_[c]) for c in inner), pa.array(words.counts().astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())], names=names)

    return rows.mapInArrow(task, schema)


def op4_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from all documents the words of 13-word windows that a document with a smaller doc_id holds."""
    done = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))



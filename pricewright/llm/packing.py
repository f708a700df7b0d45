"""Best-fit packing by exact-complement hashing.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers, so it is made on the
driver from that histogram, whatever the corpus. Lengths are taken from the longest down; for the gap that is left
in a sequence, the index of single, pair and triple sums of the lengths still available names a combination that
fills it exactly, and as many sequences as the counts allow are made at once. Where no combination fits, the longest
available piece that fits goes in and the rest of the gap is looked up again. The plan is a table of slots:
pieces of a length, counted from ``first``, fill places of consecutive sequences. Pieces get their ranks within a
length from per-(length, group of salts) counts, so that a length held by a third of all pieces is ranked by many tasks.

Cases: null texts are empty and hold only the end id; texts of over ``capacity`` ids are cut into full pieces and
a rest; rows with equal ids, null ones too, are packed each; an empty table gives an empty result; of the documents, only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricewright.llm.common import bounded_batches, documents, saved
from pricewright.llm.tokens import default_path, encoder

CAPACITY, END_ID = 4096, 1
#: Pieces of one length ranked by one task, and salts at most.
RANKED, SALTS = 500, 1 << 20


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt (and ids, little-endian 32-bit, if asked) of every document's pieces."""
    bounded_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, salt = encoder(tokenizer), 0
        for batch in batches:
            ids, offsets = enc.encode_ended(batch.column(1), end_id)
            ids = ids.astype("<u4")
            cuts = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(batch.num_rows), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            a = offsets[row] + start
            b = np.minimum(a + capacity, offsets[row + 1])
            raw = [ids[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(b - a), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array((salt + np.arange(len(row))) % SALTS, pa.int32())]
            salt += len(row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            yield pa.record_batch(columns + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids binary" * with_ids)


class _Stock:
    """How many pieces of each length are left, and which sums of one, two or three lengths fill a gap."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64)

    def pair(self, gap: int, free: np.ndarray) -> tuple[int, int] | None:
        """Two available lengths with sum ``gap``, the longest first part there is."""
        half = gap // 2
        small = np.arange(1, half + 1)
        hit = (free[small] > 0) & (free[gap - small] > 0)
        if gap % 2 == 0 and half and free[half] < 2:
            hit[half - 1] = False
        at = hit.argmax() if hit.any() else -1
        return None if at < 0 else (gap - int(small[at]), int(small[at]))

    def fill(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill ``gap`` exactly."""
        free = self.n[: gap + 1].copy()
        for k, u in used.items():
            if k <= gap:
                free[k] -= u
        free[0] = 0
        if free[gap] > 0:
            return (gap,)
        if found := self.pair(gap, free):
            return found
        for a in np.flatnonzero(free[: gap - 1] > 0)[::-1].tolist():
            if a * 3 < gap:
                break
            free[a] -= 1
            found = self.pair(gap - a, free)
            free[a] += 1
            if found:
                return (a, *found)
        return None

    def best(self, gap: int, used: dict[int, int]) -> int:
        """The longest available length of at most ``gap``, or 0."""
        for k in np.flatnonzero(self.n[: gap + 1] > 0)[::-1].tolist():
            if self.n[k] > used.get(k, 0):
                return k
        return 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Slots (length, first, each, runs, sequence, place): the pieces of ``length`` with ranks from ``first`` fill,
    ``each`` at a time, the places from ``place`` of ``runs`` sequences from ``sequence`` on."""
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    stock, given, slots, sequence = _Stock(counts), np.zeros(capacity + 1, np.int64), [], 0
    for top in range(capacity, 0, -1):
        while stock.n[top] > 0:
            used, gap = {top: 1}, capacity - top
            while gap:
                parts = stock.fill(gap, used) or ((k,) if (k := stock.best(gap, used)) else ())
                if not parts:
                    break
                for k in parts:
                    used[k] = used.get(k, 0) + 1
                    gap -= k
            runs = min(int(stock.n[k]) // u for k, u in used.items())
            place = 0
            for k, u in used.items():
                slots.append((k, int(given[k]), u, runs, sequence, place))
                given[k] += runs * u
                stock.n[k] -= runs * u
                place += k * u
            sequence += runs
    return pd.DataFrame(slots, columns=["length", "first", "each", "runs", "sequence", "place"]).astype("int64")


def ranked(rows: DataFrame, key: str, counts: dict[int, int]) -> DataFrame:
    """``rows`` (a written table, read twice) with _rank, from 0, among those of equal ``key``, and without salt. ``counts``
    has the rows of each key, at most ``capacity`` numbers; a key of many rows is ranked in as many groups of salts."""
    kind = rows.schema[key].dataType.simpleString()
    ways = rows.sparkSession.createDataFrame([(k, int(min(SALTS, -(-v // RANKED)))) for k, v in counts.items()], f"{key} {kind}, _ways int")
    grouped = rows.join(F.broadcast(ways), key).withColumn("_group", (F.col("salt") % F.col("_ways")).cast("int")).drop("_ways")
    sizes = grouped.groupBy(key, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    found = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_group").orderBy("salt")) - 1).join(bases, [key, "_group"])
    return found.withColumn("_rank", (F.col("_rank") + F.col("_base")).cast("long")).drop("_group", "_base", "salt")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (columns length and salt among others; a written table, read twice) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    ranks = ranked(cut, "length", histogram)
    table = spark.sparkContext.broadcast({k: g.drop(columns="length").to_numpy() for k, g in slots.groupby("length")})
    fields = [f for f in ranks.schema.fields if f.name != "_rank"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_rank", "length"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at, slot = np.flatnonzero(length == k), table.value[k]
                s = slot[np.searchsorted(slot[:, 0], rank[at], "right") - 1]
                on = rank[at] - s[:, 0]
                sequence[at] = s[:, 3] + on // s[:, 1]
                offset[at] = s[:, 4] + on % s[:, 1] * k
            kept = batch.drop_columns(["_rank"])
            yield pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranks.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut, encode and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, capacity), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 ids."""
    return packed(documents(spark, sf_dir))

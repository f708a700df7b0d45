"""Sharding by histogram sort.

The order is by (hash of the text, hash of the doc_id, a number among equal rows): equal texts stand together, and a
group of them too large for one shard can still be cut. Splitters are found without sorting: tasks count the exact bytes
below a sorted list of candidate keys, the counts are summed, and each splitter's interval shrinks to the two
candidates around its target, which are then probed more finely, and at its few last rows' own keys, until the bytes
below are within the tolerance or a single row is left between. Then both ends of the group of equal texts that a cut
falls into are probed, and the cut moves to the nearer one if the shares that this makes stay within GROUP_TOLERANCE;
larger groups are cut. Only then are the documents exchanged, once, whole, by ranges of (shard, key), as many as Spark
has partitions for, and sorted there; a running sum of the rows of each range's part of a shard turns places into slots.

Cases: null texts hold no bytes (and cost the 16 of a row) and count as equal to empty ones; rows that repeat, null doc_ids
included, are told apart by a number that is written down with them before it is used, so any of them may stand first,
but how many each shard holds is the same in every run; an empty table gives an empty result; other columns are left alone, and where one has the name
of a column that is added, that one gets underscores after its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.common import columns, documents, free, saved, small

SHARDS, ROW_BYTES, TOLERANCE, GROUP_TOLERANCE, PROBES = 40, 16, 0.002, 0.02, 64
_KEY = ("h", "d", "r")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int, int]


def _below(keys: pd.DataFrame, probes: list[Key]) -> np.ndarray:
    """For each row, how many of the sorted probes are at most its key."""
    p = np.array(probes, np.int64)
    h, d, r = (keys[c].to_numpy() for c in _KEY)
    lo, hi = np.searchsorted(p[:, 0], h, "left"), np.searchsorted(p[:, 0], h, "right")
    at = hi.copy()
    for i in np.flatnonzero(lo < hi):  # a probe has this hash: few rows
        at[i] = lo[i] + sum((x[1], x[2]) <= (d[i], r[i]) for x in p[lo[i] : hi[i]].tolist())
    return at


def _count(rows: DataFrame, probes: list[Key]) -> list[tuple[int, int]]:
    """Exact bytes and rows below each probe; tasks send one row per probe interval that they met."""
    sent = rows.sparkSession.sparkContext.broadcast(probes)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(sent.value) + 1, 2), np.int64)
        for f in frames:
            at = _below(f, sent.value)
            np.add.at(total[:, 0], at, f["size"].to_numpy())
            np.add.at(total[:, 1], at, 1)
        some = np.flatnonzero(total[:, 1])
        yield pd.DataFrame({"slot": some, "size": total[some, 0], "n": total[some, 1]})

    found = rows.select(*_KEY, "size").mapInPandas(task, "slot long, size long, n long").groupBy("slot").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    total = np.zeros((len(probes) + 1, 2), np.int64)
    for r in found:
        total[r.slot] = r["size"], r["n"]
    return [(int(x), int(y)) for x, y in np.cumsum(total, axis=0)[:-1]]


def _between(lo: Key, hi: Key, n: int) -> list[Key]:
    """Up to ``n`` keys after lo and before hi, spread over the first part in which the two differ."""
    for level in range(3):
        if lo[level] == hi[level]:
            continue
        gap = hi[level] - lo[level]
        if gap > 1:
            return [(*lo[:level], lo[level] + gap * i // (n + 1), *[_LOW] * (2 - level)) for i in range(1, n + 1) if 0 < gap * i // (n + 1)]
        if level == 2:
            return []
        rest = lo[level + 1]  # neighbouring values: what remains is the tail of lo's own value
        tail = _HIGH - rest
        if tail > 0:
            return [(*lo[: level + 1], rest + max(1, tail * i // n), *[_LOW] * (1 - level)) for i in range(1, n + 1)] + [(*lo[:level], hi[level], *[_LOW] * (2 - level))] * (hi[level + 1 :] != (_LOW,) * (2 - level))
        return []
    return []


def _marked(k: Key) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, k, strict=True)))


def _keys(rows: DataFrame, between: list[tuple[Key, Key]]) -> set[Key]:
    """The keys of the rows in a few intervals that are known to hold few."""
    key = F.struct(*_KEY)
    held = [(key >= _marked(lo)) & (key < _marked(hi)) for lo, hi in between]
    return {tuple(r) for r in rows.where(reduce(lambda a, b: a | b, held)).select(*_KEY).collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES, group_tolerance: float = GROUP_TOLERANCE) -> list[Key]:
    """The ``shards`` - 1 keys at which the bytes below are nearest to equal shares, at ends of groups of equal texts
    where these are within ``group_tolerance`` of a share. ``rows``: the key and size."""
    first = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total = first[0]
    goal = [total * i / shards for i in range(1, shards)]
    near = total / shards * tolerance
    start, end = (_LOW,) * 3, (_HIGH, _HIGH, _HIGH)
    known = {start: (0, 0), end: (total, first[1])}

    def nearest() -> list[Key]:
        order = sorted(known)
        sums = np.array([known[k][0] for k in order])
        return [order[int(np.abs(sums - g).argmin())] for g in goal]

    for _ in range(40):
        order = sorted(known)
        sums = np.array([known[k][0] for k in order])
        asked: set[Key] = set()
        few = []
        for g in goal:
            i = int(np.searchsorted(sums, g, "left"))
            lo, hi = order[max(i - 1, 0)], order[min(i, len(order) - 1)]
            if min(abs(known[lo][0] - g), abs(known[hi][0] - g)) > near and known[hi][1] - known[lo][1] > 1:
                if known[hi][1] - known[lo][1] <= probes:
                    few.append((lo, hi))
                else:
                    asked.update(_between(lo, hi, probes))
        asked |= _keys(rows, sorted(set(few))) if few else set()
        asked = {k for k in asked if k not in known}
        if not asked:
            break
        new = sorted(asked)
        known.update(zip(new, _count(rows, new), strict=True))
    cuts = nearest()
    ends = lambda cut: ((cut[0], _LOW, _LOW), (min(cut[0] + 1, _HIGH), _LOW, _LOW))
    if new := sorted({k for cut in cuts for k in ends(cut)} - set(known)):
        known.update(zip(new, _count(rows, new), strict=True))
    out = []
    for g, cut in zip(goal, cuts, strict=True):
        whole = min(ends(cut), key=lambda k: abs(known[k][0] - g))
        out.append(whole if abs(known[whole][0] - g) <= max(near, total / shards * group_tolerance) else cut)
    return sorted(out)


def _above(cuts: list[Key], h: str, d: str, r: str) -> Column:
    """How many of the cuts a row's key has reached: as many comparisons inside generated code."""
    number = F.lit(0)
    for a, b, c in cuts:
        number = number + ((F.col(h) > a) | ((F.col(h) == a) & ((F.col(d) > b) | ((F.col(d) == b) & (F.col(r) >= c))))).cast("int")
    return number


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (doc_id, text and others), whole, with size, shard and slot: shards of near equal bytes, slots gapless
    from 0 in sort order."""
    size, h, d, r, number, at, place, task, of, least, base = free(docs.columns, "size", "_h", "_d", "_r", "shard", "_at", "slot", "_task", "_of", "_least", "_base")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({size: (F.octet_length(text) + ROW_BYTES).cast("long"), h: F.xxhash64(text), d: F.xxhash64("doc_id")})
    narrow = saved(rows.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(size).alias("size")), "keys")
    if narrow.groupBy("h", "d").count().where("count > 1").isEmpty():
        rows, narrow = rows.withColumn(r, F.lit(0).cast("long")), narrow.withColumn("r", F.lit(0).cast("long"))
    else:  # equal rows need a number of their own, and that must not change between two readings
        rows = saved(rows.withColumn(r, F.monotonically_increasing_id()), "numbered")
        narrow = rows.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(r).alias("r"), F.col(size).alias("size"))
    cuts = splitters(narrow, shards, tolerance)
    order = [number, h, d, r]
    sorted_ = rows.withColumn(number, _above(cuts, h, d, r)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(sorted_.withColumn(at, F.monotonically_increasing_id()).drop(h, d, r), "sharded")
    # the number of a row is its task's, shifted, and its place there; a shard's rows stand together in a task
    parts = placed.groupBy(F.shiftright(at, 33).alias(task), F.col(number).alias(of)).agg(F.min(at).alias(least), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(of).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(parts.select(task, of, least, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base)), "parts")
    joined = placed.join(small(bases), (F.col(number) == F.col(of)) & (F.shiftright(at, 33) == F.col(task)))
    return joined.withColumn(place, F.col(at) - F.col(least) + F.col(base)).select(*columns(docs), size, number, place)


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of all documents by the law ``bytes``; the documents themselves are exchanged."""
    found = shard(documents(spark, sf_dir).select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Embedding near-dedup on randomised-rotation binary codes.

Equal vectors form a class that goes on as one row with its count. A vector's code is the signs of its coordinates after
two random rotations, 2 * d bits, and it is stored with a correction factor for each rotation: the inner product of the
vector and its signs, as a unit vector. For two vectors, the inner product of the first's signs under one rotation and
the second's under the other, over both factors, is an unbiased estimate of their own, as the rotations are independent;
so is the one with rotations exchanged, and their mean is what counts. Its deviation follows from the factors; a pair
is recomputed exactly, in double precision, unless the estimate is SIGMAS deviations below the threshold.

Vectors meet in the buckets of several tables of random hyperplanes, as many tables as find a pair at the threshold with
chance RECALL. Tables are taken ROUND at a time, so what is on disk stays in proportion to the input however many
there are. In a round, the first pass ships codes and factors, and returns only which entries have a partner left; most
vectors have none. The second ships vectors, for those entries alone. A pair that meets in several tables belongs to the
first: of the same round by keys that the code carries, of earlier rounds by keys that are computed again from the
vectors. Hyperplanes and vectors are rounded to whole numbers for that, so a key is the same wherever it is computed.
Neither pass returns pairs: the second gives each vector its number of links in a block and the smallest vec_id of its
component there. Buckets of more than BLOCK rows are cut into blocks and pairs of blocks, so no task holds more than
twice that.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths do not link; rows that share a vec_id count each; a null vec_id links with nothing; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import blocked, bounded_batches, connected_components, discard, rows_of, saved, small, spread

RECALL, SIGMAS, BLOCK, PER_BUCKET, ROUND, SEED = 0.995, 4.0, 2_048, 256, 8, 2024


def tables_for(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes per table, so that buckets of unlike vectors hold PER_BUCKET rows, and the number of tables."""
    bits = min(31, max(4, ceil(log2(max(1, rows / PER_BUCKET)))))
    agree = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - agree)))


@lru_cache(maxsize=16)
def _rotation(d: int, which: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, which]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def _between(d: int) -> np.ndarray:
    """Turns the second rotation's coordinates into the first's."""
    return (_rotation(d, 0).T @ _rotation(d, 1)).astype(np.float32)


@lru_cache(maxsize=32)
def _planes(d: int, bits: int, table: int) -> np.ndarray:
    return np.rint(np.random.default_rng([SEED, d, bits, table]).standard_normal((d, bits)) * 1024)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(unit: np.ndarray, bits: int, tables: range) -> np.ndarray:
    """The bucket of each unit vector (a row) in each table (a column); all sums are exact in doubles."""
    whole, power = np.rint(unit * (1 << 20)), 1 << np.arange(bits, dtype=np.int64)
    return np.stack([(whole @ _planes(unit.shape[1], bits, t) > 0) @ power for t in tables], axis=1) if len(tables) else np.zeros((len(unit), 0), np.int64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: whether each coordinate after either rotation is positive (rows, 2, d), and the correction factors
    (rows, 2): the inner product of vector and signs over the square root of d."""
    turned = np.stack([unit @ _rotation(unit.shape[1], w) for w in (0, 1)], axis=1)
    return turned >= 0, np.maximum(np.abs(turned).sum(axis=2) / np.sqrt(unit.shape[1]), 1e-6).astype(np.float32)


def estimates(signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of all pairs, the mean of those by either order of rotations."""
    d = signs.shape[2]
    x = np.where(signs, np.float32(1), np.float32(-1)) / (np.sqrt(np.float32(d)) * factors[:, :, None])
    found = (x[:, 0] @ _between(d)) @ x[:, 1].T
    return (found + found.T) / 2


def deviation(first: np.ndarray, second: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Of the estimates of pairs at the threshold, given the factors of either (rows, 2). What a vector's signs hold beside
    the vector has a random direction, so each inner product with it deviates by its length over the root of d - 1."""
    x, y = 1 / first.astype(float) ** 2 - 1, 1 / second[:, ::-1].astype(float) ** 2 - 1
    return np.sqrt(((x + y) * (1 - threshold**2) + x * y).sum(axis=1) / max(d - 1, 1)) / 2


def may_reach(signs: np.ndarray, factors: np.ndarray, threshold: float, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (first, later) with an estimate within ``sigmas`` deviations of the threshold or above."""
    d, least = signs.shape[2], factors.min(axis=0, keepdims=True) if len(factors) else np.ones((1, 2), np.float32)
    found = estimates(signs, factors)
    i, j = np.nonzero(np.triu(found >= threshold - sigmas * deviation(least, least, d, threshold)[0] - 1e-4, 1))  # no pair deviates more
    keep = found[i, j] >= threshold - sigmas * deviation(factors[i], factors[j], d, threshold) - 1e-4
    return i[keep], j[keep]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length, none of them null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _coded(vectors: DataFrame, bits: int, tables: range) -> DataFrame:
    """id, d, keys (its bucket in each of the tables) and code: factors, signs, and the keys again, of each vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                part = batch.take(pa.array(np.flatnonzero(length == d)))
                unit = units(_matrix(part.column(1)))
                signs, factors = codes(unit)
                own = keys(unit, bits, tables)
                raw = np.concatenate([factors.view(np.uint8), np.packbits(signs, axis=2).reshape(len(unit), -1), own.astype("<u4").view(np.uint8)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel()))
                yield pa.record_batch([part.column(0), pa.array(np.full(len(unit), d, np.int32)), lists, pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "d", "keys", "code"])

    return vectors.select("id", "embedding").mapInArrow(task, "id long, d int, keys array<long>, code binary")


def _decoded(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs, factors and keys of the codes."""
    raw, wide = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), -(-d // 8)
    signs = np.unpackbits(raw[:, 8 : 8 + 2 * wide].reshape(len(raw), 2, wide), axis=2, count=d).astype(bool)
    return signs, np.ascontiguousarray(raw[:, :8]).view(np.float32), np.ascontiguousarray(raw[:, 8 + 2 * wide :]).view("<u4")


def _pairs(code: pa.Array, own: np.ndarray, threshold: float, tab: int, d: int, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of likely pairs that belong to blocks x and y and to no table of the round before this one."""
    signs, factors, met = _decoded(code, d)
    i, j = may_reach(signs, factors, threshold)
    keep = np.ones(len(i), bool) if x == y else own[i] != own[j]
    for t in range(tab):
        keep &= met[i, t] != met[j, t]
    return i[keep], j[keep]


_BLOCK_KEY = ("tab", "bucket", "d", "x", "y")


def _get(rows: pa.Table, name: str) -> pa.Array:
    return rows.column(rows.column_names.index(name)).combine_chunks()


def _hopeful(entries: DataFrame, threshold: float) -> DataFrame:
    """_BLOCK_KEY, own, id of entries (of blocks) that have a partner by their codes."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        tab, _, d, x, y = (k.as_py() for k in key)
        i, j = _pairs(_get(rows, "code"), _get(rows, "own").to_numpy(), threshold, tab, d, x, y)
        return rows.select([*_BLOCK_KEY, "own", "id"]).take(pa.array(np.unique(np.concatenate([i, j]))))

    return spread(entries, *_BLOCK_KEY).groupBy(*_BLOCK_KEY).applyInArrow(task, "tab int, bucket long, d int, x int, y int, own int, id long")


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number that each row reaches by the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(unit: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have an inner product of at least the threshold; as a matrix where they are most of the pairs."""
    out, n = np.zeros(len(i), bool), len(unit)
    if len(i) * 16 > n * n:
        for a in range(0, n, 512):
            s, e = np.searchsorted(i, [a, a + 512])
            out[s:e] = (unit[a : a + 512] @ unit.T)[i[s:e] - a, j[s:e]] >= threshold
    else:
        for s in range(0, len(i), 65_536):
            out[s : s + 65_536] = np.einsum("ij,ij->i", unit[i[s : s + 65_536]], unit[j[s : s + 65_536]]) >= threshold
    return out


def _exact(entries: DataFrame, threshold: float, bits: int, before: int) -> DataFrame:
    """id, links (rows of linked classes), least (smallest id of its component): of each block, for linked vectors; pairs
    that meet in one of the ``before`` tables of earlier rounds are left out."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        tab, _, d, x, y = (k.as_py() for k in key)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")]))
        ids, same, unit = _get(rows, "id").to_numpy(), _get(rows, "same").to_numpy(), units(_matrix(_get(rows, "embedding")))
        i, j = _pairs(_get(rows, "code"), _get(rows, "own").to_numpy(), threshold, tab, d, x, y)
        close = _close(unit, i, j, threshold)
        i, j = i[close], j[close]
        for t in range(before if len(i) else 0):
            own = keys(unit, bits, range(t, t + 1))[:, 0]
            apart = own[i] != own[j]
            i, j = i[apart], j[apart]
        links = np.bincount(i, same[j], len(ids)) + np.bincount(j, same[i], len(ids)) if len(i) else np.zeros(len(ids))
        label, at = _components(len(ids), i, j), np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(ids[at], pa.int64()), "links": pa.array(links[at].astype(np.int64)), "least": pa.array(ids[label[at]], pa.int64())})

    return spread(entries, *_BLOCK_KEY).groupBy(*_BLOCK_KEY).applyInArrow(task, "id long, links long, least long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = rows.withColumn("ok", F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False))).withColumns({"h1": F.when(F.col("ok"), F.xxhash64(flat)), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(7), flat))})
    classes = saved(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("same")).withColumn("id", F.monotonically_increasing_id()), "classes")
    sole = rows.where("ok").withColumnRenamed("vec_id", "name").select("name", "h1", "h2", "embedding").join(classes, ["h1", "h2", "name"]).dropDuplicates(["id"]).select("id", "same", "embedding")
    sole = saved(sole, "vectors")
    bits, tables = tables_for(rows_of(sole, 0), threshold)
    parts = []
    for start in range(0, tables, ROUND):
        coded = saved(_coded(sole, bits, range(start, min(start + ROUND, tables))), "codes")
        entries = coded.select("id", "d", "code", F.posexplode("keys").alias("tab", "bucket"))
        hopeful = saved(_hopeful(blocked(entries, ["tab", "bucket", "d"], block), threshold), "hopeful")
        wide = hopeful.join(coded.select("id", "code"), "id").join(sole, "id")
        parts.append(saved(_exact(wide, threshold, bits, start), "found"))
        discard(coded, hopeful)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = saved(classes.select("id", "name").join(labels, "id"), "named")
    least = saved(named.groupBy("component_id").agg(F.min("name").alias("least")), "least")
    named = named.join(small(least), "component_id").select("id", "least")
    out = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left").join(degree, "id", "left").join(named, "id", "left")
    n = F.when(F.col("id").isNotNull(), F.col("same") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    component = F.coalesce("least", "name", "vec_id")
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings: cosine of 0.9 and more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))



"""Exact top-k inner products by dual-tree search over cover trees.

The tops of the two trees are a table: up to PIVOTS rows of a bounded sample are centers, every row belongs to its nearest
one, and a node is a center with the radius that covers its rows; queries have nodes of their own at the same centers.
Below that, a cover tree is built over each block of a node's data and of a node's queries: a node has a center and a
radius that covers its rows, and its children cover them at half the radius; rows that so few centers cannot cover stay
a leaf. The search goes down both trees together. For a query node with center q, radius s and a data node with center
p, radius r no inner product exceeds <q, p> + |q| r + |p| s + r s; the pair of nodes is dropped if that is below the
worst kth score of the node's queries. Leaves are compared as matrices.

A query's kth score over the sample is its floor, so pairs of top nodes are dropped before anything is exchanged. The
queries that a data node still meets are cut into blocks of about QUERY_BLOCK, its rows into blocks of about DATA_BLOCK,
and each pair of blocks meets in a task; a node that holds a third of all rows is only more blocks. What the driver sees
is the sample and a row per top node.

Scores are exact: in doubles where every product and sum is exact in them, else in 64-bit whole numbers, else in whole
numbers of any length; a component or a score that does not fit 64 bits raises an error.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths are
not compared (the lengths themselves must be few: each has nodes of its own); a row is the query's own if it has its
vec_id, and a vec_id that repeats is queried once, by the smallest of its vectors, while each of its rows is a candidate
of other queries; a null vec_id takes no part; ties go to the smaller vec_id; fewer candidates than k give all; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.common import bounded_batches, saved, spread

K, EVERY, SCALE = 5, 50, 256
QUERY_BLOCK, DATA_BLOCK, LEAF, SAMPLE, PIVOTS = 8_192, 8_192, 64, 4_096, 256
#: The score of a place that is still free.
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    rows: np.ndarray
    center: np.ndarray
    radius: float
    norm: float
    children: list[Node]


def cover_tree(x: np.ndarray, leaf: int = LEAF, tries: int = 16) -> Node:
    """A tree over the rows of x, radii halving from level to level."""

    def node(rows: np.ndarray, center: np.ndarray) -> Node:
        away = np.linalg.norm(x[rows] - center, axis=1)
        return Node(rows, center, float(away.max(initial=0.0)), float(np.linalg.norm(center)), [])

    root = node(np.arange(len(x)), x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
    stack = [root]
    while stack:
        top = stack.pop()
        if len(top.rows) <= leaf or top.radius == 0:
            continue
        left, parts, reach = top.rows, [], top.radius / 2
        away = np.linalg.norm(x[left] - top.center, axis=1)
        while len(left):
            center = x[left[away.argmax() if parts else away.argmin()]]
            gap = np.linalg.norm(x[left] - center, axis=1)
            near = gap <= reach
            parts.append((left[near], center))
            left, away = left[~near], np.minimum(away, gap)[~near]
            if len(parts) >= tries and (len(top.rows) - len(left)) < len(parts) * 4:
                break
        if len(left):
            continue  # no few balls of half the radius hold these rows
        top.children = [node(rows, center) for rows, center in parts]
        stack += [c for c in top.children if len(c.rows) < len(top.rows)]
    return root


def exactly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays in the narrowest numbers in which all inner products of their rows come out exact."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    top = most(a) * most(b) * max(1, a.shape[1])
    kind = float if top < 1 << 53 else np.int64 if top < 1 << 63 else object
    return a.astype(kind), b.astype(kind)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``exactly`` arrays, as 64-bit whole numbers."""
    found = a @ b.T
    if found.dtype == object and found.size and not (NONE < found.min() and found.max() < 1 << 63):
        raise OverflowError("an inner product does not fit 64 bits")
    return found.astype(np.int64)


class Best:
    """The k best rows of each query: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``rows`` (queries) by ``ids``; NONE takes no part."""
        floor = self.kth(rows)
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        hit = (scores >= floor[:, None]) & (scores != NONE)
        changed = np.flatnonzero(hit.any(axis=1))
        if not len(changed):
            return
        q, c = np.nonzero(hit)
        at = rows[changed]
        query = np.concatenate([rows[q], np.repeat(at, self.k)])
        score = np.concatenate([scores[q, c], self.score[at].ravel()])
        ident = np.concatenate([ids[c], self.id[at].ravel()])
        order = np.lexsort([ident, ~score, query])
        query, score, ident = query[order], score[order], ident[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        top = place < self.k
        self.score[query[top], place[top]], self.id[query[top], place[top]] = score[top], ident[top]


def search(qx: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best, cells: int = 1 << 22) -> None:
    """Adds the rows of x to the best of the queries, by both trees; arrays of 64-bit whole numbers."""
    qtree, tree = cover_tree(qx.astype(float)), cover_tree(x.astype(float))
    qx, x = exactly(qx, x)

    def bound(q: Node, p: Node) -> float:
        top = float(q.center @ p.center) + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
        return top + 1e-9 * (1 + q.norm + q.radius) * (1 + p.norm + p.radius)

    stack = [(bound(qtree, tree), qtree, tree)]
    while stack:
        most, q, p = stack.pop()
        if not len(q.rows) or not len(p.rows) or most < best.kth(q.rows).min():
            continue
        if q.children and (q.radius >= p.radius or not p.children):
            pairs = [(c, p) for c in q.children]
        elif p.children:
            pairs = [(q, c) for c in p.children]
        else:
            chunk = max(64, cells // len(q.rows))
            for i in range(0, len(p.rows), chunk):
                rows = p.rows[i : i + chunk]
                scores = products(qx[q.rows], x[rows])
                scores[qid[q.rows][:, None] == ids[rows]] = NONE
                best.add(q.rows, scores, ids[rows])
            continue
        stack += sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda s: s[0])


def _whole(embedding: Column, scale: int) -> Column:
    """The vector in whole numbers, null if it takes no part."""
    x = embedding.cast("array<double>")
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    long_ = F.exists(x, lambda v: F.abs(v * scale) >= float(1 << 63))
    error = F.raise_error(F.lit("a component does not fit 64 bits")).cast("array<bigint>")
    return F.when(good, F.when(long_, error).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("long"))))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _centers(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of x, each the farthest from those before it."""
    chosen, away = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _assigned(rows: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``rows`` (vec_id, v, asked) with d (length), g (the number of the nearest center), away (the distance to it) and, for
    queries, floor (the kth score over the sample). ``sample``: ids, vectors and centers by length."""
    sent = rows.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                part = batch.take(pa.array(np.flatnonzero(length == d)))
                x = _vectors(part.column(1)) if d else np.zeros((part.num_rows, 0), np.int64)
                ids, near, centers = sent.value.get(d, (np.zeros(0, np.int64), x[:0], np.zeros((1, d))))
                plain = x.astype(float)
                g = np.argmin((centers**2).sum(axis=1) - 2 * plain @ centers.T, axis=1)
                away = np.linalg.norm(plain - centers[g], axis=1)
                floor, asked = np.full(len(x), NONE), np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                if len(asked) and len(ids) > k:
                    a, b = exactly(x[asked], near)
                    scores = products(a, b)
                    scores[part.column(0).to_numpy()[asked][:, None] == ids] = NONE
                    floor[asked] = np.partition(scores, -k, axis=1)[:, -k]
                yield pa.record_batch([*part.columns, pa.array(np.full(len(x), d, np.int32)), pa.array(g.astype(np.int32)), pa.array(away), pa.array(floor)], names=["vec_id", "v", "asked", "d", "g", "away", "floor"])

    return rows.mapInArrow(task, "vec_id long, v array<long>, asked boolean, d int, g int, away double, floor long")


_PAIR = ("d", "gd", "qb", "db")


def _met(sides: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each pair of blocks. ``sides``: _PAIR, asked, vec_id, v, floor."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        asked = rows.column(rows.column_names.index("asked")).to_numpy()
        get = lambda name, mask: rows.column(rows.column_names.index(name)).filter(pa.array(mask))
        qid, ids = get("vec_id", asked).to_numpy(), get("vec_id", ~asked).to_numpy()
        best = Best(len(qid), k)
        best.score[:] = get("floor", asked).to_numpy()[:, None]
        if len(qid) and len(ids):
            d = key[0].as_py()
            search(_vectors(get("v", asked)).reshape(len(qid), d), qid, _vectors(get("v", ~asked)).reshape(len(ids), d), ids, best)
        q, c = np.nonzero(best.id != np.iinfo(np.int64).max)
        return pa.table({"query_id": pa.array(qid[q], pa.int64()), "vec_id": pa.array(best.id[q, c], pa.int64()), "score": pa.array(best.score[q, c], pa.int64())})

    return spread(sides, *_PAIR).groupBy(*_PAIR).applyInArrow(task, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all ``vectors`` (vec_id, embedding) for those that ``is_query``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where("vec_id is not null").select("vec_id", _whole(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("v is not null")
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    pivots = min(PIVOTS, 1 + rows.count() // DATA_BLOCK)
    for d in sorted({len(r.v) for r in drawn}):
        mine = [r for r in drawn if len(r.v) == d]
        x = np.array([r.v for r in mine], np.int64).reshape(len(mine), d)
        sample[d] = np.array([r.vec_id for r in mine], np.int64), x, _centers(x.astype(float), pivots)
    data = saved(_assigned(rows, sample, k).withColumn("n", F.monotonically_increasing_id()), "assigned")
    best = F.min(F.struct("v", "d", "g", "away", "floor")).alias("s")
    asked = saved(data.where("asked").groupBy("vec_id").agg(best).select("vec_id", "s.*"), "asked")
    nodes = {(r.d, r.g): r for r in data.groupBy("d", "g").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = asked.groupBy("d", "g").agg(F.max("away").alias("radius"), F.min("floor").alias("floor"), F.count(F.lit(1)).alias("n")).collect()
    pairs, held = [], {}  # held: of each data node, the queries that it meets
    for q in wanted:
        for (d, g), p in nodes.items():
            if d == q.d:
                a, b = (sample[d][2][i] if d in sample else np.zeros(d) for i in (q.g, g))
                m, n = np.linalg.norm(a), np.linalg.norm(b)
                most = float(a @ b) + m * p.radius + n * q.radius + q.radius * p.radius
                if most + 1e-9 * (1 + m + q.radius) * (1 + n + p.radius) >= q.floor:
                    pairs.append((d, q.g, g))
                    held[d, g] = held.get((d, g), 0) + q.n
    blocks = [(d, g, -(-n // QUERY_BLOCK), -(-nodes[d, g].n // DATA_BLOCK)) for (d, g), n in held.items()]
    split = spark.createDataFrame(blocks, "d int, gd int, qs int, ds int")  # a row per data node
    met = spark.createDataFrame(pairs, "d int, gq int, gd int").join(F.broadcast(split), ["d", "gd"])  # a row per pair of top nodes
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.withColumnRenamed("g", "gq").join(F.broadcast(met), ["d", "gq"]).select("d", "gd", block("vec_id", "qs").alias("qb"), every("ds").alias("db"), F.lit(True).alias("asked"), "vec_id", "v", "floor")
    right = data.withColumnRenamed("g", "gd").join(F.broadcast(split), ["d", "gd"]).select("d", "gd", every("qs").alias("qb"), block("n", "ds").alias("db"), F.lit(False).alias("asked"), "vec_id", "v", "floor")
    found = _met(left.unionByName(right), k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings, in whole numbers, for each of those whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)

"""Filter interaction audit: what each filter removes after which others, over all their orders.

Every text is judged once by all filters, into a mask of those that it fails. All that the report says of the orders
follows from how many documents, good ones and toxic ones have each mask, so the orders are never run.

Whether a text repeats that of a smaller doc_id is found by routing: a task keeps one of each text that it meets, with
the smallest doc_id, and tells at once that the others repeat it; what it kept is dealt by the xxhash of the text, and
the task that gets it holds, under each fingerprint, a chain of full texts with the smallest doc_id of each. Rows whose
doc_id is not that one fail. So a group of copies sends one row for each window of a task, and equal fingerprints of
different texts stay apart. The texts travel compressed; as equal texts compress alike, they are compared so. There are
as many partitions as keep each under TEXT_BYTES of texts.

Masks are counted in vectors, one for each part, which combineByKey merges.

Cases: a null text is empty; empty texts pass the filters on distinct words and capitals, and repeat one another; rows
equal in doc_id and text do not repeat one another; a null doc_id repeats nothing, is repeated by nothing
and has no labels; labels that repeat count as 1 if any is 1; a null source is the part '' and joins one of that name;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import bounded_batches, chunks, documents, saved, small
from pricewright.llm.textkernel import split_words, squeeze

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: A: words at least; B: distinct ones in a hundred, at least; C: capitals in a hundred code points, at most.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
#: Fixed value: marks that fail a text.
MARKS = "#$%&*|"
#: Compressed bytes of texts in which a task looks for repeats before it sends them on, and plain ones in a partition.
WINDOW_BYTES, TEXT_BYTES = 32 << 20, 128 << 20
#: Parts whose vectors a task holds before it sends them on.
PARTS = 10_000

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_POINT = np.array([not 128 <= b < 192 for b in range(256)])
_MARK = np.array([b < 128 and chr(b) in MARKS for b in range(256)])


def masks(texts: pa.Array) -> np.ndarray:
    """The filters that each text fails by itself: bit 0 for A, and so on; E, which needs the other texts, is left out."""
    words = split_words(texts)
    n, of = words.counts(), words.text_of()
    hashes = words.hashes()
    order = np.lexsort([hashes, of])
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=len(n)) if len(o) else np.zeros(len(n), np.int64)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask[words.data])])[words.offsets])

    fails = (n < WORDS, 100 * distinct < DISTINCT * n, 100 * total(_UPPER) > CAPITALS * total(_POINT), total(_MARK) > 0)
    return sum((f.astype(np.int64) << i for i, f in enumerate(fails)), np.zeros(len(n), np.int64))


class Chain:
    """Texts of one fingerprint: each with the smallest doc_id met so far, and the rows that have it by part."""

    def __init__(self) -> None:
        self.links: list[list] = []  # text, mask, doc_id, {part: rows}

    def add(self, text: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> tuple[int, dict[str, int]] | None:
        """Takes rows in; returns the doc_id and the rows of those that are now known to repeat a smaller one."""
        for link in self.links:
            if link[0] == text:
                if doc_id == link[2]:
                    link[3].update(parts)
                    return None
                if doc_id > link[2]:
                    return doc_id, parts
                out = link[2], link[3]
                link[2:] = [doc_id, Counter(parts)]
                return out
        self.links.append([text, mask, doc_id, Counter(parts)])
        return None


def _key(n: int) -> int:
    return xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True))


def _judged(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, doc_id, part, mask, n): with a compressed text where a smaller doc_id may still have it."""

    def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 256):
            columns = zip(*rows[i : i + 256], strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["key", "text", "doc_id", "part", "mask", "n"])

    def flush(held: dict[bytes, Chain]) -> list[tuple]:
        return [(int.from_bytes(f[:8], "little", signed=True), text, doc_id, part, mask, n) for f, chain in held.items() for text, mask, doc_id, parts in chain.links for part, n in parts.items()]

    held, size = {}, 0
    for table in chunks(batches):
        ids, parts, texts = (table.column(i).combine_chunks() for i in range(3))
        known: list[tuple] = []
        for doc_id, part, mask, z in zip(ids.to_pylist(), parts.to_pylist(), masks(texts).tolist(), squeeze(texts.fill_null("")).to_pylist(), strict=True):
            if doc_id is None:
                known.append((_key(len(known)) - (1 << 63), None, None, part, mask, 1))
                continue
            f = xxhash.xxh3_128_digest(z)
            if f not in held:
                held[f] = Chain()
                size += len(z)
            if gone := held[f].add(z, mask, doc_id, {part: 1}):
                known += [(_key(gone[0]) - (1 << 63), None, gone[0], p, mask | COPY, n) for p, n in gone[1].items()]
        yield from send(known)
        if size >= window:
            yield from send(flush(held))
            held, size = {}, 0
    yield from send(flush(held))


def _resolved(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of all rows of a partition."""
    held: dict[bytes, Chain] = {}
    for _, (text, doc_id, part, mask, n) in rows:
        if text is None:
            yield doc_id, part, mask, n
        elif gone := held.setdefault(xxhash.xxh3_128_digest(text), Chain()).add(text, mask, doc_id, {part: n}):
            for p, m in gone[1].items():
                yield gone[0], p, mask | COPY, m
    for chain in held.values():
        for _, mask, doc_id, parts in chain.links:
            for p, m in parts.items():
                yield doc_id, p, mask, m


def failures(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """doc_id, part, mask and n, the number of documents alike in these."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES))
    judged = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(lambda batches: _judged(batches, window), "key long, text binary, doc_id long, part string, mask int, n long")
    routed = judged.rdd.map(lambda r: (r[0], tuple(r)[1:])).partitionBy(n, lambda key: key)
    return spark.createDataFrame(routed.mapPartitions(_resolved), "doc_id long, part string, mask int, n long", verifySchema=False)


def counted(found: DataFrame, labels: DataFrame):
    """(part, vector) of all parts, an RDD: documents, good ones and toxic ones with each mask."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"_{c}")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(one("quality"), one("toxic"))
    marks = saved(marks.where("_quality = 1 or _toxic = 1"), "labels")
    joined = found.join(small(marks), F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("_quality", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], names=["part", "vector"])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            of, mask, n, good, toxic = parts.indices.to_numpy(), *(batch.column(i).to_numpy() for i in range(1, 5))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                at = of == i
                v = held.setdefault(part, np.zeros((3, 1 << len(FILTERS)), np.int64))
                for j, w in enumerate((n[at], n[at] * good[at], n[at] * toxic[at])):
                    np.add.at(v[j], mask[at], w)
            if len(held) >= PARTS:
                yield out()
                held = {}
        yield out()

    vectors = joined.mapInArrow(task, "part string, vector binary").rdd.map(lambda r: (r.part, np.frombuffer(r.vector, "<i8").reshape(3, -1)))
    return vectors.combineByKey(lambda v: v.copy(), np.add, np.add, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def report(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: filter_order, step, and what the filter of that step does there."""
    every, mask = vector.shape[1], np.arange(vector.shape[1])
    done, removed_in_all = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails, there = mask & bit > 0, mask & before == 0
            removed, good, toxic = (int(v[fails & there].sum()) for v in vector)
            removed_in_all[f] += removed
            done.append((f, "".join(order), step, int(vector[0][there & ~fails].sum()), removed, int(vector[0][fails & ~there].sum()), int(vector[0][bit % every]), good, toxic))
            before |= bit
    for f, order, step, *counts in done:
        yield part, order, step, *counts, removed_in_all[f]


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """The report over ``docs`` (doc_id, source, text) with ``labels`` (doc_id, quality, toxic)."""
    return docs.sparkSession.createDataFrame(counted(failures(docs, window), labels).flatMap(lambda kv: report(*kv)), _REPORT, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits five filters over all documents, by source."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Packing as a cutting-stock problem, by column generation, with the rest cut to fill what is left open.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. Lengths are put into at most
CLASSES classes, and a pattern says how many of each class a sequence takes, by the class' longest length. A linear
program over patterns asks for the fewest sequences: it starts from one pattern for each class, and a knapsack by
dynamic programming over the capacity prices the classes by the program's duals and names the pattern that gains most,
until none does. The solution is rounded down; what the rounding leaves is packed greedily by classes.

Documents are ranked within their classes and a rank has a slot, as in the other packing, so patterns are assigned by
joins with a table of at most CLASSES rows and by arithmetic. As lengths of a class differ, sequences are not quite full.
So the program is scaled down until all its sequences hold no more than all ids do, and the documents left over, about
as many as the classes waste, fill them up: open places and left documents are two lines of ids, laid on one another by
distributed prefix sums and cut at each other's ends, in cells of bounded length. What then remains of the left ids
goes into further sequences, and the last of it into sequences of powers of two. Nothing is padded, and all documents
but those left over stay whole (or whole but for cuts at ``capacity``).

Cases: null and empty texts hold only the end id; texts of over ``capacity`` ids are cut into full pieces and a rest;
rows with equal ids, null ones too, are packed each; an empty table gives an empty result; of the documents, only doc_id
and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.common import bounded_batches, documents, saved, small
from pricewright.llm.packing import CAPACITY, SALTS, ranked
from pricewright.llm.tokens import default_path, encoder

END_ID = 2
#: Classes of lengths, and patterns that the program tries at most.
CLASSES, ROUNDS = 96, 3_000
#: Rows whose running sum one task takes, and ids in a cell of the lines.
BLOCK, CELL = 4096, 1 << 17
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def items(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """item (a number of its own), doc_id, start, length, ids_crc32, doc_tokens, salt and ids of every document's pieces
    of at most ``capacity`` ids."""
    bounded_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(tokenizer), 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, offsets = enc.encode_ended(batch.column(1), end_id)
            ids, total = ids.astype("<u4"), np.diff(offsets)
            cuts = -(-total // capacity)
            row = np.repeat(np.arange(batch.num_rows), cuts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
            a = offsets[row] + start
            b = np.minimum(a + capacity, offsets[row + 1])
            raw = [ids[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            number = n + np.arange(len(row))
            n += len(row)
            columns = [pa.array(base + number), batch.column(0).take(pa.array(row)), pa.array(start), pa.array(b - a), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(total[row]), pa.array(number % SALTS, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.record_batch(columns, names=["item", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task, "item long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int, ids binary")


def classes(counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The longest length of each class: cuts where the running sum of the counts' roots passes equal shares, which
    wastes least for so many classes."""
    lengths = np.flatnonzero(counts)
    if len(lengths) <= most:
        return lengths
    upto = np.cumsum(np.sqrt(counts[lengths]))
    last = np.searchsorted(upto, upto[-1] * np.arange(1, most + 1) / most * (1 - 1e-12))
    return lengths[np.unique(np.append(last, len(lengths) - 1))]


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` that fits, and its value. A size's row follows from the one before: along
    each remainder, the running maximum of what was there less what the copies so far are worth."""
    best = np.zeros((len(sizes) + 1, capacity + 1))
    for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        if v <= 0:
            best[i + 1] = best[i]
            continue
        rows = -(-(capacity + 1) // s)
        before = np.full(rows * s, -np.inf)
        before[: capacity + 1] = best[i]
        worth = np.arange(rows)[:, None] * v
        best[i + 1] = (np.maximum.accumulate(before.reshape(rows, s) - worth, axis=0) + worth).ravel()[: capacity + 1]
    taken, c = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes), 0, -1):
        while c >= sizes[i - 1] and best[i, c] > best[i - 1, c] + 1e-9:
            taken[i - 1] += 1
            c -= int(sizes[i - 1])
    return float(best[-1, capacity]), taken


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The columns (a row for each size) and the times of the program's solution: the fewest sequences that hold
    ``counts`` pieces of each size. After ``rounds`` columns, the best so far."""
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    times = inverse @ counts
    for _ in range(rounds):
        value, column = knapsack(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        times = np.maximum(times - step * ratio[out], 0)
        times[out] = ratio[out]
        basis[:, out] = column
    return basis.astype(np.int64), times


@dataclass
class Plan:
    """What is placed whole. slots: for each class, rows (first rank, how many at a time, sequences, first sequence, place);
    taken: how many ranks of each class have slots; sequences: how many there are."""

    sizes: np.ndarray
    held: np.ndarray
    slots: list[np.ndarray]
    taken: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, most: int = CLASSES) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    sizes = classes(counts, most)
    held = np.add.reduceat(counts, np.concatenate([[0], sizes[:-1] + 1])) if len(sizes) else np.zeros(0, np.int64)
    room = int((counts * np.arange(capacity + 1)).sum()) // capacity  # sequences that all ids could fill
    slots, taken, sequence = [[] for _ in sizes], np.zeros(len(sizes), np.int64), 0

    def use(column: np.ndarray, times: int) -> None:
        nonlocal sequence
        place = 0
        for i in np.flatnonzero(column).tolist():
            each = int(column[i])
            slots[i].append((int(taken[i]), each, times, sequence, place))
            taken[i] += each * times
            place += each
        sequence += times

    if len(sizes) and room:
        columns, times = patterns(sizes, held, capacity)
        scale = min(1.0, room / times.sum())
        for column, t in sorted(zip(columns.T.tolist(), times.tolist(), strict=True), key=lambda x: -x[1]):
            column = np.array(column)
            fits = int(((held - taken)[column > 0] // column[column > 0]).min())
            if n := min(int(t * scale + 1e-7), fits, room - sequence):
                use(column, n)
        while sequence < room:  # what the rounding leaves, longest first
            left, gap, column = held - taken, capacity, np.zeros(len(sizes), np.int64)
            for i in np.flatnonzero(left)[::-1].tolist():
                column[i] = min(int(left[i]), gap // int(sizes[i]))
                gap -= int(column[i] * sizes[i])
            if not column.any():
                break
            use(column, min(room - sequence, int((left[column > 0] // column[column > 0]).min())))
    return Plan(sizes, held, [np.array(s, np.int64).reshape(-1, 5) for s in slots], taken, sequence)


def prefixed(rows: DataFrame, number: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows of a smaller ``number`` (from 0, without repeats): sums of
    blocks, and of blocks of these, so that no task sums more than ``block`` rows until block ** 3 of them."""
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda v, part, order: F.coalesce(F.sum(v).over(before(part, order)), F.lit(0))
    numbered = rows.withColumn("_b", F.floor(F.col(number) / block))
    sums = saved(numbered.groupBy("_b").agg(F.sum(value).alias("_s")).withColumn("_c", F.floor(F.col("_b") / block)), "sums")
    above = sums.groupBy("_c").agg(F.sum("_s").alias("_s")).withColumn("_high", ahead("_s", (), "_c")).drop("_s")
    bases = sums.withColumn("_low", ahead("_s", ("_c",), "_b")).join(above, "_c").select("_b", (F.col("_low") + F.col("_high")).alias("_base"))
    inner = numbered.withColumn("_in", ahead(value, ("_b",), number))
    return inner.join(small(saved(bases, "bases")), "_b").withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_b", "_in", "_base")


def tail(left: int, capacity: int) -> list[int]:
    """``left`` ids, under ``capacity``, as powers of two, the largest first."""
    return [1 << i for i in range(capacity.bit_length(), -1, -1) if left >> i & 1]


def _laid(open_: DataFrame, left: DataFrame, sequences: int, slack: int, total: int, capacity: int, cell: int) -> DataFrame:
    """The pieces of ``left`` (at, ids and what is known of the document), cut by the open places (at, gap, sequence_id,
    used) and, from ``slack`` on, by new sequences. A cell gets what it touches, and makes the pieces that begin in it; as
    neither line has gaps, all of them begin where a document or a place does."""
    ends = [slack + (total - slack) // capacity * capacity]
    for size in tail((total - slack) % capacity, capacity):
        ends.append(ends[-1] + size)

    def in_cells(rows: DataFrame, length: str) -> DataFrame:
        last = F.floor((F.col("at") + F.col(length) - 1) / cell)
        return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / cell), last)))

    def pieces(key: tuple, docs: pa.Table, places: pa.Table) -> pa.Table:
        a, b = key[0].as_py() * cell, (key[0].as_py() + 1) * cell
        docs, places = docs.sort_by("at"), places.sort_by("at")
        begins = docs["at"].to_numpy()
        at, gap, sequence, used = (places[c].to_numpy() for c in ("at", "gap", "sequence_id", "used"))
        over = np.arange(max(0, (a - slack) // capacity), max(0, -(-(min(b, ends[0]) - slack) // capacity)))
        last = np.array([e for e in ends[:-1] if e < b], np.int64)  # the sequences of powers of two begin where others end
        at = np.concatenate([at, slack + over * capacity, last])
        until = np.concatenate([places["at"].to_numpy() + gap, slack + (over + 1) * capacity, np.array(ends[1:], np.int64)[: len(last)]])
        sequence = np.concatenate([sequence, sequences + over, sequences + (ends[0] - slack) // capacity + np.arange(len(last))])
        used = np.concatenate([used, np.zeros(len(over) + len(last), np.int64)])
        cuts = np.unique(np.concatenate([begins, at])).astype(np.int64)
        mine = (cuts >= a) & (cuts < b)
        cuts = cuts[mine]
        doc, place = np.searchsorted(begins, cuts, "right") - 1, np.searchsorted(at, cuts, "right") - 1
        stops, shift = np.minimum((begins + docs["length"].to_numpy())[doc], until[place]), cuts - begins[doc]
        raw = docs["ids"].combine_chunks()
        crcs = [zlib.crc32(raw[d].as_buffer().to_pybytes()[4 * s : 4 * e]) for d, s, e in zip(doc.tolist(), shift.tolist(), (stops - begins[doc]).tolist(), strict=True)]
        take = lambda c: docs[c].to_numpy()[doc]
        return pa.table({"doc_id": docs["doc_id"].combine_chunks().take(pa.array(doc)), "start": pa.array(take("start") + shift), "length": pa.array(stops - cuts), "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(take("doc_tokens")), "sequence_id": pa.array(sequence[place]), "offset": pa.array(used[place] + cuts - at[place])})

    return in_cells(left, "length").groupBy("cell").cogroup(in_cells(open_, "gap").groupBy("cell")).applyInArrow(pieces, _PIECES)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, most: int = CLASSES, cell: int = CELL) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of all pieces; ``capacity`` is a power of two."""
    spark = docs.sparkSession
    cut = saved(items(docs, tokenizer, capacity, end_id), "items")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    made = plan(histogram, capacity, most)
    of = np.searchsorted(made.sizes, sorted(histogram))
    kinds = spark.createDataFrame([(k, int(c)) for k, c in zip(sorted(histogram), of.tolist(), strict=True)], "length long, class int")
    narrow = cut.drop("ids").join(F.broadcast(kinds), "length")
    rows = ranked(narrow, "class", dict(enumerate(made.held.tolist())))
    sent = spark.sparkContext.broadcast((made.slots, made.taken, np.concatenate([[0], np.cumsum(made.held - made.taken)])))  # CLASSES rows of slots for each pattern at most
    columns = ["item", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, taken, spare = sent.value
        for batch in batches:
            rank, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_rank", "class"))
            sequence, slot, number = np.full(len(rank), -1), np.full(len(rank), -1), np.full(len(rank), -1)
            for c in np.unique(kind).tolist():
                at = np.flatnonzero((kind == c) & (rank < taken[c]))
                if len(at):
                    s = slots[c][np.searchsorted(slots[c][:, 0], rank[at], "right") - 1]
                    on = rank[at] - s[:, 0]
                    sequence[at], slot[at] = s[:, 3] + on // s[:, 1], s[:, 4] + on % s[:, 1]
                over = np.flatnonzero((kind == c) & (rank >= taken[c]))
                number[over] = spare[c] + rank[over] - taken[c]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence), pa.array(slot), pa.array(number)], names=[*columns, "sequence_id", "slot", "number"])

    placed = saved(rows.mapInArrow(place, "item long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long, number long"), "placed")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    spare = placed.where("number >= 0").drop("sequence_id", "slot")
    total = spare.agg(F.sum("length")).first()[0] or 0
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    if not total:
        return whole
    used = placed.where("sequence_id >= 0").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    open_ = prefixed(used.withColumn("gap", F.lit(capacity) - F.col("used")), "sequence_id", "gap", "at").where("gap > 0")
    open_ = saved(open_.select("at", "gap", "sequence_id", "used"), "open")
    slack = open_.agg(F.sum("gap")).first()[0] or 0
    left = prefixed(spare, "number", "length", "at")
    left = cut.select("item", "ids").join(small(saved(left, "left")), "item").select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    return whole.unionByName(_laid(open_, left, made.sequences, slack, total, capacity, cell))


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 ids without padding."""
    return packed(documents(spark, sf_dir))

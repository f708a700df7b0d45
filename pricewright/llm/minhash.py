"""MinHash near-dedup with sequential Bayesian verification.

A document's set of word shingles gets a signature of minima under random hash functions. Documents with equal sets
form a class and only its first doc_id goes on. Classes that agree on a band of the signature meet in a bucket.
First, every bucket's smallest id is paired with the others of the bucket, which connects most groups of copies with
as many pairs as members. Then only buckets that still hold several components matter: within a task, blocks of their
members are compared as matrices of signatures, across components; pairs are not sent on, only the members that have
a likely partner, once per pair in the first band that it shares. Last, the full sets of those members meet in the same blocks, likely
pairs are compared exactly, and the links that join components come back. Every pair of a bucket is so tested or already connected, no
step makes more rows than there are members, and hot buckets are cut into pairs of blocks.

A pair's signatures are compared a batch of hashes at a time. With ``m`` of ``n`` equal and a uniform prior, the
similarity is Beta(m + 1, n - m + 1), and its chance of reaching the threshold is that of at most m successes in n + 1
trials at the threshold; a pair goes when that chance falls below ``miss``. Survivors are compared on their full sets.

Cases: null and blank texts have no shingles and link with nothing; a text of fewer words than a shingle holds one
shingle, all of it; rows that share a doc_id are one document if their texts are equal, and otherwise each is judged
by its own text under that id; a null doc_id links with nothing and is kept; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import blocked, bounded_batches, connected_components, documents, is_empty, saved, small, spread
from pricewright.llm.textkernel import grams, mix, ranges, split_words

HASHES, BATCH, MISS, LOST = 128, 16, 1e-7, 2e-6
#: Members of a bucket that meet in one task.
BLOCK = 2_048
#: Shingles of all rows in a block, at most, beyond those of one row: 16 MB of hashes.
BLOCK_SHINGLES = 2 << 20


def banding(threshold: float, hashes: int = HASHES, lost: float = LOST) -> tuple[int, int]:
    """Bands and rows per band: the longest rows at which a pair at the threshold is lost with chance ``lost`` at most."""
    for rows in range(16, 0, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= lost:
            return bands, rows
    return hashes, 1


def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """After each batch: hashes compared, and the fewest matches with which a pair stays."""
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (r[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[hashes:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; words are lower-cased in A-Z only."""
    words = split_words(texts, lower=True)
    h = words.hashes()
    g = grams(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else g[:0]


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of lo * mul + hi * add modulo 2**32 over the set, a run of the set at a time."""
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 512):
        x = mul[:, None] * low[i : i + 512]
        x += add[:, None] * high[i : i + 512]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, k: int, hashes: int = HASHES) -> DataFrame:
    """doc_id, n (set size), f1, f2 (128 bits that name the set), sig (the signature's bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _constants(hashes)
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                f1.append(int(mix(s * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s, mul, add).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "f1", "f2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n long, f1 long, f2 long, sig binary")


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The key of the bucket that each signature (a row) is in, for each band (a column)."""
    sig, keys = sig.astype(np.uint64), np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for x in sig[:, b * rows : (b + 1) * rows].T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
        keys[:, b] = h
    return keys


def _banded(classes: DataFrame, bands: int, rows: int, hashes: int) -> DataFrame:
    """band, key, id, n: a row for each band of each class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _band_keys(_matrix(batch.column(2), hashes), bands, rows)
            at = pa.array(np.repeat(np.arange(len(keys)), bands))
            yield pa.record_batch([pa.array(np.tile(np.arange(bands, dtype=np.int32), len(keys))), pa.array(keys.ravel().view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["band", "key", "id", "n"])

    return classes.select("id", "n", "sig").mapInArrow(task, "band int, key long, id long, n long")


def _narrowed(classes: DataFrame, bands: int, rows: int, hashes: int) -> DataFrame:
    """id, s8 (the signature's low bytes), met (the keys of all its buckets) of each class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _matrix(batch.column(1), hashes)
                yield pa.record_batch([batch.column(0), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (sig.astype(np.uint8), _band_keys(sig, bands, rows)))], names=["id", "s8", "met"])

    return classes.select("id", "sig").mapInArrow(task, "id long, s8 binary, met binary")


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows a, blk, b, v of ``pairs`` (a, b) with the value v of b, and before those of each a and blk a row of a itself,
    b null: what a is compared by goes to a task once per block of its partners, not once per partner."""
    many = saved(pairs.groupBy("a").count().where(f"count > {BLOCK}").select("a", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "many")
    sized = pairs.join(small(many), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = sized.withColumn("blk", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(values.select(F.col("id").alias("b"), "v"), "b")
    first = sized.select("a", "parts").distinct().withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(values.select(F.col("id").alias("a"), "v"), "a")
    both = members.select("a", "blk", "b", "v").unionByName(first.select("a", "blk", F.lit(None).cast("long").alias("b"), "v"))
    return spread(both, "a", "blk").sortWithinPartitions("a", "blk", F.col("b").asc_nulls_first())


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float, hashes: int, batch_size: int, miss: float) -> DataFrame:
    """a, b of ``pairs`` that the sequential test does not rule out by the signatures of ``classes``."""
    steps = least_matches(threshold, hashes, batch_size, miss)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1, hashes), np.uint32)  # the signature of the last a
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.concatenate([held, _matrix(batch.column(3), hashes)])
            own = np.concatenate([[True], batch.column(2).is_null().to_numpy(zero_copy_only=False)])
            last = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))
            held, alive = sig[last[-1:]], np.flatnonzero(~own)
            m, done = np.zeros(len(alive), np.int64), 0
            for n, least in steps:
                m = m + (sig[alive, done:n] == sig[last[alive], done:n]).sum(axis=1)
                stay = m >= least
                alive, m, done = alive[stay], m[stay], n
            yield batch.select(["a", "b"]).take(pa.array(alive - 1))

    return _beside(pairs, classes.withColumnRenamed("sig", "v")).mapInArrow(task, "a long, b long")


def _sets(need: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, s (the bytes of its shingle set) of the documents in ``need`` (id)."""
    need = saved(need.select(F.col("id").alias("doc_id")), "need")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], names=["id", "s"])

    found = docs.select("doc_id", "text").join(small(need), "doc_id", "left_semi").mapInArrow(task, "id long, s binary")
    return saved(found.where("length(s) > 0").dropDuplicates(["id", "s"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """a, b of ``pairs`` whose full sets have ``whole`` * intersection >= ``part`` * union."""
    held = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)  # the set of the last a
        for batch in batches:
            keep = []
            for own, raw in zip(batch.column(2).is_null().to_pylist(), batch.column(3).to_pylist(), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if own:
                    mine = other
                x, y = (mine, other) if len(mine) <= len(other) else (other, mine)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(not own and whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, held.withColumnRenamed("s", "v")).mapInArrow(task, "a long, b long")


class _Forest:
    """Which rows of a block are connected, by known labels and by links found."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.parent = list(range(int(self.up.max(initial=-1)) + 1))

    def root(self, row: int) -> int:
        at = int(self.up[row])
        while self.parent[at] != at:
            self.parent[at] = at = self.parent[self.parent[at]]
        return at

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)


def _survivors(sig: np.ndarray, keys: np.ndarray, labels: np.ndarray, own: np.ndarray, x: int, y: int, band: int, steps: list[tuple[int, int]], sizes: np.ndarray, part: int, whole: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs of a block across components, each row with later ones, if this band is the first
    in which ``keys``, those of their buckets, are equal."""
    n0, least0 = steps[0]
    for a in range(0, len(sig), rows):
        top = sig[a : a + rows]
        same = np.zeros((len(top), len(sig)), np.uint8)
        for h in range(n0):
            same += top[:, h, None] == sig[None, :, h]
        i, j = np.nonzero((same >= least0) & (labels[a : a + rows, None] != labels[None, :]))
        m, i = same[i, j].astype(np.int64), i + a
        keep = i < j
        if x != y:
            keep &= own[i] != own[j]
        keep &= whole * np.minimum(sizes[i], sizes[j]) >= part * np.maximum(sizes[i], sizes[j])
        i, j, m, done = i[keep], j[keep], m[keep], n0
        for n, least in steps[1:]:
            m = m + (sig[i, done:n] == sig[j, done:n]).sum(axis=1)
            stay = m >= least
            i, j, m, done = i[stay], j[stay], m[stay], n
        met = np.zeros(len(i), bool)
        for b in range(band):
            met |= keys[i, b] == keys[j, b]
        yield i[~met], j[~met]


def _read(rows: pa.Table, name: str) -> pa.Array:
    return rows.column(rows.column_names.index(name)).combine_chunks()


def _bucket_keys(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(_read(rows, "met").to_pylist()), np.uint64).reshape(rows.num_rows, -1)


_BLOCK_KEY = ("band", "key", "x", "y")


def _hopeful(entries: DataFrame, hashes: int, steps: list[tuple[int, int]], part: int, whole: int) -> DataFrame:
    """band, key, x, y, id of the members of blocks (id, n, c, s8, met, own) that have a likely partner in another component."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        band, x, y = key[0].as_py(), key[2].as_py(), key[3].as_py()
        sig = np.frombuffer(b"".join(_read(rows, "s8").to_pylist()), np.uint8).reshape(-1, hashes)
        keys, hit = _bucket_keys(rows), np.zeros(len(sig), bool)
        for i, j in _survivors(sig, keys, _read(rows, "c").to_numpy(), _read(rows, "own").to_numpy(), x, y, band, steps, _read(rows, "n").to_numpy(), part, whole):
            hit[i] = hit[j] = True
        return rows.select(["band", "key", "x", "y", "id"]).filter(pa.array(hit))

    return spread(entries, *_BLOCK_KEY).groupBy(*_BLOCK_KEY).applyInArrow(task, "band int, key long, x int, y int, id long")


def _joining(entries: DataFrame, hashes: int, steps: list[tuple[int, int]], part: int, whole: int) -> DataFrame:
    """a, b: of the likely pairs of blocks (as in _hopeful, with the sets s), confirmed links that join components."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        band, x, y = key[0].as_py(), key[2].as_py(), key[3].as_py()
        ids, labels = _read(rows, "id").to_numpy(), _read(rows, "c").to_numpy()
        sig = np.frombuffer(b"".join(_read(rows, "s8").to_pylist()), np.uint8).reshape(-1, hashes)
        raw = _read(rows, "s").to_pylist()
        sizes = np.array([len(r) // 8 for r in raw], np.int64)
        names, flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        forest, mark, out = _Forest(labels), np.zeros(len(names), np.int64), []
        for i, j in _survivors(sig, _bucket_keys(rows), labels, _read(rows, "own").to_numpy(), x, y, band, steps, sizes, part, whole):
            cuts = [*np.flatnonzero(np.diff(i, prepend=-1)).tolist(), len(i)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                row = int(i[a])
                others = np.array([o for o in j[a:b].tolist() if forest.root(o) != forest.root(row)], np.int64)
                if not len(others):
                    continue
                mine = flat[starts[row] : starts[row] + sizes[row]]
                mark[mine] = 1
                hits = mark[flat[ranges(starts[others], sizes[others])]]
                both = np.add.reduceat(hits, np.cumsum(sizes[others]) - sizes[others])
                mark[mine] = 0
                for o in others[whole * both >= part * (sizes[row] + sizes[others] - both)].tolist():
                    if forest.root(o) != forest.root(row):
                        forest.join(o, row)
                        out.append((int(ids[row]), int(ids[o])))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return spread(entries, *_BLOCK_KEY).groupBy(*_BLOCK_KEY).applyInArrow(task, "a long, b long")


def _links(banded: DataFrame, classes: DataFrame, docs: DataFrame, k: int, part: int, whole: int, hashes: int, batch: int, miss: float, per: int) -> DataFrame | None:
    """id, component_id of all classes that link with another; ``banded``: band, key, id, n of buckets that several share."""
    threshold = part / whole
    firsts = banded.groupBy("band", "key").agg(F.min_by(F.struct(F.col("id").alias("p"), F.col("n").alias("pn")), "id").alias("f")).select("band", "key", "f.p", "f.pn")
    pairs = banded.join(firsts, ["band", "key"]).where(f"id <> p and {whole} * least(n, pn) >= {part} * greatest(n, pn)")
    pairs = saved(pairs.select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = saved(_confirmed(saved(_likely(pairs, classes.select("id", "sig"), threshold, hashes, batch, miss), "likely"), docs, k, part, whole), "links")
    labels = connected_components(links)
    state = banded.join(labels, "id", "left").select("band", "key", "id", "n", F.coalesce("component_id", "id").alias("c"))
    mixed = state.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "key")
    entries = state.join(mixed, ["band", "key"]).join(_narrowed(classes, hashes // per, per, hashes), "id")
    entries = blocked(saved(entries, "entries"), ["band", "key"], BLOCK, "n", BLOCK_SHINGLES)
    steps = least_matches(threshold + (1 - threshold) / 256, hashes, batch, miss)  # bytes agree by chance, too
    hopeful = saved(_hopeful(entries, hashes, steps, part, whole), "hopeful")
    if is_empty(hopeful):
        return labels
    sets = _sets(hopeful.select("id").distinct(), docs, k)
    more = saved(_joining(entries.join(hopeful, [*_BLOCK_KEY, "id"], "left_semi").join(sets, "id"), hashes, steps, part, whole), "joining")
    return connected_components(links.unionByName(more))


def _by_row(docs: DataFrame, every: DataFrame, k: int, part: int, whole: int, hashes: int, batch: int, miss: float) -> DataFrame:
    """near_duplicates where a doc_id stands on different texts: rows are compared under numbers of their own."""
    table = saved(docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = near_duplicates(table.select(F.col("row").alias("doc_id"), "text"), k, part, whole, hashes, batch, miss)
    found = saved(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("c")).join(table.select("row", "doc_id"), "row"), "found")
    out = found.join(found.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text): documents whose sets of ``k``-word
    shingles have ``whole`` * intersection >= ``part`` * union are linked."""
    bounded_batches(docs.sparkSession)
    bands, rows = banding(part / whole, hashes)
    every = saved(signatures(docs, k, hashes), "signatures")
    known = every.where("n > 0 and doc_id is not null")
    if not known.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("f1", "f2"))).where("min_f1 < max_f1 or min_f2 < max_f2").isEmpty():
        return _by_row(docs, every, k, part, whole, hashes, batch, miss)
    first = saved(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), "classes")
    sole = known.withColumnRenamed("doc_id", "id").join(first, ["f1", "f2", "id"], "left_semi").select("id", "n", "f1", "f2", "sig").dropDuplicates(["id", "f1", "f2"])
    classes = saved(sole, "reps")
    banded = saved(_banded(classes, bands, rows, hashes), "bands")
    buckets = banded.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band", "key")
    members = saved(banded.join(buckets, ["band", "key"]), "members")
    held = saved(classes.select("id", "sig").join(members.select("id").distinct(), "id", "left_semi"), "held")
    labels = _links(members, held, docs, k, part, whole, hashes, batch, miss, rows)
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(first, ["f1", "f2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("id"))
    out = out.withColumn("id", F.coalesce(own, F.col("doc_id"))) if labels is None else out.withColumn("id", own).join(labels, "id", "left").withColumn("id", F.coalesce("component_id", "id", "doc_id")).drop("component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=3, part=85, whole=100)

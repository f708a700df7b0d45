"""A table of products without a table format: folders of rows, and pointers that list which folder holds what.

The table is partitioned by vendor, service and bucket, a range of product hashes, and sorted by region and hash within
a file. A write puts the buckets that it changes into a folder of its own and then commits: it adds a pointer, the next
by number, that lists which folder holds which bucket. Readers of an older pointer are not disturbed, and a writer that
fails leaves nothing behind that is read.

Commits are optimistic. A pointer's number is taken by one writer only; who comes second reads the new pointer. If the
buckets that it has read are as they were, its own take their place beside those of the other; else ``Stale`` is raised
and the load is merged anew with what is there. So vendors load side by side and no load is lost.

An upsert writes its rows down once with a digest of what can change, compares digests with those stored, and rewrites
the buckets of rows that are new or differ. The stored rows are not exchanged where the changed ones are small enough to
be sent to them. A load that changes nothing writes nothing. A large one that changes most of its rows, as some of the
hashes tell, is put over the stored ones some buckets at a time, in one exchange by bucket, so a file holds much of one.

Every attribute key has a column of its own, with a dictionary or a Bloom filter in each row group, up to KEYS of them
in a folder; ``read`` returns those that are asked for, so that equality on any key is left to the scan.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricewright.plans.runs import REAP_AFTER, created, published
from pricewright.schema import HOT_KEYS, PRODUCT

BATCH = 1_000
#: Ranges of hashes that a service is cut into, and digits of a hash that tell its range.
BUCKETS, DIGITS = 4, 2
#: Bytes of changed rows that may be sent to the stored ones, and columns of attribute keys in a folder.
SENT_BYTES, KEYS = 8 << 20, 400
#: Bytes in a row group and in a Bloom filter of it, and rows in a page: what a lookup reads at least.
GROUP_BYTES, BLOOM_BYTES, PAGE_ROWS = 1 << 20, 32 << 10, 1_000
#: Bytes of a written load that a task sorts at once: rows are some ten times as large in memory as in a file.
SPLIT_BYTES, _SPLIT = 64 << 20, "spark.sql.files.maxPartitionBytes"
_splitting = threading.RLock()
#: Bytes of a written load that meet the stored rows at once and in one task, and one part in how many of hashes is looked at first.
MERGED_BYTES, TASK_BYTES, SLICES = 512 << 20, 8 << 20, 16
#: Whether files of a shuffle go when its query ends, not when the driver collects garbage; and writers at work, by session.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_clearing: dict[SparkSession, tuple[int, str]] = {}
_clearing_lock = threading.Lock()
#: How often a load is merged anew when others commit to its buckets.
ATTEMPTS = 20
#: A folder's rows. Read with it, a service or vendor of digits stays text.
STORED = T.StructType([*PRODUCT.fields, T.StructField("updated_at", T.TimestampType()), T.StructField("content", T.StringType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(f"attr_{k}", T.StringType()) for k in HOT_KEYS)])
Part = tuple[str, str, int]


class Stale(RuntimeError):
    """Another writer has committed to buckets that this one has read."""


def _bounds(buckets: int) -> list[str]:
    return [format(i * 16**DIGITS // buckets, f"0{DIGITS}x") for i in range(1, buckets)]


def bucket(buckets: int, key: str = "product_hash") -> Column:
    """The number of a hash's range; in the order of hashes, whatever their signs."""
    bounds = _bounds(buckets)
    return sum((F.col(key) >= b).cast("int") for b in bounds) if bounds else F.lit(0)


def content() -> Column:
    """A digest of what an upsert compares: sku, attributes in any order, prices in order."""
    return F.substring(F.sha2(F.to_json(F.struct("sku", F.array_sort(F.map_entries("attributes")).alias("a"), "prices")), 256), 1, 32)


def key_column(key: str) -> str:
    """The name of an attribute's own column, for keys with any signs in any case."""
    return f"attr_{key}" if key in HOT_KEYS else f"key_{key.encode().hex()}"


def canonical(products: DataFrame) -> DataFrame:
    """Prices in the order of their fields, so that two loads of the same prices are equal."""
    return products.withColumn("prices", F.array_sort("prices"))


def first_in_batches(rows: DataFrame, order: str = "ord", batch: int = BATCH) -> DataFrame:
    """One row per product of an ordered load: the first of a batch, of the last batch that has it."""
    number = F.floor(F.col(order) / batch)
    place = F.row_number().over(Window.partitionBy("product_hash").orderBy(number.desc(), order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n", order)


def one_per_product(products: DataFrame) -> DataFrame:
    """One row per product of a load without an order: the first by sku, family and prices, whatever the partitions."""
    place = F.row_number().over(Window.partitionBy("product_hash").orderBy("sku", "product_family", "prices"))
    return products.withColumn("_n", place).where("_n = 1").drop("_n")


def last_batch(products: DataFrame, batch: str = "batch") -> DataFrame:
    """One row per product of a run: of the last batch that has it, the first as in ``one_per_product``."""
    place = F.row_number().over(Window.partitionBy("product_hash").orderBy(F.desc(batch), "sku", "product_family", "prices"))
    return products.withColumn("_n", place).where("_n = 1").drop("_n", batch)


def changed(old: str = "o", new: str = "n") -> Column:
    """Whether a product's sku, attributes (in any order) or prices (in order) differ; null equals null."""
    entries = lambda t: F.array_sort(F.map_entries(f"{t}.attributes"))
    return ~(F.col(f"{old}.sku").eqNullSafe(F.col(f"{new}.sku")) & entries(old).eqNullSafe(entries(new)) & F.col(f"{old}.prices").eqNullSafe(F.col(f"{new}.prices")))


def merged(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``old`` (with updated_at) after an upsert of ``new``: a product that changed takes the new sku, attributes and
    prices, and ``now``; one that did not stays as it is, its time included; identity columns are never rewritten."""
    both = old.alias("o").join(new.alias("n"), "product_hash", "full_outer").withColumn("_had", F.col("o.sku").isNotNull()).withColumn("_has", F.col("n.sku").isNotNull())
    take = F.col("_has") & (~F.col("_had") | changed())
    pick = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    identity = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("vendor_name", "region", "service", "product_family")]
    return both.select("product_hash", pick("sku"), *identity, pick("attributes"), pick("prices"), F.when(take, now).otherwise(F.col("o.updated_at")).alias("updated_at"))


def stale(products: DataFrame, vendor: str, start: Column, seen: DataFrame) -> DataFrame:
    """A vendor's products that were last written before ``start`` and that the run has not seen."""
    return products.where((F.col("vendor_name") == vendor) & (F.col("updated_at") < start)).join(seen, "product_hash", "left_anti")


def without_stale(products: DataFrame, vendor: str, start: Column, seen: DataFrame) -> DataFrame:
    return products.join(stale(products, vendor, start, seen).select("product_hash"), "product_hash", "left_anti")


def mark_seen(seen: DataFrame, run_id: int, products: DataFrame) -> DataFrame:
    """``seen`` (run_id, product_hash) with the products of a run; a run id of 0 or less marks nothing."""
    if run_id <= 0:
        return seen
    return seen.unionByName(products.select(F.lit(run_id).cast("long").alias("run_id"), "product_hash")).distinct()


def clear_seen(seen: DataFrame, run_id: int, runs: DataFrame) -> DataFrame:
    """Only marks of other runs that are still running stay."""
    running = runs.where("status = 'running'").select(F.col("id").alias("run_id"))
    return seen.where(F.col("run_id") != run_id).join(running, "run_id", "left_semi")


def snapshots(products: DataFrame, run_id: int, now: Column) -> DataFrame:
    """Rows of the price history of a run."""
    return products.select(F.lit(run_id).cast("long").alias("scrape_run_id"), "product_hash", "prices", now.alias("recorded_at"))


@contextmanager
def _splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in pieces of at most SPLIT_BYTES. Writers of one session take turns, as the setting is the session's."""
    with _splitting:
        before = spark.conf.get(_SPLIT)
        spark.conf.set(_SPLIT, str(min(SPLIT_BYTES, _bytes(spark, before))))
        try:
            yield
        finally:
            spark.conf.set(_SPLIT, before)


@contextmanager
def _cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffles of a session's writers leave no files behind; the setting is as before when the last of them ends."""
    with _clearing_lock:
        n, before = _clearing.get(spark) or (0, spark.conf.get(_CLEANUP, "false"))
        _clearing[spark] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _clearing_lock:
            n, before = _clearing.pop(spark)
            if n > 1:
                _clearing[spark] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def _among(parts: Iterable[Part]) -> Column:
    """Whether a row is of one of the parts."""
    vendors: dict[str, dict[str, list[int]]] = {}
    for vendor, service, b in sorted(parts):
        vendors.setdefault(vendor, {}).setdefault(service, []).append(b)
    mine = []
    for vendor, services in vendors.items():
        alike: dict[tuple[int, ...], list[str]] = {}
        for service, buckets in services.items():
            alike.setdefault(tuple(buckets), []).append(service)
        mine += [(F.col("vendor_name") == vendor) & F.col("service").isin(*names) & F.col("bucket").isin(*buckets) for buckets, names in alike.items()]
    return reduce(lambda a, b: a | b, mine)


def _bytes(spark: SparkSession, text: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


class SeenSets:
    """Which products each run has seen: a folder of hashes for each, appended to batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def ids(self) -> list[int]:
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._at("")) if "=" in s.getPath().getName()) if self._fs.exists(self._at("")) else []

    def mark(self, run_id: int, products: DataFrame) -> None:
        if run_id > 0:
            products.select("product_hash").distinct().write.mode("append").parquet(f"{self.path}/run_id={run_id}")

    def read(self, run_id: int | None = None) -> DataFrame:
        """run_id and product_hash of one run, or of all."""
        ids = [i for i in self.ids() if run_id in (None, i)]
        none = self.spark.createDataFrame([], "run_id long, product_hash string")
        marks = [self.spark.read.schema("product_hash string").parquet(f"{self.path}/run_id={i}").select(F.lit(i).cast("long").alias("run_id"), "product_hash") for i in ids]
        return union([none, *marks]).distinct()

    def clear(self, run_id: int, running: set[int]) -> None:
        """Only marks of other runs that are still running stay."""
        for i in self.ids():
            if i == run_id or i not in running:
                self._fs.delete(self._at(f"run_id={i}"), True)


class ProductStore:
    """The products of a directory. Any number of writers; ``locked`` keeps a vendor's runs apart."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.owner, self.buckets = spark, path.rstrip("/"), uuid.uuid4().hex, buckets
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The current version, 0 before the first."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        pointers = self._at("_current")
        if not self._fs.exists(pointers):
            return []
        return sorted(int(n) for s in self._fs.listStatus(pointers) if (n := s.getPath().getName()).isdigit())

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        """A version, and what its pointer says: the number of buckets, the folder of each part, and each folder's keys."""
        n = self.version() if version is None else version
        if not n:
            return 0, {"buckets": self.buckets, "parts": {}, "keys": {}}
        said = json.loads(self.spark.read.text(f"{self.path}/_current/{n}", wholetext=True).first().value)
        return n, {**said, "parts": {tuple(k): f for k, f in said["parts"]}}

    def manifest(self, version: int | None = None) -> list[tuple[str, str, str, int]]:
        """Which folder holds each bucket of a vendor's service."""
        return sorted((f, *part) for part, f in self._state(version)[1]["parts"].items())

    def read(self, keys: Iterable[str] = ()) -> DataFrame:
        """The current products, with the columns of ``keys`` beside those of HOT_KEYS."""
        state = self._state()[1]
        return self._rows(state, state["parts"], tuple(k for k in dict.fromkeys(keys) if k not in HOT_KEYS))

    def in_order(self, vendor: str, service: str, keys: Iterable[str] = (), after: str | None = None, at_once: int = 1) -> Iterator[DataFrame]:
        """The rows of a vendor's service in one version, cut by ranges of hashes in their order, from the range that
        ``after`` falls into: ``at_once`` buckets, then as many as have been given before. Only what is asked for is read."""
        state = self._state()[1]
        first = sum(after >= b for b in _bounds(state["buckets"])) if after else 0
        mine = sorted(p for p in state["parts"] if p[:2] == (vendor, service) and p[2] >= first)
        own, step, given = tuple(k for k in dict.fromkeys(keys) if k not in HOT_KEYS), max(1, at_once), 0
        while mine:
            yield self._rows(state, mine[:step], own)
            mine, given = mine[step:], given + step
            step = given

    def _rows(self, state: dict, parts: Iterable[Part], keys: tuple[str, ...] = ()) -> DataFrame:
        held: dict[str, list[Part]] = {}
        for part in sorted(parts):
            if f := state["parts"].get(part):
                held.setdefault(f, []).append(part)
        wanted = T.StructType([*STORED.fields, *(T.StructField(key_column(k), T.StringType()) for k in keys)])
        if not held:
            return self.spark.createDataFrame([], wanted)
        found = []
        for folder, mine in held.items():
            has = state["keys"][folder]
            schema = wanted if has is not None else STORED
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").where(_among(mine))
            if has is None:  # too many keys for columns: they are looked up in the map
                rows = rows.withColumns({key_column(k): F.col("attributes")[k] for k in keys})
            found.append(rows.select(*wanted.fieldNames()))
        return union(found)

    def plain(self) -> DataFrame:
        """The current products without the columns of attributes."""
        return self.read().select(*PRODUCT.fieldNames(), "updated_at")

    def _keys(self, base: dict, parts: Iterable[Part], more: DataFrame | None = None) -> list[str] | None:
        """The attribute keys of the parts, and of ``more``, those of HOT_KEYS that are there too; None for over KEYS others."""
        known = [base["keys"][f] for f in {base["parts"][p] for p in parts if p in base["parts"]}]
        if None in known:
            return None
        rows = [] if more is None else more.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().limit(KEYS + len(HOT_KEYS) + 1).collect()
        keys = sorted({k for ks in known for k in ks} | {r.k for r in rows})
        return None if len(set(keys) - set(HOT_KEYS)) > KEYS else keys

    def _put(self, rows: DataFrame, keys: list[str] | None, folder: str | None = None) -> str:
        """Writes rows (of STORED, without columns of attributes) into a new folder, or adds them to one, and returns its name.
        A column that holds nothing has no Bloom filter: it would be as large as any."""
        folder = folder or f"v-{uuid.uuid4().hex}"
        own = {key_column(k): F.col("attributes")[k] for k in dict.fromkeys([*HOT_KEYS, *(keys or ())])}
        out = rows.sortWithinPartitions("vendor_name", "service", "bucket", "region", "product_hash").withColumns(own).write.mode("append").option("compression", "zstd")
        out = out.option("parquet.block.size", GROUP_BYTES).option("parquet.bloom.filter.max.bytes", BLOOM_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        for k in HOT_KEYS if keys is None else keys:
            out = out.option(f"parquet.bloom.filter.enabled#{key_column(k)}", "true")
        out.partitionBy("vendor_name", "service", "bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, base: tuple[int, dict], touched: set[Part], rows: DataFrame | Iterable[DataFrame], keys: list[str] | None, emptied: set[Part] = frozenset()) -> int:
        """A new version in which ``rows``, if they are several written one after another, take the place of the parts ``touched``, read at ``base``, of which those
        ``emptied`` go. What others have committed since to other parts stays; ``Stale`` if it was to these."""
        folder = None
        if touched != emptied:
            for some in [rows] if isinstance(rows, DataFrame) else rows:
                folder = self._put(some, keys, folder)
        made = dict.fromkeys(touched - emptied, folder)
        try:
            while True:
                n, state = self._state()
                if any(state["parts"].get(p) != base[1]["parts"].get(p) for p in touched):
                    raise Stale(f"version {n} holds other rows of what was read at version {base[0]}")
                parts = {p: f for p, f in state["parts"].items() if p not in touched} | made
                listed = {f: k for f, k in {**state["keys"], folder: keys}.items() if f in parts.values()}
                said = {"buckets": state["buckets"], "parts": sorted([list(p), f] for p, f in parts.items()), "keys": listed}
                if published(self._fs, self._at, "_current", n + 1, json.dumps(said)):
                    return n + 1
        except BaseException:
            if folder is not None:
                self._fs.delete(self._at(folder), True)
            raise

    def upsert(self, products: DataFrame, now: Column, folders: int = 64) -> int:
        """The version after the load; the same as before if nothing of it is new or changed. A product's hash names
        its vendor and service, so only buckets of the load can hold its old rows. Over ``folders`` folders become one."""
        with _cleared(self.spark):
            return self._upsert(products, now, folders)

    def _upsert(self, products: DataFrame, now: Column, folders: int) -> int:
        load = f"_staged/{uuid.uuid4().hex}"
        try:
            held = canonical(products).select(*PRODUCT.fieldNames()).withColumns({"content": content(), "bucket": bucket(self._state()[1]["buckets"])})
            held.write.option("compression", "zstd").parquet(f"{self.path}/{load}/load")
            held = self.spark.read.schema(held.schema).parquet(f"{self.path}/{load}/load")
            for attempt in range(ATTEMPTS):
                try:
                    n = self._merge(held, now, f"{load}/{attempt}", self._size(f"{load}/load"))
                    break
                except Stale:
                    if attempt == ATTEMPTS - 1:
                        raise
        finally:
            self._fs.delete(self._at(load), True)
        base = self._state()
        if len(set(base[1]["parts"].values())) <= folders:
            return n
        try:
            return self._commit(base, set(base[1]["parts"]), self._rows(base[1], base[1]["parts"]).select(*self._own()), self._keys(base[1], base[1]["parts"]))
        except Stale:
            return n  # the next load will find as many

    @staticmethod
    def _own() -> list[str]:
        return [c for c in STORED.fieldNames() if not c.startswith("attr_")]

    def _sent(self, rows: DataFrame, at: str) -> DataFrame:
        """``rows``, which the folder ``at`` holds, marked to be sent to the other side of a join if they are small."""
        return F.broadcast(rows) if self._size(at) <= SENT_BYTES else rows

    def _size(self, at: str) -> int:
        return self._fs.getContentSummary(self._at(at)).getLength()

    @staticmethod
    def _parts(rows: DataFrame) -> set[Part]:
        return {(r.vendor_name, r.service, r.bucket) for r in rows.select("vendor_name", "service", "bucket").distinct().collect()}

    def _changes(self, base: dict, held: DataFrame, parts: set[Part] | None = None) -> DataFrame:
        """Rows of the load that are new or differ, with _had: the stored side gives two columns of the load's parts."""
        parts = self._parts(held) if parts is None else parts
        old = self._rows(base, parts).select("product_hash", F.col("content").alias("_content"))
        both = held.join(old, "product_hash", "left")
        return both.where(~F.col("_content").eqNullSafe(F.col("content"))).withColumn("_had", F.col("_content").isNotNull()).drop("_content")

    def _after(self, base: dict, delta: DataFrame, touched: set[Part], now: Column) -> DataFrame:
        """The rows of the touched parts after the load: stored ones with what the load changes of them, and new ones.
        Identity columns are never rewritten."""
        new = delta.where("_had").select("product_hash", *(F.col(c).alias(f"_{c}") for c in ("sku", "attributes", "prices", "content")))
        old = self._rows(base, touched).select(*self._own()).join(new, "product_hash", "left")
        take = lambda c: F.when(F.col("_content").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        picks = {c: take(c) for c in ("sku", "attributes", "prices", "content")} | {"updated_at": F.when(F.col("_content").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at")}
        fresh = delta.where("not _had").withColumn("updated_at", now).select(*self._own())
        return old.select(*(picks.get(c, F.col(c)) for c in self._own())).unionByName(fresh)

    def _replaced(self, base: dict, held: DataFrame, parts: set[Part]) -> dict[Part, int] | None:
        """The load's rows of some hashes, by part, if at least half of them are new or differ and each part has such; else None."""
        some = F.xxhash64("product_hash") % SLICES == 0
        old = self._rows(base, parts).where(some).select("product_hash", F.col("content").alias("_content"))
        both = held.where(some).select("product_hash", "vendor_name", "service", "bucket", "content").join(old, "product_hash", "left")
        differs = F.count_if(~F.col("_content").eqNullSafe(F.col("content")))
        counts = both.groupBy("vendor_name", "service", "bucket").agg(F.count(F.lit(1)).alias("n"), differs.alias("differ")).where("differ > 0").collect()
        found = {(r.vendor_name, r.service, r.bucket): r.n for r in counts}
        return found if found.keys() == parts and 2 * sum(r.differ for r in counts) >= sum(found.values()) else None

    def _over(self, base: dict, held: DataFrame, counts: dict[Part, int], size: int, now: Column) -> Iterator[DataFrame]:
        """The rows of parts of ``counts`` after the load, some parts at a time; the same rows as of ``_after``."""
        some, most = [], MERGED_BYTES * sum(counts.values()) / size
        for part in sorted(counts):
            if some and sum(counts[p] for p in [*some, part]) > most:
                yield self._laid(base, held, some, -(-MERGED_BYTES // (TASK_BYTES * len(some))), now)
                some = []
            some.append(part)
        yield self._laid(base, held, some, -(-min(size, MERGED_BYTES) // (TASK_BYTES * len(some))), now)

    def _laid(self, base: dict, held: DataFrame, parts: list[Part], cuts: int, now: Column) -> DataFrame:
        """Stored and loaded rows of some parts, exchanged once, each part in ``cuts`` by hash. A product's loaded row stays, with
        what the stored one says of identity and, if the two are equal, of time; a stored one stays if none is loaded."""
        at = ("vendor_name", "service", "bucket", "_cut")
        new = held.where(_among(parts)).withColumn("updated_at", now).select(*self._own(), F.lit(True).alias("_new"))
        old = self._rows(base, parts).select(*self._own(), F.lit(False).alias("_new"))
        both = new.unionByName(old).withColumn("_cut", F.pmod(F.xxhash64("product_hash"), F.lit(cuts))).repartition(*at)
        product = Window.partitionBy("product_hash", *at)
        stored = F.max(F.when(~F.col("_new"), F.struct("content", "region", "product_family", "updated_at"))).over(product)
        both = both.withColumns({"_old": stored, "_loaded": F.max("_new").over(product)}).where("_new or not _loaded")
        kept = {c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in ("region", "product_family")}
        same = F.coalesce(F.col("_old.content") == F.col("content"), F.lit(False))
        return both.withColumns(kept | {"updated_at": F.when(same, F.col("_old.updated_at")).otherwise(F.col("updated_at"))}).select(*self._own())

    def _merge(self, held: DataFrame, now: Column, at: str, size: int = 0) -> int:
        base, parts = self._state(), self._parts(held)
        if parts.isdisjoint(base[1]["parts"]):  # all of it is new: nothing to compare
            if not parts:
                return base[0]
            keys = self._keys(base[1], parts, held)
            with _splits(self.spark):
                return self._commit(base, parts, held.withColumn("updated_at", now).select(*self._own()), keys)
        if size > SENT_BYTES and (counts := self._replaced(base[1], held, parts)):
            return self._commit(base, parts, self._over(base[1], held, counts, size, now), self._keys(base[1], parts, held))
        self._changes(base[1], held, parts).write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        delta = self.spark.read.schema(T.StructType([*held.schema.fields, T.StructField("_had", T.BooleanType())])).parquet(f"{self.path}/{at}")
        touched = self._parts(delta)
        if not touched:
            return base[0]
        return self._commit(base, touched, self._after(base[1], self._sent(delta, at), touched, now), self._keys(base[1], touched, delta))

    def delete_stale(self, vendor: str, start: Column, seen: DataFrame) -> int:
        """Deletes and counts; only buckets that hold something stale are written anew."""
        for attempt in range(ATTEMPTS):
            at = f"_staged/{uuid.uuid4().hex}"
            try:
                base = self._state()
                mine = {p for p in base[1]["parts"] if p[0] == vendor}
                old = stale(self._rows(base[1], mine), vendor, start, seen.select("product_hash").distinct()).select("product_hash", "vendor_name", "service", "bucket")
                old.write.parquet(f"{self.path}/{at}")
                gone = self.spark.read.schema(old.schema).parquet(f"{self.path}/{at}")
                counts = {(r.vendor_name, r.service, r.bucket): r["count"] for r in gone.groupBy("vendor_name", "service", "bucket").count().collect()}
                if counts:
                    there = self._rows(base[1], counts).select(*self._own())
                    emptied = {tuple(p) for *p, n in there.groupBy("vendor_name", "service", "bucket").count().collect() if counts[tuple(p)] == n}
                    left = there.join(self._sent(gone.select("product_hash"), at), "product_hash", "left_anti")
                    self._commit(base, set(counts), left, self._keys(base[1], counts), emptied)
                return sum(counts.values())
            except Stale:
                if attempt == ATTEMPTS - 1:
                    raise
            finally:
                self._fs.delete(self._at(at), True)
        return 0

    def count(self) -> int:
        return self.read().count()

    def locked(self, vendor: str, now: datetime | None = None, after: timedelta = REAP_AFTER) -> bool:
        """Takes the vendor's lock; False if another holds it. One that was taken or renewed longer than ``after`` ago has
        been left behind and is taken over. A store that cannot be reached is an error, not a lock."""
        now, lock = now or datetime.now(), self._at(f"_locks/{vendor}")
        self._fs.mkdirs(self._at("_locks"))
        if created(self._fs, lock, self._claim(now)):
            return True
        held = self._holder(vendor)
        if held and now - datetime.fromisoformat(held["at"]) <= after:
            return False
        aside = self._at(f"_locks/_{uuid.uuid4().hex}")  # only one of those who find it can move it
        if not self._fs.rename(lock, aside):
            return False
        self._fs.delete(aside, False)
        return created(self._fs, lock, self._claim(now))

    def _claim(self, now: datetime) -> str:
        return json.dumps({"owner": self.owner, "at": now.isoformat()})

    def _holder(self, vendor: str) -> dict | None:
        if not self._fs.exists(self._at(f"_locks/{vendor}")):
            return None
        try:
            rows = self.spark.read.text(f"{self.path}/_locks/{vendor}", wholetext=True).collect()
            return json.loads(rows[0].value) if rows else None
        except ValueError:
            return None

    def hold(self, vendor: str, now: datetime) -> bool:
        """Takes the vendor's lock, or renews it where it is this owner's; False if another holds it."""
        held = self._holder(vendor)
        if held and held["owner"] == self.owner:
            self.renew(vendor, now)
            return True
        return self.locked(vendor, now)

    def renew(self, vendor: str, now: datetime) -> None:
        """Tells that the holder is still there."""
        out = self._fs.create(self._at(f"_locks/{vendor}"), True)
        out.write(bytearray(self._claim(now).encode()))
        out.close()

    def unlock(self, vendor: str) -> None:
        """Gives back a lock that this store took."""
        if (held := self._holder(vendor)) is None or held["owner"] == self.owner:
            self._fs.delete(self._at(f"_locks/{vendor}"), False)

    def drop_folders(self) -> None:
        """Deletes the folders that only versions before the last have listed. Their pointers stay, so that no number is given
        twice while others write."""
        *old, last = self._versions() or [0]
        for f in {f for n in old for f, *_ in self.manifest(n)} - {f for f, *_ in self.manifest(last)}:
            self._fs.delete(self._at(f), True)

    def drop_versions(self, keep: int = 2) -> None:
        """Deletes all pointers but the last ``keep``, and the folders that only those have listed; a folder that no
        pointer lists may be another writer's and stays."""
        versions = self._versions()
        last, old = versions[-keep:], versions[:-keep] if keep else versions
        used = {f for n in last for f, *_ in self.manifest(n)}
        unused = {f for n in old for f, *_ in self.manifest(n)} - used
        for n in old:
            self._fs.delete(self._at(f"_current/{n}"), False)
        for f in unused:
            self._fs.delete(self._at(f), True)


def union(batches: Iterable[DataFrame]) -> DataFrame:
    """All batches, one after another."""
    found = None
    for b in batches:
        found = b if found is None else found.unionByName(b)
    if found is None:
        raise ValueError("no batches")
    return found

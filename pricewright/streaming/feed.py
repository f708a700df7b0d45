"""Runs of vendors over a stream: what a run has seen is kept as state, and its end is guarded as that of any run.

A feed is a stream of rows (FEED): a product of a run, or the end of a run, which has a number of failed services and no
product. A run is a vendor and the time at which it started; its products carry that time as ``updated_at``, so a batch
that is repeated after a failure writes the same.

The state is cut by ranges of product hashes, so no run is one group: each part of a run holds the hashes it
has seen, a list of them for each chunk of rows, and a count. At the end of the run, the parts give their hashes back and are cleared; a part whose run does not
end within ``life`` is cleared, too, and its run has failed. Prices and attributes pass as text and are not looked into.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pricewright.engine import KEPT_VERSIONS, Engine
from pricewright.plans import runs, store
from pricewright.schema import PRODUCT

#: A row of a feed. ``failed`` is null but in the row that ends a run.
FEED = T.StructType([T.StructField("vendor", T.StringType()), T.StructField("started", T.TimestampType()), T.StructField("failed", T.IntegerType()), T.StructField("product", PRODUCT)])
#: What comes out of the state: products as they came in, and of a run that is over its counts and its hashes, by parts.
OUT = "kind string, vendor string, started long, product_hash string, payload string, ingested long, failed int"
PARTS = 64
#: Stores that hold the state, at most: a run has no more parts than PARTS, and each store is opened in each micro-batch.
STORES = 32
LOST = "reaped: the feed did not end in time"
_SHUFFLE = "spark.sql.shuffle.partitions"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """Of a part of a run: the hashes it has seen, how many rows they came in, and when it is given up."""

    def __init__(self, life: timedelta):
        self.life = int(life.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hashes = handle.getListState("hashes", "product_hash array<string>")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vendor, started, _ = key
        n, failed = 0, None
        for chunk in rows:
            ends, here = chunk[chunk.failed.notna()], chunk[chunk.failed.isna()]
            if len(ends):
                failed = max(int(ends.failed.max()), failed or 0)
            if len(here):
                n += len(here)
                self.hashes.appendValue((here.product_hash.unique().tolist(),))
                yield _rows("product", vendor, started, product_hash=here.product_hash.to_list(), payload=here.payload.to_list())
        known = self.count.get()[0] if self.count.exists() else None
        if failed is not None:
            yield from self._over("end", vendor, started, n + (known or 0), failed)
        elif n:
            if known is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.life)
            self.count.update((n + (known or 0),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            yield _rows("lost", key[0], key[1], product_hash=[None])
            self.hashes.clear()
            self.count.clear()

    def _over(self, kind: str, vendor: str, started: int, n: int, failed: int) -> Iterator[pd.DataFrame]:
        yield _rows(kind, vendor, started, product_hash=[None], ingested=n, failed=failed)
        for (held,) in self.hashes.get() if self.hashes.exists() else ():
            yield _rows("seen", vendor, started, product_hash=list(held))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.hashes.clear()
        self.count.clear()

    def close(self) -> None:
        pass


def _rows(kind: str, vendor: str, started: int, product_hash: list, payload: list | None = None, ingested: int | None = None, failed: int | None = None) -> pd.DataFrame:
    size = len(product_hash)
    held = {"kind": [kind] * size, "vendor": [vendor] * size, "started": [started] * size, "product_hash": product_hash, "payload": payload or [None] * size}
    return pd.DataFrame(held | {"ingested": pd.array([ingested] * size, "Int64"), "failed": pd.array([failed] * size, "Int32")}).astype({"product_hash": object, "payload": object})


def remembered(feed: DataFrame, life: timedelta = runs.REAP_AFTER, parts: int = PARTS) -> DataFrame:
    """The rows of a feed through the state (OUT). Rows without a vendor or a start belong to no run, and products without
    a hash are none; both are left out. Rows that come after their run's end are products without a run."""
    ends = F.col("failed").isNotNull()
    rows = feed.where("vendor is not null and started is not null and (failed is not null or product.product_hash is not null)")
    number = F.when(ends, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("product.product_hash"), F.lit(parts)).cast("int")))
    payload = F.when(~ends, F.to_json("product", {"ignoreNullFields": "false"}))
    narrow = rows.select("vendor", F.unix_micros("started").alias("started"), F.explode(number).alias("part"), "failed", F.when(~ends, F.col("product.product_hash")).alias("product_hash"), payload.alias("payload"))
    return narrow.groupBy("vendor", "started", "part").transformWithStateInPandas(statefulProcessor=Seen(life), outputStructType=T._parse_datatype_string(OUT), outputMode="Append", timeMode="ProcessingTime")


class Feed:
    """A feed loaded into an engine: runs are begun, products stored, and what an ended run has not seen is deleted, under
    the guards of any run. A repeated batch changes nothing; where it had deleted before it failed, its run tells 0."""

    def __init__(self, engine: Engine, checkpoint: str, life: timedelta = runs.REAP_AFTER, parts: int = PARTS):
        self.engine, self.checkpoint, self.life, self.parts = engine, checkpoint, life, parts
        engine.store.owner = checkpoint  # begun again, the stream holds the locks that it held

    def start(self, feed: DataFrame, once: bool = True) -> StreamingQuery:
        conf = feed.sparkSession.conf
        before = {k: conf.get(k, None) for k in (_STORE, _SHUFFLE, "spark.sql.streaming.noDataMicroBatches.enabled")}
        conf.set(_STORE, _ROCKS)
        conf.set(_SHUFFLE, str(min(int(conf.get(_SHUFFLE)), self.parts, STORES)))  # of the stream alone, which takes a copy
        if once:  # else the last batch would ask for another, for its timers, without end
            conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        try:
            out = remembered(feed, self.life, self.parts).writeStream.foreachBatch(self.handle).outputMode("append").option("checkpointLocation", self.checkpoint)
            return (out.trigger(availableNow=True) if once else out).start()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def handle(self, batch: DataFrame, _: int) -> None:
        """Runs of a micro-batch in the order of their starts. The batch is written down first: it changes the state, so it
        must not be made twice."""
        at = f"{self.engine.path}/staged/{uuid.uuid4().hex}"
        try:
            batch.write.parquet(at)
            rows = self.engine.spark.read.schema(OUT).parquet(at)
            kind = lambda k: F.count_if(F.col("kind") == k).alias(k)
            found = rows.groupBy("vendor", "started").agg(kind("product"), kind("end"), kind("lost"), F.sum("ingested").alias("ingested"), F.max("failed").alias("failed"))
            for r in found.orderBy("started", "vendor").collect():  # a row a run
                self._of_run(r, rows.where((F.col("vendor") == r.vendor) & (F.col("started") == r.started)))
        finally:
            self.engine.delete(at)

    def _of_run(self, r, rows: DataFrame) -> None:
        engine, now = self.engine, self.engine.clock()
        began = F.timestamp_micros(F.lit(r.started))
        if not engine.store.hold(r.vendor, now):
            raise RuntimeError(f"another run of {r.vendor} is loading")
        run_id, running = self._opened(r.vendor, r.started)
        if r["product"]:
            products = rows.where("kind = 'product'").select(F.from_json("payload", PRODUCT).alias("p")).select("p.*")
            engine.store.upsert(store.one_per_product(products), began)
        if not (r["end"] or r["lost"]):
            return
        if running and r["end"]:
            mine = rows.where("kind = 'seen'").select("product_hash").distinct()
            if runs.empty_run(r.ingested):
                engine.finish(run_id, "failed", 0, 0, "no products")
            else:
                engine.finish(run_id, "success", r.ingested, engine.clean_up(r.vendor, began, r.ingested, r.failed, mine))
        elif running:
            engine.finish(run_id, "failed", 0, 0, LOST)
        engine.store.drop_versions(KEPT_VERSIONS)
        engine.store.unlock(r.vendor)

    def _opened(self, vendor: str, started: int) -> tuple[int, bool]:
        """The run's id in the ledger, where it is entered unless it is there, and whether it is running."""
        at = datetime.fromtimestamp(started // 10**6) + timedelta(microseconds=started % 10**6)
        known = (F.col("vendor") == vendor) & (F.col("started_at") == F.lit(at).cast("timestamp"))

        def entered(ledger: DataFrame, n: int) -> tuple[DataFrame, int]:
            there = ledger.where(known).first()
            return (ledger, there.id) if there else runs.start(ledger, vendor, at, n)

        there = self.engine.runs.where(known).first()
        if there:
            return there.id, there.status == "running"
        return self.engine.ledger.update(entered), True

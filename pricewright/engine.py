"""The engine: load batches, clean up, look up, report. Holds a store of products and a ledger of runs."""

from __future__ import annotations

import logging
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.config import Settings
from pricewright.model import BudgetSpent, PriceFilter, ProductFilter
from pricewright.plans import metrics, query, runs, store
from pricewright.schema import PRODUCT
from pricewright.sources import landed

BUDGET = 5_000
#: Versions of the table that stay after a run: lookups that have begun still read theirs.
KEPT_VERSIONS = 8
LATE = "query timeout exceeded"
#: The batches of a run, as they are kept until they are loaded.
STAGED = T.StructType([*PRODUCT.fields, T.StructField("batch", T.IntegerType())])


class Source(Protocol):
    """A vendor's extractor: its name, its batches of products, and how many of its services failed."""

    name: str

    def batches(self, spark: SparkSession) -> Iterable[DataFrame]: ...

    def failed_services(self) -> int: ...


class Budget:
    """Products that one request may return in all: reserved before a lookup, what was not used comes back."""

    def __init__(self, products: int = BUDGET, queries: int | None = None):
        self.left, self.queries = products, queries

    def reserve(self, limit: int | None) -> int:
        if self.queries is not None:
            if self.queries == 0:
                raise BudgetSpent("too many lookups in one request")
            self.queries -= 1
        n = min(query.effective_limit(limit), self.left)
        if n <= 0:
            raise BudgetSpent("the request's products are spent")
        self.left -= n
        return n

    def refund(self, reserved: int, used: int) -> None:
        self.left += reserved - used


class Deadline:
    """A time that all requests of a batch share: what has not begun by then does not begin, and what runs is cancelled."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.tag = spark.sparkContext, f"lookup-{uuid.uuid4().hex}"
        self.at = None if seconds is None else time.monotonic() + seconds
        self._timer: threading.Timer | None = None

    def passed(self) -> bool:
        return self.at is not None and time.monotonic() >= self.at

    def __enter__(self) -> Deadline:
        if self.at is not None:
            self.context.addJobTag(self.tag)
            self._timer = threading.Timer(max(0.0, self.at - time.monotonic()), self.context.cancelJobsWithTag, [self.tag])
            self._timer.daemon = True
            self._timer.start()
        return self

    def __exit__(self, *_: object) -> None:
        if self._timer is not None:
            self._timer.cancel()
            self.context.removeJobTag(self.tag)


class Engine:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None), settings: Settings | None = None):
        self.spark, self.clock, self.settings = spark, clock, settings or Settings()
        self.store = store.ProductStore(spark, f"{path}/products")
        self.path = path
        self.ledger = runs.Ledger(spark, f"{path}/runs")
        self._seen = store.SeenSets(spark, f"{path}/seen")
        self.metrics = metrics.Metrics(spark, f"{path}/metrics")

    @classmethod
    def of(cls, spark: SparkSession, settings: Settings) -> Engine:
        """An engine on the folder that the settings name."""
        return cls(spark, settings.checked().path, settings=settings)

    @property
    def runs(self) -> DataFrame:
        return self.ledger.read()

    @property
    def seen(self) -> DataFrame:
        return self._seen.read()

    def budget(self) -> Budget:
        """What one request may take by the settings."""
        return Budget(self.settings.products_per_request, self.settings.lookups_per_request)

    def seed(self, products: DataFrame) -> int:
        """Loads products outside any run: the next clean run of their vendor deletes those it does not bring."""
        return self.store.upsert(products, F.lit(self.clock()).cast("timestamp"))

    def reap(self) -> None:
        """Runs that were left running too long have failed: to be called now and then, and before each run."""
        now = F.lit(self.clock()).cast("timestamp")
        if not runs.reaped(self.runs, now).exceptAll(self.runs).isEmpty():
            self.ledger.update(lambda ledger, _: (runs.reaped(ledger, now), 0))

    def ingest(self, source: Source, snapshots: bool | None = None) -> tuple[int, str, int]:
        """One run of a vendor: run id, status, deleted products. Skipped (id 0) if another holds its lock."""
        try:
            with self.metrics.timed("run", source.name) as event:
                run_id, event.outcome, deleted = self._ingest(source, snapshots, event)
                return run_id, event.outcome, deleted
        finally:
            self._write_metrics()

    def _write_metrics(self) -> None:
        """What has been done stays done if its metrics cannot be written: they are held until the next time."""
        try:
            self.metrics.flush()
        except Exception:
            logging.getLogger(__name__).exception("metrics are not written")

    def _ingest(self, source: Source, snapshots: bool | None, event: metrics.Event) -> tuple[int, str, int]:
        began = self.clock()
        if not self.store.locked(source.name, began):
            return 0, "skipped", 0
        snapshots = self.settings.snapshots if snapshots is None else snapshots
        try:
            self.reap()
            run_id = self.ledger.update(lambda ledger, n: runs.start(ledger, source.name, began, n))
            ingested, deleted, staged = 0, 0, f"{self.path}/staged/{uuid.uuid4().hex}"
            try:
                try:
                    for i, batch in enumerate(source.batches(self.spark)):
                        batch.select(*PRODUCT.fieldNames()).write.parquet(f"{staged}/batch={i}")  # a vendor's pages are asked for once
                        products = self.spark.read.schema(PRODUCT).parquet(f"{staged}/batch={i}")
                        event.rows = ingested = ingested + products.count()  # before repeats are dropped: the guards below rest on that
                        at = self.clock()
                        self.store.renew(source.name, at)
                        self._seen.mark(run_id, products)
                        if snapshots:
                            store.snapshots(products, run_id, F.lit(at).cast("timestamp")).write.mode("append").partitionBy("scrape_run_id").parquet(f"{self.path}/snapshots")
                finally:  # what came before a failure is loaded, too
                    if ingested:
                        batches = self.spark.read.schema(STAGED).parquet(staged)
                        self.store.upsert(store.last_batch(batches), F.lit(self.clock()).cast("timestamp"))
                mine = self._seen.read(run_id).select("product_hash")
                if runs.empty_run(ingested):
                    return self.finish(run_id, "failed", 0, 0, "no products")
                deleted = self.clean_up(source.name, F.lit(began).cast("timestamp"), ingested, source.failed_services(), mine)
                return self.finish(run_id, "success", ingested, deleted)
            except Exception as e:
                self.finish(run_id, "failed", ingested, deleted, str(e))
                raise
            finally:
                self.delete(staged)
                self.store.drop_versions(KEPT_VERSIONS)
                self._seen.clear(run_id, {r.id for r in self.runs.where("status = 'running'").select("id").collect()})
        finally:
            self.store.unlock(source.name)

    def clean_up(self, vendor: str, began: Column, ingested: int, failed_services: int, seen: DataFrame) -> int:
        """Deletes and counts what a run that ``began`` then has not seen; nothing where a guard forbids it."""
        if runs.may_clean(failed_services, runs.previous_products(self.runs, vendor), ingested) and runs.seen_complete(seen.count(), ingested):
            return self.store.delete_stale(vendor, began, seen)
        return 0

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def finish(self, run_id: int, status: str, products: int, deleted: int, error: str | None = None) -> tuple[int, str, int]:
        at = self.clock()
        self.ledger.update(lambda ledger, _: (runs.pruned(runs.finish(ledger, run_id, at, status, products, deleted, error), F.lit(at).cast("timestamp")), run_id))
        self._prune_snapshots()
        return run_id, status, deleted

    def _prune_snapshots(self) -> None:
        """Price history goes with its run, a folder for each."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            known = {r.id for r in self.runs.select("id").collect()}
            for s in files.listStatus(folder):
                name, _, n = s.getPath().getName().partition("=")
                if name == "scrape_run_id" and int(n) not in known:
                    files.delete(s.getPath(), True)

    def snapshots(self) -> DataFrame:
        """The price history: scrape_run_id, product_hash, prices, recorded_at."""
        empty = store.snapshots(self.store.plain().limit(0), 0, F.lit(None).cast("timestamp"))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/snapshots").select(*empty.columns)

    def products(self, f: ProductFilter, prices: PriceFilter | None = None) -> DataFrame:
        """One page, lazily; must name a vendor and a service."""
        query.guard(f)
        return query.filter_prices(query.plan_products(self.store.read(query.keys_of(f)), f), prices)

    def page(self, f: ProductFilter, prices: PriceFilter | None = None, late: Callable[[], bool] = lambda: False) -> list[Row]:
        """The rows of ``products``, read range by range of hashes until the page is full, so that it reads no more where a
        service has more buckets. Lookups by SKU or by an attribute's value find few rows, if any, and read all ranges at
        once."""
        query.guard(f)
        limit, skip = query.effective_limit(f.limit), 0 if f.after_hash else max(0, f.offset)
        narrow = f.sku is not None or any(a.value is not None for a in f.attribute_filters)
        out: list[Row] = []
        for rows in self.store.in_order(f.vendor_name, f.service, query.keys_of(f), f.after_hash, at_once=sys.maxsize if narrow else 1):
            if late():
                raise TimeoutError(LATE)
            if skip and not narrow and (there := query.matching(rows, f).count()) <= skip:
                skip -= there
                continue
            page = query.plan_products(rows, replace(f, limit=limit - len(out), offset=skip))
            out += query.filter_prices(page, prices).collect()
            skip = 0
            if len(out) >= limit:
                break
        return out

    def answer(self, requests: list[tuple[ProductFilter, PriceFilter | None]], budget: Budget | None = None, seconds: float | None = None) -> list:
        """Rows of each request in turn, or the error that it ran into; all share a budget and ``seconds`` (by default those
        of the settings), after which the rest are errors and what has been found is still returned."""
        if len(requests) > self.settings.batch_requests:
            raise ValueError(f"more than {self.settings.batch_requests} requests")
        budget, out = budget or self.budget(), []
        with Deadline(self.spark, self.settings.query_seconds if seconds is None else seconds) as deadline:
            for f, prices in requests:
                with self.metrics.timed("lookup", f.vendor_name, f.service) as event:
                    out.append(found := self._answered(f, prices, budget, deadline))
                    if isinstance(found, Exception):
                        event.outcome, event.error = "error", str(found)
                    else:
                        event.outcome, event.rows = "ok" if found else "empty", len(found)
        if self.metrics.full():
            self._write_metrics()
        return out

    def _answered(self, f: ProductFilter, prices: PriceFilter | None, budget: Budget, deadline: Deadline) -> list[Row] | Exception:
        if deadline.passed():
            return TimeoutError(LATE)
        try:
            query.guard(f)
            n = budget.reserve(f.limit)
            rows = self.page(replace(f, limit=n), prices, deadline.passed)
            budget.refund(n, len(rows))
            return rows
        except (ValueError, BudgetSpent) as e:
            return e
        except Exception:
            if not deadline.passed():
                raise
            return TimeoutError(LATE)

    def gauges(self) -> DataFrame:
        """vendor, products, last_finished: what is stored, and when a run last succeeded."""
        return metrics.gauges(self.store.read(), runs.freshness(self.runs))

    def as_json(self, products: DataFrame) -> DataFrame:
        return query.as_json(products)

    def catalog(self, path: str, if_none_match: str | None = None) -> tuple[int, str, str]:
        """Status, ETag and body of a request for the definition files under ``path``."""
        return landed.catalog_response(landed.catalog_bundle(landed.catalog(self.spark, path)), if_none_match)

    def status(self, now: datetime | None = None) -> DataFrame:
        """A row per vendor: its state, its products, and when it was last read, as text."""
        found = runs.vendor_status(self.runs, F.lit(now or self.clock()).cast("timestamp"))
        return found.withColumn("last_scraped", runs.rfc3339(F.col("last_finished"))).drop("last_finished")

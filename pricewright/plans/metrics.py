"""What runs, lookups and streams have done, as a table: a row for each with its outcome, rows and seconds.

Rows are held in memory and appended to a folder a few hundred at a time, after each run and when ``flush`` is called;
what a driver that is lost still held is lost. Counters and the distribution of seconds are aggregations of the table,
so they survive the driver and are common to all that write to the folder.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from pricewright.plans.runs import cut_bytes

METRIC = "at timestamp, kind string, vendor string, service string, outcome string, rows long, seconds double, error string"
#: Rows that are held before they are written.
HELD = 200
#: Upper ends of the ranges of seconds: a millisecond, doubled up to about eight seconds.
BOUNDS = tuple(0.001 * 2**i for i in range(14))


class Event:
    """One run or lookup while it lasts: its outcome and rows are set by whoever does it."""

    def __init__(self) -> None:
        self.outcome, self.rows, self.error = "ok", 0, None


class Metrics:
    """The rows of a folder. Any number of threads and drivers may add to them."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None), held: int = HELD):
        self.spark, self.path, self.clock, self.held = spark, path.rstrip("/"), clock, held
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def add(self, kind: str, vendor: str | None, service: str | None, outcome: str, rows: int = 0, seconds: float = 0.0, error: str | None = None, at: datetime | None = None) -> None:
        row = (at or self.clock(), kind, vendor, service, outcome, rows, float(seconds), None if error is None else cut_bytes(error))
        with self._lock:
            self._rows.append(row)

    @contextmanager
    def timed(self, kind: str, vendor: str | None, service: str | None = None) -> Iterator[Event]:
        """Adds a row when the block ends; an exception that leaves it is an error, and is raised all the same."""
        event, began, at = Event(), time.monotonic(), self.clock()
        try:
            yield event
        except BaseException as e:
            event.outcome, event.error = "error", str(e)
            raise
        finally:
            self.add(kind, vendor, service, event.outcome, event.rows, time.monotonic() - began, event.error, at)

    def full(self) -> bool:
        return len(self._rows) >= self.held

    def flush(self) -> None:
        """Appends what is held; if that fails it is held still, and the failure is raised."""
        with self._lock:
            rows, self._rows = self._rows, []
        if not rows:
            return
        try:
            self.spark.createDataFrame(rows, METRIC).coalesce(1).write.mode("append").parquet(self.path)
        except BaseException:
            with self._lock:
                self._rows = rows + self._rows
            raise

    def read(self) -> DataFrame:
        """All rows, those held by this writer among them."""
        with self._lock:
            held = self.spark.createDataFrame(list(self._rows), METRIC)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return held
        return self.spark.read.schema(METRIC).parquet(self.path).unionByName(held)

    def counters(self) -> DataFrame:
        """By kind, vendor and outcome: how many, their rows and seconds, and how many took at most each of BOUNDS."""
        within = F.array(*(F.count_if(F.col("seconds") <= b) for b in BOUNDS))
        return self.read().groupBy("kind", "vendor", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), within.alias("within"))


class Batches(StreamingQueryListener):
    """Adds a row of kind ``stream`` for each micro-batch and for a query's end: ``spark.streams.addListener(Batches(m))``.
    A query is told by its name, or its id."""

    def __init__(self, metrics: Metrics):
        self.metrics, self._names = metrics, {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.add("stream", None, p.name or str(p.id), "ok" if p.numInputRows else "empty", p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), str(event.id))
        self.metrics.add("stream", None, name, "error" if event.exception else "ended", error=event.exception)


def gauges(products: DataFrame, freshness: DataFrame) -> DataFrame:
    """vendor, products, last_finished: the products that are stored and the time of the last success; vendors that have
    only one of the two are there, too."""
    stored = products.groupBy(F.col("vendor_name").alias("vendor")).agg(F.count(F.lit(1)).alias("products"))
    return stored.join(freshness, "vendor", "full_outer").select("vendor", F.coalesce("products", F.lit(0)).alias("products"), "last_finished")

"""Files that land, loaded as a stream: each micro-batch is one handler call on the engine's store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricewright.plans.store import ProductStore, one_per_product


def landed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def load(files: DataFrame, transform: Callable[[DataFrame], DataFrame], store: ProductStore, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, once: bool = True) -> StreamingQuery:
    """Upserts what ``transform`` makes of each micro-batch. A batch that is repeated after a failure changes nothing:
    the upsert writes only products that differ."""

    def handle(batch: DataFrame, _: int) -> None:
        store.upsert(one_per_product(transform(batch)), now())

    out = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and totals of events by window and type; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A user's events with pauses shorter than ``gap``, as sessions."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

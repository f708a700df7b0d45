"""Shared pieces of the training-data operators: tables in the shared folder, size-checked broadcasts, components.

Nothing here depends on where a task runs: intermediate tables go to the folder named in
``spark.checkpoint.dir``, so a lost executor costs only the recomputation of its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.textkernel import squeeze
from pricewright.observed import counted

#: Rows of at most a few dozen bytes that may be broadcast; a side with more is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch of whole documents, and bytes where Spark can count them.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Bytes of text that a kernel takes at once, where it gains by more than a batch.
CHUNK = 4 << 20
#: Spark's setting to delete a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where one machine is all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pricewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)  # holds for paths that exist
    path = store.makeQualified(where).toString()
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to all shuffle partitions: for groups that are small in bytes but long in work, which
    adaptive execution would put into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes it once, survives lost executors.

    The rows that the write counted and those that the read finds must agree, and the write's marker must be there, so
    that a lost or half-written folder is an error and never an empty table. ``rows_of`` knows the count from then on.
    The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path, wrote = new_path(spark, label), Observation()
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.observe(wrote, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    table = spark.read.schema(df.schema).parquet(path)
    there, n = table.count(), counted(wrote)
    if n not in (there, None) or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        raise RuntimeError(f"{path} holds {there} rows of the {n} that were written")
    table._saved_path, table._rows = path, there
    return table


def rows_of(df: DataFrame, upto: int) -> int:
    """The number of rows of ``df``, counted no further than ``upto`` + 1 unless ``saved`` has counted them."""
    known = getattr(df, "_rows", None)
    return df.limit(upto + 1).count() if known is None else known


def is_empty(df: DataFrame) -> bool:
    return rows_of(df, 0) == 0


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` made and that nothing still to run reads: what was made of them is saved, too."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t._saved_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unmarked, for a shuffled join."""
    return F.broadcast(df) if rows_of(df, rows) <= rows else df


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Each of ``names``, with underscores after it while a column in ``taken`` has it, in any case: what an operator
    adds never replaces a column of its input."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs are in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the longest text. Every operator that uses Arrow sets the same size, as plans
    are lazy and run under what was set last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.Table]:
    """The batches put together until their last column holds ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(batch.num_columns - 1).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_z``, the compressed text, in place of text: what goes through the shuffles."""
    at = docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("_z", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.drop_columns(["text"]).columns, squeeze(batch.column(at))], names=[*names, "_z"])

    return docs.mapInArrow(task, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def blocked(rows: DataFrame, key: list[str], block: int, weight: str | None = None, weights: int = 0) -> DataFrame:
    """Adds x, y (the pair of blocks that a copy of the row is for) and own (its block, by ``id``): one pair unless more
    than ``block`` rows share ``key``, or rows whose ``weight`` sums up to more than ``weights``; then each row goes to
    every pair of blocks that its own is part of."""
    parts = F.ceil(F.count(F.lit(1)) / block)
    if weight is not None:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / weights))
    large = rows.groupBy(*key).agg(parts.cast("int").alias("parts")).where("parts > 1")
    large = saved(large, "large")
    if is_empty(large):
        return rows.withColumns({"x": F.lit(0), "y": F.lit(0), "own": F.lit(0)})
    joined = rows.join(small(large), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.withColumns({"x": F.least("own", "o").cast("int"), "y": F.greatest("own", "o").cast("int")}).drop("o", "parts")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component_id) for every id in ``edges``: the smallest id it reaches.

    Contraction: each round maps a vertex to its smallest neighbour (or itself), rewrites the edges by that map
    and drops loops and repeats, so the edge table shrinks geometrically; the maps compose to the answer. A hub's
    edges are only ever aggregated by min, with map-side combining, or joined, which AQE may split.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    for _ in count():
        if is_empty(left):
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("id"), F.least("a", "n").alias("to")), "map")
        labels = to.select("id", F.col("to").alias("component_id")) if labels is None else saved(
            labels.join(to.select(F.col("id").alias("component_id"), "to"), "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id")), "labels")
        moved = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        left = saved(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return labels

"""The ledger of runs: start, finish, reap, prune; what it says about each vendor; and the guards of a clean-up."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.schema import RUN, VENDORS

REAP_AFTER, STALE_AFTER, KEEP_FOR, ERROR_BYTES = timedelta(hours=6), timedelta(hours=48), timedelta(days=30), 2000
REAPED = "reaped: exceeded timeout"
#: After so long, a claim on a file of the ledger is given up.
CLAIM_SECONDS = 60


def start(runs: DataFrame, vendor: str, now: datetime, run_id: int | None = None) -> tuple[DataFrame, int]:
    """The ledger with a new running run, and its id: ``run_id``, or the next one."""
    run_id = run_id or (runs.agg(F.max("id")).first()[0] or 0) + 1
    row = runs.sparkSession.createDataFrame([(run_id, vendor, now, None, "running", 0, 0, None)], RUN)
    return runs.unionByName(row), run_id


def cut_bytes(text: str, size: int = ERROR_BYTES) -> str:
    return text.encode("utf-8", "replace")[:size].decode("utf-8", "ignore")


def finish(runs: DataFrame, run_id: int, now: datetime, status: str, products: int = 0, deleted: int = 0, error: str | None = None) -> DataFrame:
    """Errors are cut to 2000 bytes; of a character that the cut falls into, nothing stays."""
    mine = F.col("id") == run_id
    values = {"finished_at": F.lit(now).cast("timestamp"), "status": F.lit(status), "products": F.lit(products).cast("long"), "deleted": F.lit(deleted).cast("long"), "error": F.lit(None if error is None else cut_bytes(error)).cast("string")}
    return runs.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in values.items()})


def reaped(runs: DataFrame, now: Column, after: timedelta = REAP_AFTER) -> DataFrame:
    """Running runs older than ``after`` have failed."""
    old = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {int(after.total_seconds())} SECONDS"))
    values = {"status": F.lit("failed"), "finished_at": now, "error": F.lit(REAPED)}
    return runs.withColumn("_old", old).withColumns({k: F.when(F.col("_old"), v).otherwise(F.col(k)) for k, v in values.items()}).drop("_old")


def pruned(runs: DataFrame, now: Column, keep: timedelta = KEEP_FOR) -> DataFrame:
    """Without finished runs older than ``keep``; nothing goes if that is zero."""
    if keep <= timedelta(0):
        return runs
    old = F.coalesce(F.col("finished_at") < now - F.expr(f"INTERVAL {int(keep.total_seconds())} SECONDS"), F.lit(False))
    return runs.where(~((F.col("status") != "running") & old))


def pruned_snapshots(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Price history goes with its run."""
    return snapshots.join(runs.select(F.col("id").alias("scrape_run_id")), "scrape_run_id", "left_semi")


def latest(runs: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Of each vendor: the status of its latest run, of its latest success the number of products and the end, and when the
    latest run ended, or the latest success where that one has not."""
    good = F.col("status") == "success"
    last = F.max_by(F.struct("products", "finished_at"), F.when(good, F.col("id")))
    found = runs.groupBy(vendor).agg(F.max_by("status", "id").alias("latest_status"), F.max(good).alias("saw_success"), last.alias("_s"), F.max_by("finished_at", "id").alias("_end"))
    return found.select(vendor, "latest_status", "saw_success", F.col("_s.products").alias("success_products"), F.col("_s.finished_at").alias("finished_at"), F.coalesce("_end", "_s.finished_at").alias("last_finished"))


def rfc3339(at: Column) -> Column:
    """A time of a session in UTC as text: 2024-01-31T00:00:00Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def freshness(runs: DataFrame) -> DataFrame:
    """When each vendor's last success ended."""
    return runs.where("status = 'success'").groupBy("vendor").agg(F.max("finished_at").alias("last_finished"))


def state(now: Column) -> Column:
    """The state of a vendor from the columns of ``latest``, in this order of precedence."""
    success, status = F.coalesce("saw_success", F.lit(False)), F.coalesce("latest_status", F.lit(""))
    old = F.col("finished_at") < now - F.expr(f"INTERVAL {int(STALE_AFTER.total_seconds())} SECONDS")
    return (
        F.when((status == "") & ~success, "never").when(status == "running", "scraping").when(status == "failed", "failed").when(~success, "never")
        .when(F.coalesce("success_products", F.lit(0)) == 0, "empty").when(F.coalesce(old, F.lit(False)), "stale").otherwise("ready")
    )


def vendor_status(runs: DataFrame, now: Column, vendors: tuple[str, ...] | DataFrame = VENDORS) -> DataFrame:
    """A row for every listed vendor, whether it has run or not."""
    listed = vendors if isinstance(vendors, DataFrame) else runs.sparkSession.createDataFrame([(v,) for v in vendors], "vendor string")
    return listed.join(latest(runs), "vendor", "left").withColumn("status", state(now))


def previous_products(runs: DataFrame, vendor: str) -> int:
    """The number of products of the vendor's last success by time of finishing, 0 without one."""
    row = runs.where((F.col("vendor") == vendor) & (F.col("status") == "success")).orderBy(F.desc("finished_at")).limit(1).first()
    return row.products if row else 0


def empty_run(products: int) -> bool:
    """A run that brought nothing has failed, whatever it reports."""
    return products == 0


def may_clean(failed_services: int, previous: int, current: int) -> bool:
    """Not after failures, and not if the vendor has shrunk to under half."""
    return failed_services == 0 and not (previous > 0 and current < previous // 2)


def seen_complete(seen: int, ingested: int) -> bool:
    return seen > 0 and seen >= ingested // 2


class Ledger:
    """The runs in a folder, so that they outlive the driver: each change is a new file, whose number only one writer can
    take; who comes second reads again. Ids are never given twice, whatever has been pruned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(int(n) for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName()).isdigit())

    def _state(self) -> tuple[int, dict]:
        """The number of the last file, and what it says: the next id and the runs."""
        held = self._numbers()
        if not held:
            return 0, {"next": 1, "runs": []}
        said = self.spark.read.text(f"{self.path}/{held[-1]}", wholetext=True).first()
        return held[-1], json.loads(said.value)

    def _frame(self, state: dict) -> DataFrame:
        times = [i for i, f in enumerate(RUN.fields) if f.dataType.typeName() == "timestamp"]
        rows = [[datetime.fromisoformat(v) if i in times and v else v for i, v in enumerate(r)] for r in state["runs"]]
        return self.spark.createDataFrame(rows, RUN)

    def read(self) -> DataFrame:
        return self._frame(self._state()[1])

    def update(self, change: Callable[[DataFrame, int], tuple[DataFrame, int]]) -> int:
        """Puts ``change(runs, next id)``, the runs and an id, in place of the runs, and returns the id."""
        while True:
            n, state = self._state()
            after, run_id = change(self._frame(state), state["next"])
            rows = [[v.isoformat() if isinstance(v, datetime) else v for v in r] for r in after.collect()]
            if self._put(n + 1, {"next": max([state["next"], run_id + 1, *(r[0] + 1 for r in rows)]), "runs": rows}):
                for old in self._numbers()[:-2]:
                    self._fs.delete(self._at(str(old)), False)
                return run_id

    def _put(self, n: int, state: dict) -> bool:
        return published(self._fs, self._at, "", n, json.dumps(state))


def published(fs, at: Callable, folder: str, n: int, text: str) -> bool:
    """Writes a file aside and gives it the number ``n`` in ``folder``, unless another has that: False then. Only the
    holder of a claim on the number may rename, and what the rename says is the answer."""
    name = lambda x: f"{folder}/{x}" if folder else x
    fs.mkdirs(at(folder))
    aside, claim, there = at(name(f"_{uuid.uuid4().hex}")), at(name(f"_claim-{n}")), at(name(str(n)))
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if not created(fs, claim, ""):
            try:
                if time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                    fs.delete(claim, False)  # its writer is gone
            except Exception:
                if fs.exists(claim):
                    raise
            time.sleep(0.1)
            return False
        try:
            return not fs.exists(there) and bool(fs.rename(aside, there))
        finally:
            fs.delete(claim, False)
    finally:
        fs.delete(aside, False)


def created(fs, path, text: str) -> bool:
    """Makes a file that must not exist; False if it does. Any other failure of the store is raised."""
    from py4j.protocol import Py4JJavaError

    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True

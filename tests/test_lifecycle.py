import threading
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewright.engine import Budget, Engine
from pricewright.model import AttributeFilter, BudgetSpent, PriceFilter, ProductFilter
from pricewright.plans import runs, store
from pricewright.schema import PRICE_FIELDS, PRODUCT, RUN

T0 = datetime(2024, 1, 1)


def product(h, usd="0.0104", vendor="aws", **attributes):
    prices = [tuple({"USD": usd, "unit": "h", "purchaseOption": "on_demand"}.get(f, "") for f in PRICE_FIELDS)]
    return (h, f"sku-{h}", vendor, "us-east-1", "ec2", "f", attributes or {"a": "1", "b": "2"}, prices)


class Fixed:
    def __init__(self, name, *batches, failed=0):
        self.name, self._batches, self._failed = name, batches, failed

    def batches(self, spark):
        for b in self._batches:
            yield spark.createDataFrame(b, PRODUCT)

    def failed_services(self):
        return self._failed


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        self.now += timedelta(minutes=1)
        return self.now


def stored(engine):
    return {r.product_hash: r for r in engine.store.read().collect()}


def test_upsert_stale_and_unchanged(spark, tmp_path):
    clock = Clock()
    engine = Engine(spark, f"{tmp_path}/a", clock)
    assert engine.ingest(Fixed("aws", [product("h1"), product("h2")]))[1:] == ("success", 0)
    first = stored(engine)["h1"].updated_at
    assert engine.ingest(Fixed("aws", [product("h1", b="2", a="1")])) == (2, "success", 1)
    assert set(stored(engine)) == {"h1"} and stored(engine)["h1"].updated_at == first and engine.seen.count() == 0
    engine.ingest(Fixed("aws", [product("h1", "0.0200")]))
    assert stored(engine)["h1"].updated_at > first and stored(engine)["h1"].prices[0].USD == "0.0200"
    assert {(r.vendor, r.status) for r in engine.status(clock.now).collect()} == {("aws", "ready"), ("azure", "never"), ("gcp", "never")}
    assert {r.vendor: r.status for r in engine.status(clock.now + timedelta(hours=49)).collect()}["aws"] == "stale"


def test_runs_that_must_not_clean_up(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/b", Clock())
    engine.ingest(Fixed("aws", [product(f"h{i}") for i in range(10)]))
    assert engine.ingest(Fixed("aws", [product("h1")], failed=1))[1:] == ("success", 0)
    assert engine.ingest(Fixed("aws"))[1] == "failed" and engine.store.count() == 10
    assert engine.store.locked("aws") and engine.ingest(Fixed("aws", [product("h1")])) == (0, "skipped", 0)
    engine.store.unlock("aws")
    engine.seed(spark.createDataFrame([product("s", vendor="gcp")], PRODUCT))
    assert engine.ingest(Fixed("gcp", [product("g", vendor="gcp")]))[2] == 1 and engine.store.count() == 11
    engine.store.drop_versions(1)
    assert engine.store.count() == 11


def test_lookups_and_budget(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/c", Clock())
    engine.seed(spark.createDataFrame([product(f"h{i:02d}", instanceType=f"t{i % 2}") for i in range(30)], PRODUCT))
    f = ProductFilter("aws", "ec2", limit=20)
    assert [len(x) if isinstance(x, list) else type(x) for x in engine.answer([(f, None), (f, None), (ProductFilter("aws"), None), (f, PriceFilter(unit="none"))], Budget(45))][:2] == [20, 20]
    answers = engine.answer([(f, PriceFilter(unit="none"))] * 3, Budget(50))
    assert len(answers[0]) == 20 and answers[0][0].prices == [] and len(answers[2]) == 10
    assert isinstance(engine.answer([(ProductFilter("aws"), None)])[0], ValueError)
    with pytest.raises(ValueError):
        engine.answer([(f, None)] * 51)
    plan = engine.products(ProductFilter("aws", "ec2"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(vendor_name" in plan
    assert '"sku":"sku-h00"' in engine.as_json(engine.products(f)).first().product


def test_budget_refunds():
    b, got = Budget(120), []
    for _ in range(3):
        got.append(b.reserve(50))
    assert got == [50, 50, 20]
    with pytest.raises(BudgetSpent):
        b.reserve(50)
    b = Budget(100)
    for _ in range(10):
        b.refund(b.reserve(50), 1)
    assert b.left == 90
    b = Budget(100, queries=1)
    b.reserve(1)
    with pytest.raises(BudgetSpent):
        b.reserve(1)


@pytest.mark.parametrize(("rows", "want"), [
    ([], "never"), ([("running", 5)], "scraping"), ([("success", 5), ("failed", 0)], "failed"), ([("success", 0)], "empty"), ([("success", 5)], "ready"), ([("success", 5), ("running", 0)], "scraping"), ([("failed", 0)], "failed"),
])
def test_vendor_states(spark, rows, want):
    ledger = spark.createDataFrame([(i, "aws", T0, T0, s, n, 0, None) for i, (s, n) in enumerate(rows)], RUN)
    got = {r.vendor: r.status for r in runs.vendor_status(ledger, F.lit(T0 + timedelta(hours=1))).collect()}
    assert got == {"aws": want, "azure": "never", "gcp": "never"}


def test_guards():
    assert [runs.empty_run(n) for n in (0, 1, 2422585)] == [True, False, False]
    assert [runs.seen_complete(a, b) for a, b in ((0, 0), (0, 1000), (400, 1000), (500, 1000), (1000, 1000))] == [False, False, False, True, True]
    assert [runs.may_clean(*x) for x in ((0, 0, 5), (1, 0, 5), (0, 100, 49), (0, 100, 50), (0, 99, 49))] == [True, False, False, True, True]


def test_ledger(spark):
    ledger, n = runs.start(spark.createDataFrame([], RUN), "aws", T0)
    ledger = runs.finish(ledger, n, T0, "success", 42, 3, "e" * 3000)
    row = ledger.first()
    assert (n, row.status, row.products, row.deleted, len(row.error)) == (1, "success", 42, 3, 2000)
    cut = runs.finish(ledger, n, T0, "failed", error="é" * 999 + "ab€c").first().error
    assert cut == "é" * 999 + "ab" and len(cut.encode()) == 2000
    old = F.lit(T0 + timedelta(days=40))
    assert runs.pruned(ledger, old).count() == 0 and runs.pruned(ledger, old, timedelta(0)).count() == 1
    running, _ = runs.start(ledger, "gcp", T0)
    late = {r.id: (r.status, r.error) for r in runs.reaped(running, F.lit(T0 + timedelta(hours=7))).collect()}
    assert late[2] == ("failed", "reaped: exceeded timeout") and late[1][0] == "success"


def test_seen_sets_are_apart(spark):
    ledger = spark.createDataFrame([(1, "azure", T0, None, "running", 0, 0, None), (2, "gcp", T0, T0, "failed", 0, 0, None), (3, "aws", T0, None, "running", 0, 0, None)], RUN)
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "d")], "run_id long, product_hash string")
    assert [tuple(r) for r in store.clear_seen(seen, 3, ledger).collect()] == [(1, "a")]
    assert store.mark_seen(seen, 0, spark.createDataFrame([("x",)], "product_hash string")).count() == 4


def test_first_in_batches(spark):
    rows = spark.createDataFrame([("a", 0, "1"), ("a", 5, "2"), ("a", 1200, "3"), ("a", 1300, "4"), ("b", 7, "5")], "product_hash string, ord long, v string")
    assert {r.product_hash: r.v for r in store.first_in_batches(rows).collect()} == {"a": "3", "b": "5"}


def test_streamed_load_and_windows(spark, tmp_path):
    from pricewright.schema import SEED
    from pricewright.streaming import landing

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"productHash": "h", "sku": "s", "vendorName": "aws", "region": "r", "service": "x", "productFamily": "f", "attributes": {}, "prices": []}]')
    target = store.ProductStore(spark, f"{tmp_path}/store")
    shape = lambda b: b.select(F.col("productHash").alias("product_hash"), "sku", F.col("vendorName").alias("vendor_name"), "region", "service", F.col("productFamily").alias("product_family"), "attributes", "prices")
    landing.load(landing.landed(spark, f"{tmp_path}/in", SEED), shape, target, f"{tmp_path}/check").awaitTermination()
    assert target.count() == 1
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, 10), 1, "click", 2.0), (datetime(2024, 1, 1, 0, 20), 1, "click", 3.0), (datetime(2024, 1, 1, 7), 1, "click", 1.0)], "ts timestamp, user_id long, event_type string, value double")
    assert sorted((r.n, r.total) for r in landing.windowed(events, "6 hours").collect()) == [(1, 1.0), (2, 5.0)]
    assert sorted(r.n for r in landing.sessions(events).collect()) == [1, 2]


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    target = store.ProductStore(spark, f"{tmp_path}/s")
    other = product("x", vendor="gcp")[:4] + ("Cloud & more: a/b", *product("x")[5:])
    now = F.lit(T0).cast("timestamp")
    assert target.upsert(spark.createDataFrame([product("h1"), other], PRODUCT), now) == 1
    assert target.upsert(spark.createDataFrame([product("h1")], PRODUCT), F.lit(T0 + timedelta(days=1)).cast("timestamp")) == 1
    assert target.upsert(spark.createDataFrame([product("h2")], PRODUCT), F.lit(T0 + timedelta(days=1)).cast("timestamp")) == 2
    folders = {v: f for f, v, *_ in target.manifest()}
    assert set(folders) == {"gcp", "aws"} and folders["gcp"] != folders["aws"] and target.count() == 3
    assert target.delete_stale("gcp", F.lit(T0 + timedelta(days=2)).cast("timestamp"), spark.createDataFrame([], "product_hash string")) == 1
    assert {r.product_hash for r in target.read().collect()} == {"h1", "h2"} and {v for _, v, *_ in target.manifest()} == {"aws"}
    assert target.upsert(spark.createDataFrame([product("h3")], PRODUCT), F.lit(T0 + timedelta(days=3)).cast("timestamp"), folders=0) == 5
    assert len({f for f, *_ in target.manifest()}) == 1 and target.count() == 3
    target.drop_versions(1)
    assert target.count() == 3 and target.version() == 5 and len([f for f in Path(f"{tmp_path}/s").iterdir() if f.name.startswith("v-")]) == 1


def test_a_new_engine_knows_the_runs_of_the_last(spark, tmp_path):
    clock = Clock()
    assert Engine(spark, f"{tmp_path}/a", clock).ingest(Fixed("aws", [product(f"h{i}") for i in range(10)]), snapshots=True) == (1, "success", 0)
    again = Engine(spark, f"{tmp_path}/a", clock)
    assert again.ingest(Fixed("aws", [product(f"h{i}") for i in range(3)]), snapshots=True) == (2, "success", 0)  # 3 < 10 // 2: no clean-up
    assert again.store.count() == 10 and sorted(r.id for r in Engine(spark, f"{tmp_path}/a", clock).runs.collect()) == [1, 2]
    assert {r.scrape_run_id: r["count"] for r in again.snapshots().groupBy("scrape_run_id").count().collect()} == {1: 10, 2: 3}


def test_pruned_runs_take_their_snapshots_and_ids_go_on(spark, tmp_path):
    clock = Clock()
    engine = Engine(spark, f"{tmp_path}/p", clock)
    assert engine.snapshots().count() == 0
    engine.ingest(Fixed("aws", [product("h1")]), snapshots=True)
    clock.now += timedelta(days=40)
    assert Engine(spark, f"{tmp_path}/p", clock).ingest(Fixed("gcp", [product("g", vendor="gcp")]), snapshots=True)[0] == 2
    assert [(r.id, r.vendor) for r in engine.runs.collect()] == [(2, "gcp")]
    assert [r.scrape_run_id for r in engine.snapshots().collect()] == [2]


def test_a_crashed_run_is_reaped_and_its_lock_taken_over(spark, tmp_path):
    clock = Clock()
    crashed = Engine(spark, f"{tmp_path}/c", clock)
    assert crashed.store.locked("aws", clock())
    crashed.ledger.update(lambda ledger, n: runs.start(ledger, "aws", clock(), n))
    engine = Engine(spark, f"{tmp_path}/c", clock)
    assert engine.ingest(Fixed("aws", [product("h1")])) == (0, "skipped", 0)
    clock.now += timedelta(hours=7)
    assert engine.ingest(Fixed("aws", [product("h1")])) == (2, "success", 0)
    assert {r.id: (r.status, r.error) for r in engine.runs.collect()} == {1: ("failed", "reaped: exceeded timeout"), 2: ("success", None)}
    crashed.store.unlock("aws")
    assert engine.ingest(Fixed("aws", [product("h1")]))[1] == "success"


def test_a_lock_of_another_is_not_given_back(spark, tmp_path):
    a, b = store.ProductStore(spark, f"{tmp_path}/l"), store.ProductStore(spark, f"{tmp_path}/l")
    assert a.locked("aws", T0) and not b.locked("aws", T0 + timedelta(hours=1)) and b.locked("aws", T0 + timedelta(hours=7))
    a.unlock("aws")
    assert not a.locked("aws", T0 + timedelta(hours=8))
    b.unlock("aws")
    assert a.locked("aws", T0 + timedelta(hours=8))
    broken = store.ProductStore(spark, "/proc/nowhere")
    with pytest.raises(Exception, match="."):
        broken.locked("aws")


def test_two_writers_of_the_ledger(spark, tmp_path):
    one, two = runs.Ledger(spark, f"{tmp_path}/r"), runs.Ledger(spark, f"{tmp_path}/r")

    def slow(ledger, n):
        if not ledger.count():  # another run starts while this one is being written down
            two.update(lambda other, m: runs.start(other, "gcp", T0, m))
        return runs.start(ledger, "aws", T0, n)

    assert one.update(slow) == 2
    assert [(r.id, r.vendor) for r in one.read().orderBy("id").collect()] == [(1, "gcp"), (2, "aws")]


def test_services_of_digits_stay_text(spark, tmp_path):
    target = store.ProductStore(spark, f"{tmp_path}/d")
    row = product("h1")[:4] + ("007", *product("h1")[5:])
    target.upsert(spark.createDataFrame([row], PRODUCT), F.lit(T0).cast("timestamp"))
    assert target.read().first().service == "007" and target.upsert(spark.createDataFrame([row], PRODUCT), F.lit(T0 + timedelta(days=1)).cast("timestamp")) == 1


def test_metrics_are_rows(spark, tmp_path):
    from pricewright.plans import metrics

    held = metrics.Metrics(spark, f"{tmp_path}/m", lambda: T0, held=3)
    assert held.counters().count() == 0 and not held.full()
    held.flush()
    assert not Path(f"{tmp_path}/m").exists()
    with held.timed("lookup", "aws", "ec2") as event:
        event.rows = 4
    with pytest.raises(KeyError), held.timed("lookup", "aws", "ec2"):
        raise KeyError("€" * 3000)
    held.add("lookup", "aws", None, "ok", 2, metrics.BOUNDS[-1] + 1)
    assert held.full() and held.read().count() == 3
    held.flush()
    other = metrics.Metrics(spark, f"{tmp_path}/m")
    other.add("run", None, None, "failed", seconds=0.004)
    found = {(r.kind, r.vendor, r.outcome): r for r in other.counters().collect()}
    ok = found["lookup", "aws", "ok"]
    assert (ok.n, ok.rows, ok.within[-1], len(ok.within)) == (2, 6, 1, 14) and found["run", None, "failed"].within == [0, 0, *[1] * 12]
    error = other.read().where("outcome = 'error'").first()
    assert error.at == T0 and 1990 < len(error.error.encode()) <= 2000 and not held.full()
    held.add("run", "aws", None, "ok")
    held.path = "none://none"
    with pytest.raises(Exception):  # noqa: B017
        held.flush()
    assert len(held._rows) == 1


def test_the_engine_counts_runs_and_lookups(spark, tmp_path):
    class Broken:
        name = "gcp"

        def batches(self, spark):
            yield spark.createDataFrame([product("g0", vendor="gcp")], PRODUCT)
            raise OSError("gone")

        def failed_services(self):
            return 0

    engine = Engine(spark, str(tmp_path), Clock())
    engine.ingest(Fixed("aws", [product(f"h{i}") for i in range(3)]))
    with pytest.raises(OSError):
        engine.ingest(Broken())
    assert engine.store.locked("azure") and Engine(spark, str(tmp_path), Clock()).ingest(Fixed("azure"))[1] == "skipped"
    f = ProductFilter("aws", "ec2")
    engine.answer([(f, None), (ProductFilter("aws", "s3"), None), (ProductFilter("aws"), None)])
    engine.answer([(f, None)], seconds=0)
    rows = {(r.kind, r.vendor, r.service, r.outcome, r.rows, r.error) for r in engine.metrics.read().collect()}
    assert rows == {("run", "aws", None, "success", 3, None), ("run", "gcp", None, "error", 1, "gone"), ("run", "azure", None, "skipped", 0, None), ("lookup", "aws", "ec2", "ok", 3, None), ("lookup", "aws", "s3", "empty", 0, None), ("lookup", "aws", None, "error", 0, "vendorName and service are required"), ("lookup", "aws", "ec2", "error", 0, "query timeout exceeded")}
    assert {(r.vendor, r.products, r.last_finished is None) for r in engine.gauges().collect()} == {("aws", 3, False), ("gcp", 1, True)}


def test_micro_batches_are_counted(spark, tmp_path):
    from pricewright.plans import metrics

    spark.range(5).write.parquet(f"{tmp_path}/in")
    held = metrics.Metrics(spark, f"{tmp_path}/m")
    listener = metrics.Batches(held)
    spark.streams.addListener(listener)
    try:
        files = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        files.writeStream.queryName("counted").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if held.read().where("outcome = 'ended'").count():
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    found = {(r.service, r.outcome, r.rows) for r in held.read().collect()}
    assert {("counted", "ok", 5), ("counted", "ended", 0)} <= found


def test_a_batch_has_one_deadline(spark, tmp_path, monkeypatch):
    from pricewright import requests
    from pricewright.config import Settings

    engine = Engine(spark, f"{tmp_path}/t", Clock(), Settings(batch_requests=3))
    engine.seed(spark.createDataFrame([product(f"h{i}") for i in range(4)], PRODUCT))
    f = ProductFilter("aws", "ec2", limit=2)
    assert [type(x) for x in engine.answer([(f, None)] * 2, seconds=0)] == [TimeoutError] * 2
    slow, calls = engine.store.read, []

    def in_order(*asked, **more):
        calls.append(1)
        if len(calls) == 2:  # the second lookup outlasts the batch
            return iter([spark.range(4, numPartitions=1).mapInPandas(lambda it: (x for x in it if not __import__("time").sleep(30)), "id long").crossJoin(slow()).drop("id")])
        return iter([slow()])

    monkeypatch.setattr(engine.store, "in_order", in_order)
    got = engine.answer([(f, None)] * 3, seconds=6)
    assert len(got[0]) == 2 and [type(x) for x in got[1:]] == [TimeoutError] * 2
    with pytest.raises(ValueError):
        engine.answer([(f, None)] * 4)
    one = {"query": '{ products(filter: {vendorName: "aws", service: "ec2"}) { sku } }'}
    assert requests.batch(engine, [one], seconds=0) == [{"data": None, "errors": [{"message": "query timeout exceeded"}]}]


def test_status_and_catalog(spark, tmp_path):
    clock = Clock()
    engine = Engine(spark, f"{tmp_path}/s", clock)
    engine.ingest(Fixed("aws", [product("h1")]))
    rows = {r.vendor: (r.status, r.last_scraped) for r in engine.status().collect()}
    assert rows["gcp"] == ("never", None) and rows["aws"][0] == "ready" and rows["aws"][1].startswith("2024-01-01T00:0") and rows["aws"][1].endswith("Z")
    (tmp_path / "defs" / "aws").mkdir(parents=True)
    (tmp_path / "defs" / "aws" / "x.toml").write_text('kind = "x"\n')
    status, etag, body = engine.catalog(f"{tmp_path}/defs")
    assert status == 200 and '"count": 1' in body and engine.catalog(f"{tmp_path}/defs", etag)[0] == 304


def at(days):
    return F.lit(T0 + timedelta(days=days)).cast("timestamp")


def hashed(i):
    import hashlib

    return hashlib.sha256(str(i).encode()).hexdigest()[:32]


def test_three_vendors_load_side_by_side(spark, tmp_path):
    """Each loads and cleans up beside the others; no row of any is lost."""
    said = []

    def run(vendor):
        try:
            target = store.ProductStore(spark, f"{tmp_path}/v")
            for day, n in ((0, 30), (1, 40), (2, 25)):
                rows = [product(hashed(f"{vendor}{i}"), f"{day}.5", vendor) for i in range(n)]
                load = spark.createDataFrame(rows, PRODUCT)
                target.upsert(load, at(day))
                target.delete_stale(vendor, at(day), load.select("product_hash"))
        except Exception as e:
            said.append(e)

    threads = [threading.Thread(target=run, args=(v,)) for v in ("aws", "azure", "gcp")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    held = store.ProductStore(spark, f"{tmp_path}/v").plain().collect()
    assert not said and len(held) == 75
    assert {(r.vendor_name, r.product_hash, r.prices[0].USD) for r in held} == {(v, hashed(f"{v}{i}"), "2.5") for v in ("aws", "azure", "gcp") for i in range(25)}


def test_a_stale_writer_merges_or_begins_anew(spark, tmp_path, monkeypatch):
    one, two = store.ProductStore(spark, f"{tmp_path}/w"), store.ProductStore(spark, f"{tmp_path}/w")
    one.upsert(spark.createDataFrame([product(hashed(i)) for i in range(8)], PRODUCT), at(0))
    commit, raised = one._commit, []

    def late(base, *args):
        """Between reading and committing, the other writer commits: first another vendor's rows, then the same ones."""
        if not raised:
            raised.append(None)
            two.upsert(spark.createDataFrame([product(hashed(f"g{i}"), vendor="gcp") for i in range(5)], PRODUCT), at(1))
            two.upsert(spark.createDataFrame([product(hashed(i), "7") for i in range(4)], PRODUCT), at(1))
        try:
            return commit(base, *args)
        except store.Stale as e:
            raised.append(e)
            raise

    monkeypatch.setattr(one, "_commit", late)
    assert one.upsert(spark.createDataFrame([product(hashed(i), "9") for i in range(2, 9)], PRODUCT), at(2)) == 4
    assert len(raised) == 2 and isinstance(raised[1], store.Stale)
    usd = {r.product_hash: r.prices[0].USD for r in one.plain().collect()}
    assert len(usd) == 14 and [usd[hashed(i)] for i in range(9)] == ["7", "7", *["9"] * 7]
    assert not [f for f in Path(f"{tmp_path}/w/_staged").iterdir() if not f.name.startswith(".")]


def test_a_number_is_published_once(spark, tmp_path):
    target = store.ProductStore(spark, f"{tmp_path}/n")
    assert runs.published(target._fs, target._at, "_current", 1, "{}") and not runs.published(target._fs, target._at, "_current", 1, "x")
    assert Path(f"{tmp_path}/n/_current/1").read_text() == "{}" and target.version() == 1


def test_an_upsert_writes_only_buckets_that_change(spark, tmp_path):
    target = store.ProductStore(spark, f"{tmp_path}/b", buckets=16)
    rows = [product(hashed(i)) for i in range(400)]
    target.upsert(spark.createDataFrame(rows, PRODUCT), at(0))
    before = {(v, s, b): f for f, v, s, b in target.manifest()}
    assert len(before) == 16
    rows[7] = product(hashed(7), "9.9")
    target.upsert(spark.createDataFrame(rows, PRODUCT), at(1))
    after = {(v, s, b): f for f, v, s, b in target.manifest()}
    assert [p for p in after if after[p] != before[p]] == [("aws", "ec2", int(hashed(7)[0], 16))]
    written = sum(1 for f in Path(f"{tmp_path}/b/{after['aws', 'ec2', int(hashed(7)[0], 16)]}").rglob("*.parquet"))
    assert written and {r.updated_at for r in target.read().where(F.col("product_hash") == hashed(7)).collect()} == {T0 + timedelta(days=1)}
    assert target.read().where(F.col("updated_at") == at(0)).count() == 399
    buckets = target.read().groupBy("bucket").agg(F.min("product_hash").alias("lo"), F.max("product_hash").alias("hi")).orderBy("bucket").collect()
    assert all(a.hi < b.lo for a, b in zip(buckets, buckets[1:], strict=False))


def paged(spark, path, n, buckets, monkeypatch):
    """An engine over n products of a service, and the parts that it reads from now on."""
    engine, read = Engine(spark, path, Clock()), []
    engine.store = store.ProductStore(spark, f"{path}/products", buckets=buckets)
    rows = [product(hashed(i), k=str(i % 7), **({"usagetype": "Global-x"} if i % 5 == 0 else {})) for i in range(n)]
    engine.seed(spark.createDataFrame([*rows, product("0" * 32, vendor="gcp")], PRODUCT))
    rows_of = engine.store._rows
    monkeypatch.setattr(engine.store, "_rows", lambda state, parts, *more: (read.extend(parts), rows_of(state, parts, *more))[1])
    return engine, read


@pytest.mark.parametrize("buckets", [1, 16])
def test_pages_by_ranges_are_those_of_the_whole(spark, tmp_path, monkeypatch, buckets):
    engine, _ = paged(spark, str(tmp_path), 300, buckets, monkeypatch)
    all_, key = sorted(hashed(i) for i in range(300)), AttributeFilter("k", "3")
    asked = [{}, {"limit": 7}, {"limit": 40, "offset": 33}, {"limit": 5, "offset": 299}, {"offset": 300}, {"offset": -3, "limit": 2}, {"limit": 9, "after_hash": all_[150], "offset": 4}, {"after_hash": "~"}, {"after_hash": "", "limit": 3}, {"limit": 3, "offset": 100, "region": "us-east-1"}, {"limit": 4, "offset": 2, "attribute_filters": (key,)}, {"sku": f"sku-{all_[9]}"}, {"region": "none"}, {"product_family": "f", "limit": 60, "attribute_filters": (AttributeFilter("k", None, "/[12]/"),)}]
    for more in asked:
        f = ProductFilter("aws", "ec2", **more)
        assert engine.page(f) == engine.products(f).collect(), more
    prices = PriceFilter(unit="none")
    assert engine.page(ProductFilter("aws", "ec2", limit=3), prices) == engine.products(ProductFilter("aws", "ec2", limit=3), prices).collect()
    assert engine.page(ProductFilter("aws", "s3")) == [] and [r.vendor_name for r in engine.page(ProductFilter("gcp", "ec2"))] == ["gcp"]
    walked, last = [], None
    while page := engine.page(ProductFilter("aws", "ec2", limit=90, after_hash=last)):
        walked, last = walked + [r.product_hash for r in page], page[-1].product_hash
    assert walked == all_


def test_a_page_reads_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    for n, buckets in ((160, 4), (640, 16)):
        engine, read = paged(spark, f"{tmp_path}/{n}", n, buckets, monkeypatch)
        all_ = sorted(hashed(i) for i in range(n))
        assert [r.product_hash for r in engine.page(ProductFilter("aws", "ec2", limit=10))] == all_[:10] and read == [("aws", "ec2", 0)]
        read.clear()
        late = all_[-5]
        assert [r.product_hash for r in engine.page(ProductFilter("aws", "ec2", limit=10, after_hash=late))] == all_[-4:] and {p[2] for p in read} == {buckets - 1}
        read.clear()
        engine.page(ProductFilter("aws", "ec2", sku="none"))
        assert len(read) == buckets


def test_stored_rows_are_not_exchanged(spark, tmp_path):
    target = store.ProductStore(spark, f"{tmp_path}/x")
    target.upsert(spark.createDataFrame([product(hashed(i)) for i in range(100)], PRODUCT), at(0))
    (_, base), load = target._state(), spark.createDataFrame([product(hashed(i), "9") for i in range(3)], PRODUCT)
    load = load.withColumns({"content": store.content(), "bucket": store.bucket(4)})
    target._changes(base, load).write.parquet(f"{tmp_path}/x/_d")
    delta = spark.read.parquet(f"{tmp_path}/x/_d")
    after = target._after(base, target._sent(delta, "_d"), set(base["parts"]), at(1))
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert after.count() == 100 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_any_attribute_key_reaches_the_scan(spark, tmp_path):
    from pricewright.plans import query
    from pricewright.model import AttributeFilter

    key = F.col("id").cast("string")
    price = F.array(F.struct(*(F.lit("x").alias(f) for f in PRICE_FIELDS)))
    attributes = F.create_map(F.lit("Odd Key=1"), F.concat(F.lit("v"), F.floor(F.col("id") / 40)), F.lit("os"), F.lit("Linux"))
    rows = spark.range(200_000).select(F.substring(F.sha2(key, 256), 1, 32).alias("product_hash"), key.alias("sku"), F.lit("aws").alias("vendor_name"), F.concat(F.lit("r"), F.lpad(F.floor(F.col("id") / 4000).cast("string"), 3, "0")).alias("region"), F.lit("ec2").alias("service"), F.lit("f").alias("product_family"), attributes.alias("attributes"), price.alias("prices"))
    target = store.ProductStore(spark, f"{tmp_path}/k")
    target.upsert(rows, at(0))
    f = ProductFilter("aws", "ec2", attribute_filters=(AttributeFilter("Odd Key=1", "v77"),), limit=50)
    found = query.plan_products(target.read(query.keys_of(f)), f)
    assert sorted(int(r.sku) for r in found.collect()) == list(range(77 * 40, 78 * 40))
    plan = found._jdf.queryExecution().executedPlan()
    assert f"EqualTo({store.key_column('Odd Key=1')},v77)" in plan.toString()

    def scans(node):
        node = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node
        out = [node] if node.nodeName().startswith("Scan") else []
        return out + [x for i in range(node.children().size()) for x in scans(node.children().apply(i))]

    scan = scans(plan)[0]
    plan.execute().count() if not scan.metrics().apply("numOutputRows").value() else None
    assert scan.metrics().apply("numOutputRows").value() < 50_000
    none = query.plan_products(target.read(["os", "nowhere"]), ProductFilter("aws", "ec2", attribute_filters=(AttributeFilter("nowhere", "x"),)))
    assert none.count() == 0


def test_more_keys_than_columns(spark, tmp_path, monkeypatch):
    from pricewright.model import AttributeFilter
    from pricewright.plans import query

    monkeypatch.setattr(store, "KEYS", 3)
    target = store.ProductStore(spark, f"{tmp_path}/m")
    target.upsert(spark.createDataFrame([product(hashed(i), **{f"k{i}": "v", "os": "L"}) for i in range(6)] + [product("g", vendor="gcp", K="1", k="2")], PRODUCT), at(0))
    f = ProductFilter("aws", "ec2", attribute_filters=(AttributeFilter("k4", "v"), AttributeFilter("os", "L")))
    assert [r.sku for r in query.plan_products(target.read(query.keys_of(f)), f).collect()] == [f"sku-{hashed(4)}"]
    other = ProductFilter("gcp", "ec2", attribute_filters=(AttributeFilter("K", "1"), AttributeFilter("k", "2")))
    assert query.plan_products(target.read(query.keys_of(other)), other).count() == 1
    target.upsert(spark.createDataFrame([product(hashed(9), k9="v")], PRODUCT), at(1))
    assert target.count() == 8


def test_a_run_loads_its_batches_at_once(spark, tmp_path, monkeypatch):
    """The last batch that has a product counts; what came before a failure stays loaded; old versions go."""

    class Failing(Fixed):
        def batches(self, spark):
            yield from super().batches(spark)
            raise OSError("gone " + "é" * 2000)

    engine = Engine(spark, f"{tmp_path}/o", Clock())
    assert engine.ingest(Fixed("aws", [product("h1"), product("h2")], [product("h1", "5")], [product("h3")]))[1:] == ("success", 0)
    assert engine.store.version() == 1 and stored(engine)["h1"].prices[0].USD == "5"
    with pytest.raises(OSError):
        engine.ingest(Failing("aws", [product("h4")]))
    assert set(stored(engine)) == {"h1", "h2", "h3", "h4"} and not any(Path(f"{tmp_path}/o/staged").iterdir())
    error = engine.runs.where("status = 'failed'").first().error
    assert len(error.encode()) in (1999, 2000)
    monkeypatch.setattr("pricewright.engine.KEPT_VERSIONS", 1)
    engine.ingest(Fixed("aws", [product("h1", "6")] * 2))
    used = {f for f, *_ in engine.store.manifest()}
    assert used == {f.name for f in Path(f"{tmp_path}/o/products").iterdir() if f.name.startswith("v-")}

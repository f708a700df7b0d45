"""Runs over a stream: state across micro-batches, the guards at a run's end, restarts, and runs that do not end."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewright.engine import Engine
from pricewright.schema import PRICE_FIELDS
from pricewright.streaming.feed import FEED, LOST, Feed

T0 = datetime(2024, 5, 1)


def product(i, usd="1.0"):
    price = {f: usd if f == "USD" else "" for f in PRICE_FIELDS}
    return {"product_hash": f"{i:032x}", "sku": f"s{i}", "vendor_name": "aws", "region": None, "service": "x", "product_family": "f", "attributes": {"k": None, "n": str(i)}, "prices": [price]}


@pytest.fixture
def landing(spark, tmp_path):
    """A function that lands rows as one file, each newer than the one before."""
    made = []

    def land(day, products=(), failed=None):
        rows = [("aws", T0 + timedelta(days=day), None, p) for p in products] + ([("aws", T0 + timedelta(days=day), failed, None)] if failed is not None else [])
        at = f"{tmp_path}/in/{len(made):03d}"
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(at)
        made.append(at)
        for name in os.listdir(at):
            os.utime(f"{at}/{name}", (1_700_000_000 + len(made) * 10,) * 2)

    return land


def load(spark, tmp_path, **how):
    engine = Engine(spark, f"{tmp_path}/engine", lambda: T0 + timedelta(days=9))
    rows = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = Feed(engine, f"{tmp_path}/check", parts=4, **how).start(rows)
    assert query.awaitTermination(120) and query.exception() is None
    return engine


def told(engine):
    return [(r.id, r.status, r.products, r.deleted) for r in engine.runs.orderBy("id").collect()]


def test_guards_at_the_end_of_streamed_runs(spark, tmp_path, landing):
    landing(0, map(product, range(6)))
    landing(0, map(product, range(6, 10)), failed=0)
    landing(1, map(product, range(3)), failed=0)
    landing(2, map(product, range(4)))
    engine = load(spark, tmp_path)
    assert told(engine) == [(1, "success", 10, 0), (2, "success", 3, 0), (3, "running", 0, 0)] and engine.store.count() == 10
    assert not engine.store.locked("aws", T0 + timedelta(days=9))  # the run that goes on holds it
    landing(2, [*map(product, range(4, 7)), product(7, "2.0")], failed=0)  # after a restart, what was seen before it is known
    landing(3, map(product, range(5)), failed=1)
    landing(4, failed=0)
    landing(5, [product(0), product(0), product(20), product(21, "3.0")])
    landing(5, [product(0), product(21, "4.0")], failed=0)
    engine = load(spark, tmp_path)
    assert told(engine) == [(1, "success", 10, 0), (2, "success", 3, 0), (3, "success", 8, 2), (4, "success", 5, 0), (5, "failed", 0, 0), (6, "success", 6, 7)]
    held = {int(r.product_hash, 16): (r.prices[0].USD, r.updated_at) for r in engine.store.plain().collect()}
    day = lambda n: T0 + timedelta(days=n)
    assert held == {0: ("1.0", day(0)), 20: ("1.0", day(5)), 21: ("4.0", day(5))}
    assert engine.store.read().where("attributes['k'] is null and region is null and map_contains_key(attributes, 'k')").count() == 3
    assert engine.store.locked("aws")
    state = spark.read.format("statestore").option("stateVarName", "hashes").option("flattenCollectionTypes", "true").load(f"{tmp_path}/check")
    assert state.count() == 0  # what is over is forgotten


def test_a_run_that_does_not_end_is_given_up(spark, tmp_path, landing):
    landing(0, map(product, range(4)))
    engine = load(spark, tmp_path, life=timedelta(0))
    landing(1, map(product, range(2)), failed=0)
    landing(0, [product(9)], failed=0)  # too late for its run: stored, not counted
    engine = load(spark, tmp_path, life=timedelta(0))
    assert told(engine) == [(1, "failed", 0, 0), (2, "success", 2, 2)]
    assert engine.runs.where("id = 1").first().error == LOST and engine.store.count() == 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path, landing):
    landing(0, map(product, range(4)), failed=0)
    engine = load(spark, tmp_path)
    before = told(engine), engine.store.version()
    feed = Feed(engine, f"{tmp_path}/check", parts=4)
    us = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 10**6
    p = spark.createDataFrame([("aws", T0, None, product(i)) for i in range(4)], FEED).select(F.lit("product").alias("kind"), "vendor", F.lit(us).cast("long").alias("started"), "product.product_hash", F.to_json("product", {"ignoreNullFields": "false"}).alias("payload"), F.lit(None).cast("long").alias("ingested"), F.lit(None).cast("int").alias("failed"))
    end = spark.createDataFrame([("end", "aws", us, None, None, 4, 0)], p.schema)
    feed.handle(p.unionByName(end), 0)
    assert (told(engine), engine.store.version()) == before


def test_rows_without_a_run_and_an_empty_feed(spark, tmp_path):
    spark.createDataFrame([(None, T0, None, product(1)), ("aws", None, None, product(2)), ("aws", None, 0, None), ("aws", T0, None, None), ("aws", T0, None, {**product(3), "product_hash": None})], FEED).write.parquet(f"{tmp_path}/in/a")
    assert told(engine := load(spark, tmp_path)) == [] and engine.store.count() == 0

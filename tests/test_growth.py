"""What must not grow with the tables: files of one array, exchanges, and what a write puts down."""

import gzip
import json
from datetime import datetime

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pricewright.engine import Engine
from pricewright.plans import landed_rows, store, workload
from pricewright.schema import PRICE_FIELDS
from pricewright.sources import aws, landed, offers
from pricewright.streaming import feed


def test_json_arrays_are_files_of_bounded_size(spark, tmp_path):
    """eight files, whatever the table, were eight rows of all its products."""
    one = F.to_json(F.struct(F.col("id").cast("string").alias("productHash")))
    path = landed_rows._arrays(spark.range(0, 1000, 1, 3).select(one.alias("value")), f"{tmp_path}/files", 30)
    sizes = [len(json.loads(gzip.decompress(f.read_bytes()))) for f in (tmp_path / "files").glob("part-*")]
    assert sum(sizes) == 1000 and max(sizes) == 30 and len(sizes) == 36
    assert {int(r.product_hash) for r in landed.seed(spark, path).collect()} == set(range(1000))
    none = landed_rows._arrays(spark.range(0).select(one.alias("value")), f"{tmp_path}/none")
    assert landed.seed(spark, none).count() == 0


def test_products_are_grouped_with_one_narrow_exchange(spark, data):
    """lines were exchanged with every text of their product and price in a buffer of its own."""
    plan = workload.products_v(spark, data)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_partkey" in line]
    assert len(exchanges) == 1 and plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index(exchanges[0]) :]
    assert "ObjectHashAggregate" not in below and "SKU-" not in below
    narrow = workload.products_v(spark, data).where("vendor_name = 'aws' AND service = 'Brand#20'")._jdf.queryExecution().executedPlan().toString()
    assert "Brand#20" in narrow[narrow.index("Exchange hashpartitioning") :]  # filters go below it


def test_a_first_load_is_compared_with_nothing_and_empty_columns_have_no_filter(spark, tmp_path, monkeypatch):
    """F6 to F8: a first load was exchanged to be compared with no rows, written once more, and then with a filter for each empty column."""
    target = store.ProductStore(spark, f"{tmp_path}/s")
    monkeypatch.setattr(target, "_changes", None)
    key = F.sha2(F.col("id").cast("string"), 256)
    texts = {n: F.lit("x") for n in ("vendor_name", "region", "service", "product_family")}
    price = F.array(F.struct(*(F.lit("x").alias(f) for f in PRICE_FIELDS)))
    rows = spark.range(3000).select(key.alias("product_hash"), key.alias("sku"), *(c.alias(n) for n, c in texts.items()), F.create_map(F.lit("description"), key).alias("attributes"), price.alias("prices"))
    assert target.upsert(rows, F.lit("2024-01-01").cast("timestamp")) == 1 and target.count() == 3000
    columns = [c for f in (tmp_path / "s").glob("v-*/**/*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in map(g.column, range(g.num_columns))]
    assert {c.compression for c in columns} == {"ZSTD"}
    raw = b"".join(f.read_bytes() for f in (tmp_path / "s").glob("v-*/**/*.parquet"))
    assert len(raw) < len(columns) // len({c.path_in_schema for c in columns}) * 2 * store.BLOOM_BYTES + 400 * 3000


def test_azure_rows_keep_their_order_across_pages(spark, data, tmp_path):
    """with suppliers' keys from 1000 on, the order of rows was not that of the pages that held them."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CAST(l_orderkey * 7919 % 60000 AS BIGINT) AS l_suppkey) FROM '{data}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    c.execute(f"COPY (SELECT * FROM '{data}/part.parquet') TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.execute(workload.oracle_sql()["azure_products"]).fetchall()
    got = workload.queries()["azure_products"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_vendors_load_from_products_that_are_made_once(spark, data, monkeypatch):
    """each of the loads grouped all lines anew."""
    given, upsert = [], store.ProductStore.upsert
    monkeypatch.setattr(store.ProductStore, "upsert", lambda self, products, *more: (given.append(products._jdf.queryExecution().toString()), upsert(self, products, *more))[1])
    assert workload.queries()["store_two_vendors"](spark, data).count() > 0
    assert len(given) == 7 and not any("lineitem" in plan for plan in given)


def test_offers_are_grouped_by_entry_and_small_files_come_whole(spark, tmp_path, monkeypatch):
    """every price dimension was a row that was exchanged, every brace of a file one that went to Python."""
    dimension = {"unit": "h", "pricePerUnit": {"USD": "1.5"}, "beginRange": "0", "endRange": "Inf", "description": "}{\\\\\"é"}
    terms = {f"S{i}": {f"o{n}": {"priceDimensions": {"1": dimension, "2": dimension}} for n in range(50)} for i in range(20)}
    made = {"products": {k: {"sku": k, "productFamily": "f", "attributes": {}} for k in terms}, "terms": {"OnDemand": terms, "Reserved": {}}}
    for service in ("A", "B"):
        (tmp_path / f"in/service={service}").mkdir(parents=True)
    (tmp_path / "in/service=A/part-0.json").write_text(json.dumps(made, ensure_ascii=False))
    (tmp_path / "in/service=B/part-0.txt.gz").write_bytes(gzip.compress(json.dumps(made, ensure_ascii=False, indent=1).encode()))
    got = {}
    for small in (offers.SMALL, 10_000, 0):
        monkeypatch.setattr(offers, "SMALL", small)
        entries = offers.cut(spark, f"{tmp_path}/in", f"{tmp_path}/entries{small}")
        got[small] = sorted((r.service, r.kind, r.sku, json.dumps(json.loads(r.value))) for r in entries.collect())
    assert len(got[0]) == 80 and got[0] == got[10_000] == got[16 << 20]
    found = aws.products_of(entries)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and not any("Generate" in line and "priceDimensions" in line for line in plan.splitlines())
    assert [len(r.prices) for r in found.collect()] == [100] * 40


def test_braces_that_close_nothing_and_long_runs_of_backslashes():
    """the decoder works on whole pieces; what it passed over one by one it still passes over."""
    text = '}}{"products": {"A": {"x": "' + "\\\\" * 5 + '"}, "B": {"y": "\\\\\\"}{", "z": [{"products": {}}]}}}}{'
    for size in (1, 2, 5, 1000):
        decoder = offers.Decoder()
        assert [x[:2] for i in range(0, len(text), size) for x in decoder.feed(text[i : i + size])] == [("products", "A"), ("products", "B")]
        assert len(decoder.path) == 1


def test_streamed_runs_take_as_many_micro_batches_however_many_files_land(spark, data, tmp_path, monkeypatch):
    """a part table of one file that many tasks read landed as many files, and three of them were a micro-batch."""
    made, handle = [], feed.Feed.handle
    monkeypatch.setattr(feed.Feed, "handle", lambda self, batch, n: (made.append(n), handle(self, batch, n))[1])
    part = pq.read_table(f"{data}/part.parquet")
    pq.write_table(part, f"{tmp_path}/part.parquet", row_group_size=-(-part.num_rows // 8))
    split = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        found = workload.queries()["stream_runs"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = duckdb.sql(workload.oracle_sql()["stream_runs"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and len(made) == 4


def test_state_of_a_feed_is_held_in_few_stores_and_by_chunks(spark, tmp_path):
    """there were as many stores as shuffle partitions, each opened in each micro-batch, and an entry for each hash."""
    began = datetime(2024, 5, 1)
    product = {"sku": "s", "vendor_name": "aws", "region": "r", "service": "x", "product_family": "f", "attributes": {}, "prices": []}
    spark.createDataFrame([("aws", began, None, {**product, "product_hash": f"{i:032x}"}) for i in range(200)], feed.FEED).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        query = feed.Feed(Engine(spark, f"{tmp_path}/engine", lambda: began), f"{tmp_path}/check", parts=3).start(spark.readStream.schema(feed.FEED).parquet(f"{tmp_path}/in/*"))
        assert query.awaitTermination(120) and query.exception() is None and spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(p.name.isdigit() for p in (tmp_path / "check/state/0").iterdir()) == 3
    state = spark.read.format("statestore").option("stateVarName", "hashes").option("flattenCollectionTypes", "true").load(f"{tmp_path}/check")
    assert 0 < state.count() <= 12


def _loadable(spark, n, sku, family="f", first=0):
    texts = {"vendor_name": F.lit("aws"), "region": F.lit("r"), "service": F.concat(F.lit("s"), F.col("id") % 2), "product_family": F.lit(family)}
    price = F.array(F.struct(*(F.lit("x").alias(f) for f in PRICE_FIELDS)))
    key = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(first, n).select(key.alias("product_hash"), sku.alias("sku"), *(c.alias(k) for k, c in texts.items()), F.create_map(F.lit("name"), key).alias("attributes"), price.alias("prices"))


def test_a_load_that_changes_most_is_exchanged_once_some_buckets_at_a_time(spark, tmp_path, monkeypatch):
    """what changed was written down, and both it and the stored rows were exchanged whole, to files of every bucket in every task."""
    before, time = spark.conf.get(store._CLEANUP, "false"), lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    monkeypatch.setattr(store, "SENT_BYTES", 0)
    monkeypatch.setattr(store, "MERGED_BYTES", 1 << 16)
    made, laid = [], store.ProductStore._laid
    monkeypatch.setattr(store.ProductStore, "_laid", lambda self, *given: (made.append(laid(self, *given)), made[-1])[1])
    once, id_ = store.ProductStore(spark, f"{tmp_path}/s"), F.col("id")
    once.upsert(_loadable(spark, 4000, F.lit("old")), time(1))
    load = _loadable(spark, 4200, F.when(id_ % 4 == 0, "old").otherwise("new"), "other", 100)
    assert once.upsert(load, time(2)) == 2 and len(made) > 1
    assert all(d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 for d in made)
    got = {r.product_hash: (r.sku, r.product_family, r.updated_at.day) for r in once.plain().collect()}
    want = {r.h: (r.sku, r.family, r.day) for r in spark.range(4200).select(F.sha2(id_.cast("string"), 256).alias("h"), F.when((id_ < 100) | (id_ % 4 == 0), "old").otherwise("new").alias("sku"), F.when(id_ < 4000, "f").otherwise("other").alias("family"), F.when((id_ < 100) | (id_ < 4000) & (id_ % 4 == 0), 1).otherwise(2).alias("day")).collect()}
    assert got == want and once.count() == 4200
    assert spark.conf.get(store._CLEANUP, "false") == before
    assert once.upsert(load, time(3)) == 2  # nothing differs
    few = load.where(F.col("sku") == "new").limit(20).withColumn("sku", F.lit("newest"))
    n = len(made)
    assert once.upsert(few, time(4)) == 3 and len(made) == n and once.plain().where("sku = 'newest'").count() == 20
    once.drop_folders()
    assert {f.name for f in (tmp_path / "s").glob("v-*")} == {f for f, *_ in once.manifest()} and once.count() == 4200 and once._versions() == [1, 2, 3]


def test_azure_pages_are_made_and_parsed_once_and_rows_sorted_once(spark, data):
    """conditions on a page made it four times and parsed it three times, and each window sorted the rows anew."""
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = workload.queries()["azure_products"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator") == 1
    assert sum("Sort [" in line for line in plan.splitlines()) == 1 and plan.count("Exchange hashpartitioning(name") == 1


def test_an_azure_page_that_comes_twice_counts_once(spark):
    """of equal rows in equal places one stays, in virtual regions, too; a tier's place is that of its first row that stays."""
    row = {"serviceName": "VPN Gateway", "productName": "P", "skuName": "S", "meterName": "M", "type": "Consumption", "unitOfMeasure": "h", "armRegionName": "eastus", "retailPrice": 2.0, "tierMinimumUnits": 0.0}
    rows = [row, {**row, "tierMinimumUnits": 1e6}, {**row, "retailPrice": 1.0, "unitOfMeasure": "d"}, {**row, "retailPrice": 1.0, "unitOfMeasure": "m"}]
    body = json.dumps({"Items": rows, "NextPageLink": ""})
    pages = spark.createDataFrame([("s", 0, body), ("s", 0, body), ("s", 1, None), ("s", 2, "no page")], "service string, page int, body string")
    found = {r.region: [(p.unit, p.USD, p.startUsageAmount) for p in r.prices] for r in _azure(pages)}
    least = [("d", "1.0000000000", "0"), ("h", "2.0000000000", "1e+06")]
    assert found == {"eastus": [("h", "2.0000000000", "0"), least[1], ("d", "1.0000000000", "0"), ("m", "1.0000000000", "0")], "Global": least, "Zone 1": least}


def _azure(pages):
    from pricewright.sources import azure

    return azure.products(landed.azure_answers(pages)).collect()

import json
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.functions.hashing import price_hash, product_hash
from pricewright.sources import aws, azure, gcp, landed, offers, paging


def item(**given):
    base = {"unitOfMeasure": "1 GB", "serviceName": "Azure Firewall", "productName": "Azure Firewall", "serviceFamily": "Networking", "skuName": "Standard", "armSkuName": "", "meterName": "Data", "type": "Consumption", "armRegionName": "eastus", "reservationTerm": None, "retailPrice": 0.016, "tierMinimumUnits": 0.0, "isPrimaryMeterRegion": True, "currencyCode": "USD", "location": ""}
    return base | given


def made(spark, items):
    rows = spark.createDataFrame([{"Items": items, "NextPageLink": None}], azure.PAGE)
    out = {}
    for p in azure.products(azure.from_pages(rows)).collect():
        out[p.region] = (p, [(x.purchaseOption, x.startUsageAmount, x.USD) for x in p.prices])
    return out


def test_hashes(spark):
    import hashlib

    row = spark.range(1).select(product_hash(*map(F.lit, ("aws", "r", "s", "k"))).alias("a"), product_hash(F.lit("aws"), F.lit(None), F.lit("s"), F.lit("k")).alias("b"), price_hash(*map(F.lit, ("h", "o", "u", "0", "d"))).alias("c")).first()
    digest = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()[:32]
    assert row.a == digest("aws", "r", "s", "k") and row.b == digest("aws", "", "s", "k") and row.c == "h-" + digest("h", "o", "u", "0", "d", "", "", "")


def test_azure_non_primary_fills_regions(spark):
    got = made(spark, [item(armRegionName=""), item(armRegionName="eastus", isPrimaryMeterRegion=False), item(armRegionName="westeurope", isPrimaryMeterRegion=False)])
    assert {r: p for r, (_, p) in got.items()} == {r: [("Consumption", "0", "0.0160000000")] for r in ("Global", "eastus", "westeurope")}


def test_azure_primary_wins_its_slot_only(spark):
    got = made(spark, [item(retailPrice=0.99, isPrimaryMeterRegion=False), item()])
    assert got["eastus"][1] == [("Consumption", "0", "0.0160000000")]
    got = made(spark, [item(isPrimaryMeterRegion=False), item(type="Reservation", reservationTerm="1 Year", retailPrice=100.0)])
    assert [x[0] for x in got["eastus"][1]] == ["Consumption", "Reservation"]
    got = made(spark, [item(isPrimaryMeterRegion=False, tierMinimumUnits=51200.0), item()])
    assert [x[1] for x in got["eastus"][1]] == ["51200", "0"]


def test_azure_rows_that_always_count(spark):
    vm = {"serviceName": "Virtual Machines", "productName": "Virtual Machines BS Series", "skuName": "B1s", "meterName": "B1s"}
    got = made(spark, [item(**vm, retailPrice=0.0104, isPrimaryMeterRegion=False), item(**vm, retailPrice=0.0105)])
    assert [x[2] for x in got["eastus"][1]] == ["0.0104000000", "0.0105000000"]
    assert got["eastus"][0].attributes["os"] == "Linux"


def test_azure_virtual_regions_take_the_lowest_price(spark):
    dns = {"serviceName": "Azure DNS", "productName": "Azure DNS", "skuName": "Public", "meterName": "Zones"}
    got = made(spark, [item(**dns, armRegionName="eastus", retailPrice=0.5), item(**dns, armRegionName="westus", retailPrice=0.4, unitOfMeasure="other"), item(**dns, armRegionName="usgovvirginia", retailPrice=0.6), item(**dns, armRegionName="eastus", retailPrice=0.5)])
    assert set(got) == {"eastus", "westus", "usgovvirginia", "Zone 1", "US Gov Zone 1"}
    assert got["Zone 1"][1] == [("Consumption", "0", "0.4000000000")] and len(got["eastus"][1]) == 1


@pytest.mark.parametrize(("service", "name", "want"), [("Virtual Machines", "Virtual Machines Dv3 Series", "Linux"), ("Virtual Machines", "Virtual Machines Dv3 Series Windows", "Windows"), ("Virtual Machines", "NCC Srs Win", "Windows"), ("Virtual Machines", "Dasv5 Series Cloud Services", None), ("Virtual Machines", "Easv5 CloudServices", None), ("Storage", "Disk Windows", None)])
def test_azure_operating_system(spark, service, name, want):
    assert spark.range(1).select(azure.operating_system(F.lit(service), F.lit(name)).alias("x")).first().x == want


def test_azure_names_and_regions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(azure.product_name(F.lit("Virtual Machines DSv3 Series v8"))) == "Virtual Machines DSv3 Series" and one(azure.product_name(F.lit("Other v8"))) == "Other v8"
    assert one(azure.regions(F.lit("chinaeast"), F.lit("VPN Gateway"))) == ["chinaeast", "China", "Zone 1 (China)"] and one(azure.regions(F.lit("germanywest"), F.lit("Azure DNS"))) == ["germanywest", "DE Zone 1"]
    assert one(azure.regions(F.lit(None).cast("string"), F.lit("Storage"))) == ["Global"]
    assert [one(azure.is_virtual(F.lit(r))) for r in ("Zone 1", "Global", "US Gov", "DE Zone 1", "Zone 1 (China)", "eastus")] == [True] * 5 + [False]


def sku(description, region=("us-east1",), units="0", nanos=0, usage="OnDemand", service="Compute Engine", tiers=None):
    rates = tiers or [(0.0, units, nanos)]
    return {"skuId": f"{description}-{usage}", "name": "", "description": description, "category": {"serviceDisplayName": service, "resourceFamily": "Compute", "resourceGroup": "CPU", "usageType": usage}, "serviceRegions": list(region), "pricingInfo": [{"pricingExpression": {"usageUnit": "h", "tieredRates": [{"startUsageAmount": s, "unitPrice": {"currencyCode": "USD", "units": u, "nanos": n}} for s, u, n in rates]}}]}


def test_gcp_products_and_tiers(spark):
    skus = spark.createDataFrame([sku("Egress", ("a", "b"), service="Networking", tiers=[(0.0, "0", 0), (1.0, "0", 120000000), (1024.5, "x", 80000000)]), sku("none", tiers=None) | {"pricingInfo": []}], gcp.SKU)
    rows = gcp.products(skus).orderBy("region").collect()
    assert [r.region for r in rows] == ["a", "b"] and rows[0].service == "Compute Engine" and rows[0].attributes == {"description": "Egress", "resourceGroup": "CPU"}
    assert [(p.startUsageAmount, p.endUsageAmount, p.USD) for p in rows[0].prices] == [("0", "1", "0.0000000000"), ("1", "1024.5", "0.1200000000"), ("1024.5", "", "0.0800000000")]


def test_gcp_machine_types(spark):
    assert len(gcp.machine_types()) == 140 and ("n2", "n2-highmem-128", 128.0, 864.0) in gcp.machine_types() and ("n1", "n1-highcpu-96", 96.0, 86.4) in gcp.machine_types()
    skus = [sku("E2 Instance Core running in X", nanos=20000000), sku("E2 Instance Core dear", nanos=30000000), sku("E2 Instance Ram running in X", nanos=3000000), sku("E2 Instance Core Commitment", nanos=1), sku("E2 Instance Core", nanos=10000000, usage="Preemptible"), sku("N2 Instance Core", nanos=5)]
    rows = gcp.synthesized(spark, gcp.products(spark.createDataFrame(skus, gcp.SKU))).collect()
    assert {r.attributes["machineType"].split("-")[0] for r in rows} == {"e2"} and len(rows) == sum(f == "e2" for f, *_ in gcp.machine_types())
    r = next(r for r in rows if r.sku == "mt-e2-standard-4")
    assert [(p.purchaseOption, p.USD, p.startUsageAmount, p.unit, p.description) for p in r.prices] == [("OnDemand", "0.1280000000", "", "h", "e2-standard-4 in us-east1")]
    assert r.product_family == "Compute Instance"


def test_gcp_sku_that_appears_twice_stays_two_products(spark):
    twice = [sku("Egress", tiers=[(0.0, "0", 0), (1.0, "0", 120000000)])] * 2
    rows = gcp.products(spark.createDataFrame(twice, gcp.SKU).repartition(3)).collect()
    assert len(rows) == 2 and all([p.startUsageAmount for p in r.prices] == ["0", "1"] for r in rows)
    plan = gcp.products(spark.createDataFrame(twice, gcp.SKU))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def dim(usd=None, cny=None, unit="Hrs", begin="0", end="Inf", text="d"):
    return {"unit": unit, "pricePerUnit": {k: v for k, v in (("USD", usd), ("CNY", cny)) if v is not None}, "beginRange": begin, "endRange": end, "description": text}


def offer(products, on_demand=None, reserved=None):
    return {"products": products, "terms": {"OnDemand": on_demand or {}, "Reserved": reserved or {}}, "publicationDate": "x"}


def test_aws_products(spark, tmp_path):
    products = {"A": {"sku": "A", "productFamily": "DNS Domain Names", "attributes": {"location": "US East (Ohio)"}}, "B": {"sku": "B", "productFamily": "", "attributes": {"location": "Any"}}, "C": {"sku": "C", "productFamily": "x", "attributes": {}}}
    on_demand = {"A": {"A.1": {"priceDimensions": {"1": dim("0.10"), "2": dim("0.05", begin="10")}, "termAttributes": {}}}, "B": {"B.1": {"priceDimensions": {"1": dim(cny="62.069"), "2": dim(cny="bad"), "3": dim("", "0")}}}}
    reserved = {"A": {"A.2": {"priceDimensions": {"1": dim("99", unit="Quantity"), "2": dim("0.01", end="100")}, "termAttributes": {"LeaseContractLength": "1yr", "PurchaseOption": "No Upfront", "OfferingClass": "standard"}}}}
    (tmp_path / "AmazonEC2-us-east-2.json").write_text(json.dumps(offer(products, on_demand, reserved)))
    rows = {r.sku: r for r in aws.products(landed.offers(spark, f"{tmp_path}/*.json")).collect()}
    streamed = aws.products_of(offers.cut(spark, f"{tmp_path}/*.json", f"{tmp_path}/entries"))
    assert {r.sku: r for r in streamed.collect()} == rows and streamed.columns == list(rows["A"].asDict())
    plan = streamed._jdf.queryExecution().executedPlan().toString()
    assert "FileScan json" not in plan and "FileScan text" not in plan
    assert set(rows) == {"A", "B"} and rows["A"].service == "AmazonEC2" and rows["A"].region == "us-east-2" and rows["A"].product_family == "DNS Zone" and rows["B"].region == ""
    assert sorted((p.purchaseOption, p.USD, p.startUsageAmount, p.endUsageAmount, p.termLength) for p in rows["A"].prices) == [("on_demand", "0.05", "10", "", ""), ("on_demand", "0.10", "0", "", ""), ("reserved", "0.01", "0", "100", "1yr")]
    assert sorted(p.USD for p in rows["B"].prices) == ["0.0000000000", "10.0000000000"]


@pytest.mark.parametrize(("attributes", "want"), [({"regionCode": "eu-west-9", "locationType": "AWS Region", "location": "EU (X)"}, "eu-west-9"), ({"location": "EU (Ireland)"}, "eu-west-1"), ({"regionCode": "us-east-1", "locationType": "AWS Local Zone", "location": "US East (Boston)"}, "US East (Boston)"), ({"location": "Any"}, ""), ({"location": "Global"}, ""), ({}, ""), ({"location": "Somewhere"}, "Somewhere")])
def test_aws_region(spark, attributes, want):
    row = spark.createDataFrame([(attributes,)], "a map<string,string>")
    assert row.select(aws.region(F.col("a")).alias("x")).first().x == want


@pytest.mark.parametrize(("service", "attributes", "changed"), [
    ("AmazonSageMaker", {"instanceType": "ml.c6g.large-Hosting"}, {"instanceType": "ml.c6g.large"}), ("AmazonSageMaker", {"instanceType": "ml.p6-b200.48xlarge"}, {}), ("AmazonEC2", {"instanceType": "x-Hosting"}, {}),
    ("AmazonEKS", {"usagetype": "USE1-EKS-Auto:x"}, {"mode": "Auto"}), ("AmazonEKS", {"usagetype": "USE1-AmazonEKS-Hours:perCluster", "mode": ""}, {"mode": "Classic"}), ("AmazonEKS", {"usagetype": "EKS-Cluster", "mode": "Mine"}, {}), ("AmazonEKS", {"usagetype": "other"}, {}),
    ("AmazonAthena", {"operation": "QueryX"}, {"productFamily": "Query"}), ("AmazonAthena", {"usagetype": "USE1-DataScannedBytes"}, {"productFamily": "Query"}), ("AmazonAthena", {"operation": "QueryX", "productFamily": "Mine"}, {}),
])
def test_aws_normalisers(spark, service, attributes, changed):
    row = spark.createDataFrame([(attributes,)], "a map<string,string>")
    assert row.select(aws.normalized(F.col("a"), F.lit(service)).alias("x")).first().x == attributes | changed


def test_aws_region_index(spark):
    index = spark.createDataFrame([({"us-east-1": ("u1",), "us-gov-west-1": ("u2",), "us-east-1-bos-1": ("u3",), "eu-west-1": ("u4",)},)], aws.REGION_INDEX)
    assert {r.region for r in aws.proper_regions(index).collect()} == {"us-east-1", "eu-west-1"}


def test_seed_and_catalog(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"productHash": "h", "sku": "s", "vendorName": "aws", "service": "x", "attributes": {"a": "b"}, "prices": [{"USD": "1"}]}]))
    r = landed.seed(spark, f"{tmp_path}/seed.json").first()
    assert r.region == "" and r.prices[0].USD == "1" and r.prices[0].unit == ""
    for p, k in (("gcp", "b"), ("aws", "z"), ("aws", "a")):
        (tmp_path / "cat" / p).mkdir(parents=True, exist_ok=True)
        (tmp_path / "cat" / p / f"{k}.toml").write_text(f'kind = "{k}"\n')
    (tmp_path / "cat" / "aws" / "README.md").write_text("no definition")
    bundle = landed.catalog_bundle(landed.catalog(spark, f"{tmp_path}/cat"))
    assert [(e["provider"], e["kind"]) for e in bundle["entries"]] == [("aws", "a"), ("aws", "z"), ("gcp", "b")] and bundle["count"] == 3
    status, etag, body = landed.catalog_response(bundle)
    assert status == 200 and json.loads(body)["hash"] in etag and landed.catalog_response(bundle, etag) == (304, etag, "")


def test_retries_and_rate():
    calls, pauses = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise landed.Failed("busy")
        return "ok"

    assert landed.with_retries(fetch, 5, 10, pauses.append) == "ok" and pauses == [10, 20]
    with pytest.raises(landed.Failed):
        landed.with_retries(lambda: (_ for _ in ()).throw(landed.Failed("no", again=False)), 5, 1, pauses.append)
    now = [0.0]
    limit, slept = landed.RateLimit(10, 2, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))), []
    for _ in range(5):
        limit.wait()
    assert len(slept) == 3 and sum(slept) == pytest.approx(0.3)
    assert landed.odata_quoted("it's") == "'it''s'"


def test_azure_order_is_that_of_pages_however_they_are_dealt(spark):
    pages = [("B", n, [item(retailPrice=0.1 * n + 0.01 * i, isPrimaryMeterRegion=True, meterName=f"m{i}") for i in range(3)]) for n in range(40)]
    rows = spark.createDataFrame(pages, T.StructType([T.StructField("service", T.StringType()), T.StructField("page", T.IntegerType()), azure.PAGE["Items"]]))
    one = sorted((tuple(r.ord), r.retailPrice) for r in azure.from_pages(rows.coalesce(1)).collect())
    many = sorted((tuple(r.ord), r.retailPrice) for r in azure.from_pages(rows.repartition(30)).collect())
    assert one == many and [o[0][1:] for o in one] == [(n, i) for n in range(40) for i in range(3)]


def test_shares_of_a_rate_limit_hold_its_burst():
    for burst, n in ((5, 8), (5, 2), (5, 72), (1, 1)):
        shares = [landed.RateLimit(20, burst, lambda: 0.0).share(i, n) for i in range(n)]
        assert sum(s.tokens for s in shares) == burst and sum(s.rate for s in shares) == pytest.approx(20)
    now, waited = [0.0], []
    late = landed.RateLimit(20, 5, lambda: now[0], lambda s: (waited.append(s), now.__setitem__(0, now[0] + s))).share(7, 8)
    late.wait()
    late.wait()
    assert waited == [pytest.approx(0.4)] * 2


def test_services_are_read_as_many_at_once_as_the_settings_allow(spark, tmp_path):
    from pricewright.config import Settings

    for name in "ABCDE":
        (tmp_path / f"'{name}'").write_text(json.dumps({"Items": [{"retailPrice": 1.0, "serviceName": name}], "NextPageLink": ""}))
    asked = {"rate": "1000", "tries": "1", "pause": "0"}
    found = landed.pages(spark, "azure", [*"ABCDE", "Gone"], f"file://{tmp_path}/{{service}}", Settings(concurrency_azure=2), **asked)
    assert found.rdd.getNumPartitions() == 2 and landed.failed_services(found) == 1
    rows = landed.azure_answers(found).collect()
    assert sorted(r.serviceName for r in rows) == list("ABCDE") and {r.ord[0] for r in rows} == set("ABCDE")


def test_paging_data_source(spark, tmp_path):
    (tmp_path / "p2").write_text(json.dumps({"Items": [{"retailPrice": 2.0}], "NextPageLink": ""}))
    (tmp_path / "%27A%27").write_text(json.dumps({"Items": [{"retailPrice": 1.0}], "NextPageLink": f"file://{tmp_path}/p2"}))
    spark.dataSource.register(landed.Pages)
    pages = spark.read.format("pages").options(services="A;Gone", url=f"file://{tmp_path}/%2527A%2527".replace("%2527A%2527", "{service}"), tries="2", pause="0", rate="1000").load()
    rows = pages.collect()
    bodies = [json.loads(r.body) for r in rows if r.body]
    if len(bodies) == 2:
        assert bodies[1]["Items"][0]["retailPrice"] == 2.0
    assert {r.service for r in rows if r.error} >= {"Gone"} and landed.failed_services(pages) >= 1
    assert datetime


def page_files(folder, service, n, broken=()):
    """n pages with one row each, linked; those in ``broken`` are no JSON."""
    for i in range(n):
        link = f"file://{folder}/{service}-{i + 1}" if i + 1 < n else ""
        (folder / (f"'{service}'" if i == 0 else f"{service}-{i}")).write_text("{" if i in broken else json.dumps({"Items": [{"retailPrice": float(i), "serviceName": service}], "NextPageLink": link}))


ASKED = {"rate": "1000", "tries": "1", "pause": "0"}


def held(frame):
    return sorted((r.service, r.page, None if r.body is None else json.loads(r.body)["Items"][0]["retailPrice"], r.error is None) for r in frame.collect())


def test_paging_goes_on_where_it_stopped(spark, tmp_path):
    for service, n in (("A", 7), ("B", 1), ("C", 2)):
        page_files(tmp_path, service, n)
    reader = lambda **more: paging.Paging(spark, f"{tmp_path}/held", "azure", ["C", "A", "B", "A"], f"file://{tmp_path}/{{service}}", **ASKED | more)
    one = reader(most=3)
    assert one.positions() == {} and one.open() == ["A", "B", "C"] and one.landed().count() == 0
    assert one.round() == ["A"]  # stopped after page 3 of A
    assert one.positions() == {"A": (3, f"file://{tmp_path}/A-3", None), "B": (1, None, None), "C": (2, None, None)}
    for seen in ("'A'", "A-1", "A-2", "'B'", "'C'", "C-1"):
        (tmp_path / seen).unlink()  # whoever asks for them again fails
    other = reader(most=2)
    assert other.open() == ["A"]
    want = sorted([("A", i, float(i), True) for i in range(7)] + [("B", 0, 0.0, True), ("C", 0, 0.0, True), ("C", 1, 1.0, True)])
    assert held(other.read()) == want and reader().open() == [] and held(reader().read()) == want
    assert len([f for f in (tmp_path / "held" / "_at").iterdir() if f.name.isdigit()]) == 2


def test_paging_keeps_what_came_before_a_failure(spark, tmp_path):
    page_files(tmp_path, "A", 5, broken=(3,))
    page_files(tmp_path, "B", 2)
    reader = lambda: paging.Paging(spark, f"{tmp_path}/held", "azure", ["A", "B", "Gone"], f"file://{tmp_path}/{{service}}", most=2, **ASKED)
    found = reader().read()
    good = [("A", 0, 0.0, True), ("A", 1, 1.0, True), ("A", 2, 2.0, True)]
    assert held(found) == [*good, ("A", 3, None, False), ("B", 0, 0.0, True), ("B", 1, 1.0, True), ("Gone", 0, None, False)]
    assert landed.failed_services(found) == 2 and landed.azure_answers(found).count() == 5 and reader().open() == ["A", "Gone"]
    page_files(tmp_path, "A", 5)
    page_files(tmp_path, "Gone", 1)
    assert held(reader().read()) == [*good, ("A", 3, 3.0, True), ("A", 4, 4.0, True), ("B", 0, 0.0, True), ("B", 1, 1.0, True), ("Gone", 0, 0.0, True)]


def test_paging_by_tokens_and_two_readers(spark, tmp_path, monkeypatch):
    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.partition("&pageToken=")[2].removeprefix("t/") or 0)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"skus": [n], "nextPageToken": f"t/{n + 1}" if n < 4 else ""}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/{{service}}?x=1"
    reader = lambda: paging.Paging(spark, f"{tmp_path}/held", "gcp", ["S"], url, most=2, next="nextPageToken", **ASKED)
    one, other = reader(), reader()
    assert one.round() == ["S"] and one.positions() == {"S": (2, "t/2", None)}
    late = other._state()
    one.round()
    monkeypatch.setattr(other, "_state", lambda: late)
    with pytest.raises(paging.Moved):
        other.round()
    found = reader().read()
    assert [(r.page, json.loads(r.body)["skus"]) for r in found.orderBy("page").collect()] == [(i, [i]) for i in range(5)]
    server.shutdown()


def test_an_engine_reads_pages_as_a_source(spark, tmp_path):
    from pricewright.engine import Engine

    for i, service in enumerate("AB"):
        rows = [item(productName=f"P{service}{n}", meterName=f"m{n}", retailPrice=1.0 + n + i) for n in range(2)]
        (tmp_path / f"'{service}'").write_text(json.dumps({"Items": rows, "NextPageLink": ""}))
    engine = Engine(spark, f"{tmp_path}/engine")
    made = lambda answers: azure.products(landed.azure_answers(answers))
    source = lambda n, *names: paging.PagedSource("azure", paging.Paging(spark, f"{tmp_path}/pass{n}", "azure", names, f"file://{tmp_path}/{{service}}", **ASKED), made)
    with_gone = source(1, "A", "B", "Gone")
    assert engine.ingest(with_gone)[1:] == ("success", 0) and with_gone.failed_services() == 1
    stored = engine.store.count()
    assert stored > 0 and engine.ingest(source(2, "A", "B"))[1:] == ("success", 0) and engine.store.count() == stored


ODD = {
    "offerCode": "products", "notes": [{"products": {"x": {"sku": "no"}}}, "}{", '{"products": {'], "products": {'A"{': {"sku": "A", "attributes": {"t": "a } in {a text}", "u": "\\"}}, "B": {}, "é}": {"sku": "é"}},
    "terms": {"FlatRate": {"A": {"A.1": {}}}, "OnDemand": {"A": {"A.1": {"priceDimensions": {"1": {"unit": "}"}}}}, "B": {}}, "Reserved": {}}, "products2": {"Z": {}},
}


@pytest.mark.parametrize("indent", [None, 2])
def test_offers_are_cut_wherever_the_pieces_end(indent):
    text = json.dumps(ODD, indent=indent, ensure_ascii=False)
    want = [("products", k, v) for k, v in ODD["products"].items()] + [("OnDemand", k, v) for k, v in ODD["terms"]["OnDemand"].items()]
    for size in (1, 2, 3, 7, 10**6):
        decoder = offers.Decoder()
        got = [(kind, key, json.loads(v)) for i in range(0, len(text), size) for kind, key, v in decoder.feed(text[i : i + size])]
        assert got == want and not decoder.path
    decoder = offers.Decoder()
    assert len([x for x in decoder.feed(text[: text.index('"FlatRate"')])]) == 3


def test_large_offer_files_are_read_in_pieces(spark, tmp_path):
    """Files of one line, one of them compressed: every entry comes out, and little is held at any time."""
    import gzip

    n = 6000
    made = {"products": {f"S{i}": {"sku": f"S{i}", "productFamily": "f", "attributes": {"location": "EU (Ireland)", "n": "x}" * 50}} for i in range(n)}, "terms": {"OnDemand": {f"S{i}": {"o": {"priceDimensions": {"1": dim(f"{i}.5")}}} for i in range(n)}, "Reserved": {}}}
    (tmp_path / "AmazonS3.json").write_text(json.dumps(made))
    with gzip.open(tmp_path / "AmazonEC2-eu-west-1.json.gz", "wt") as f:
        json.dump(made, f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # would cut a file into many splits
    try:
        entries = offers.cut(spark, f"{tmp_path}/*.json*", f"{tmp_path}/entries")
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "100k"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.service, r.kind): r["count"] for r in entries.groupBy("service", "kind").count().collect()} == {(s, k): n for s in ("AmazonS3", "AmazonEC2") for k in ("products", "OnDemand")}
    found = aws.products_of(entries)
    assert found.count() == 2 * n and found.select("sku").distinct().count() == n
    decoder, most = offers.Decoder(), 0
    text = json.dumps(made)
    for i in range(0, len(text), 5000):
        list(decoder.feed(text[i : i + 5000]))
        most = max(most, len(decoder.held))
    assert most < 1000


def test_offers_of_one_service_and_of_no_file(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(ODD))
    assert {r.service for r in offers.cut(spark, f"{tmp_path}/x.json", f"{tmp_path}/e", "AmazonEC2").collect()} == {"AmazonEC2"}
    (tmp_path / "empty.json").write_text("{}")
    assert aws.products_of(offers.cut(spark, f"{tmp_path}/empty.json", f"{tmp_path}/f")).count() == 0

import pytest

from pricewright import config, requests
from pricewright.engine import Budget, Engine
from pricewright.schema import PRICE_FIELDS, PRODUCT
from pricewright.sources import services


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    price = lambda usd, option: tuple({"USD": usd, "unit": "h", "purchaseOption": option, "priceHash": "p"}.get(f, "") for f in PRICE_FIELDS)
    rows = [(f"h{i:02d}", f"s{i}", "aws", "r", "ec2", "f", {"b": "2", "a": str(i)}, [price(str(i), "on_demand"), price("9", "reserved")]) for i in range(12)]
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    e.seed(spark.createDataFrame(rows, PRODUCT))
    return e


QUERY = """
query Q($v: String!, $p: PriceFilter) { # a comment
  first: products(filter: {vendorName: $v, service: "ec2", attributeFilters: [{key: "a", value_regex: "/^[0-3]$/"}]}, limit: 2) { productHash ...Rest }
  other: products(filter: {vendorName: "aws", service: "ec2"}, limit: 1, offset: 3) { sku __typename reserved: prices(filter: {purchaseOption: "Reserved"}) { USD } prices(filter: $p) { price: USD unit } }
}
fragment Rest on Product { attributes { key value } prices { USD } }
"""


def test_query_with_variables_fragments_and_aliases(engine):
    got = requests.run(engine, {"query": QUERY, "variables": {"v": "aws", "p": {"unit": "none"}}})
    assert got == {"data": {
        "first": [{"productHash": f"h0{i}", "attributes": [{"key": "a", "value": str(i)}, {"key": "b", "value": "2"}], "prices": [{"USD": str(i)}, {"USD": "9"}]} for i in range(2)],
        "other": [{"sku": "s3", "__typename": "Product", "reserved": [{"USD": "9"}], "prices": []}],
    }}


@pytest.mark.parametrize("text", ["", "{", "mutation { x }", "{ products(filter: {vendorName: \"aws\"", "{ a { b { c { d { e { f { g { h { i { j { k } } } } } } } } } } }", "x" * 10_001])
def test_requests_that_are_refused_whole(engine, text):
    assert requests.run(engine, {"query": text})["data"] is None


def test_introspection_and_cycles():
    hidden = lambda q: requests.introspects(*[x[0] if i == 0 else x for i, x in enumerate(requests.Parser(q).document())])
    assert hidden("{ ...A } fragment A on Q { ...B } fragment B on Q { ...A __schema { x } }") and not hidden("{ __typename ...A } fragment A on Q { ...A }")
    operations, fragments = requests.Parser("{ a ...F } fragment F on Q { b { c ...F } }").document()
    assert requests.depth(operations[0], fragments) == 2


def test_failing_lookups_leave_the_others(engine):
    got = requests.run(engine, {"query": '{ a: products(filter: {vendorName: "aws"}) { sku } b: products(filter: {vendorName: "aws", service: "ec2"}, limit: 1) { sku } c: nothing }'})
    assert got["data"]["a"] is None and got["data"]["b"] == [{"sku": "s0"}] and [e["path"] for e in got["errors"]] == [["a"], ["c"]]


def test_batches_share_a_budget(engine):
    one = {"query": '{ products(filter: {vendorName: "aws", service: "ec2"}, limit: 5) { sku } }'}
    got = requests.batch(engine, [one] * 4, Budget(12))
    assert [len(g["data"]["products"]) if g["data"]["products"] else 0 for g in got] == [5, 5, 2, 0] and "errors" in got[3]
    with pytest.raises(requests.RequestError):
        requests.batch(engine, [one] * 51)


def test_settings(spark, tmp_path):
    s = config.load({"SCRAPE_CONCURRENCY": "6", "SCRAPE_CONCURRENCY_AWS": "3", "CNY_USD_RATE": "7.5", "ENV": "production", "MAX_BATCH_SIZE": "x"})
    assert [s.concurrency_for(v) for v in ("aws", "AZURE", "gcp", "other")] == [3, 8, 6, 6] and s.cny_per_usd == 7.5 and not s.introspection and s.batch_requests == 50
    with pytest.raises(ValueError):
        s.checked()
    made = Engine.of(spark, config.load({"PRICEWRIGHT_PATH": str(tmp_path), "MAX_BATCH_SIZE": "2", "MAX_PRODUCTS_PER_REQUEST": "7"}))
    assert made.path == str(tmp_path) and made.budget().left == 7
    with pytest.raises(requests.RequestError):
        requests.batch(made, [{"query": "{ __typename }"}] * 3)


def test_services(spark):
    assert len(services.AWS) == 64 and len(services.AZURE) == 72 and services.aws_tasks(spark, without=("AmazonEC2",)).count() == 70
    listed = spark.createDataFrame([("id1", "bigquery"), ("id2", "Compute Engine"), ("id3", "Other")], "serviceId string, displayName string")
    found = {r.name: r.id for r in services.gcp_services(spark, listed).collect()}
    assert len(found) == 10 and found["bigquery"] == "id1" and found["Compute Engine"] == "6F81-5844-456A"
    pages = spark.createDataFrame([("a", 0, "x", None), ("a", 1, "y", None), ("b", 0, None, "gone")], "service string, page int, body string, error string")
    assert {(r.service, r.pages, r.failed) for r in services.outcome(pages).collect()} == {("a", 2, False), ("b", 0, True)}

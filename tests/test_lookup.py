import itertools
import math
import random
import re
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.functions import numfmt, regex
from pricewright.model import AttributeFilter, FilterTooBroad, PriceFilter, ProductFilter
from pricewright.operators.prices import filter_prices
from pricewright.plans import query
from pricewright.schema import PRICE_FIELDS, PRODUCT

LONG = "/" + "a" * 210 + "/"


@pytest.mark.parametrize(("pattern", "value", "want"), [
    ("/test/i", "Test Value", True), ("/test/i", "TEST", True), ("/test/i", "no match here", False), ("/^aws/", "aws_instance", True), ("/^aws/", "not_aws", False),
    ("aws.*instance", "aws_instance_type", True), ("aws.*instance", "gcp_instance", False), ("/^(?!.*Excluded).*$/", "included value", True), ("/^(?!.*Excluded).*$/", "this is Excluded", False),
    (LONG, "a" * 210, False), ("/noclose", "noclose", False), ("/(unclosed/", "x", False), ("^(?!x)", "y", False), ("/^(?!.*(Spot|Low)$).*$/", "D2 Spot", False), ("/^(?!.*(Spot|Low)$).*$/", "D2", True),
    ("/(?<!IA-)Storage$/", "S3-Storage", True), ("/(?<!IA-)Storage$/", "S3-IA-Storage", False), ("/(?<!ia-)STORAGE$/i", "S3-IA-Storage", False), ("/(?<!x)/", "anything", True), ("/\\-RDS$/", "USE1-RDS", True), ("/\\-RDS$/", "RDS", True),
])
def test_description_patterns(spark, pattern, value, want):
    assert described(spark, pattern, value) is want


def described(spark, pattern, value):
    row = spark.createDataFrame([(value,)], "v string")
    return row.select(regex.description_test(pattern)(row.v).alias("x")).first().x


@pytest.mark.parametrize("ignore_case", [False, True])
def test_lookaround_as_a_plain_version(spark, ignore_case):
    """Every value of up to five signs: the first match's place, what stands before it, and excluded words."""
    words = ["".join(w) for n in range(6) for w in itertools.product("aB\n", repeat=n)]
    rows, flag = spark.createDataFrame([(w,) for w in words], "v string"), re.IGNORECASE if ignore_case else 0
    fold = str.lower if ignore_case else str
    for x, rest in itertools.product(["B", "aB", "Ba", "\n"], ["a+", "B$", "a|B", "[aB]a", "^a", "\\Ba"]):
        found = {r.v for r in rows.where(regex.description_test(f"/(?<!{x}){rest}/{'i' * ignore_case}")(rows.v)).collect()}
        hits = {w: re.search(rest.replace("$", r"\Z"), fold(w), flag) for w in words}
        assert found == {w for w, m in hits.items() if m and not fold(w)[: m.start()].endswith(fold(x))}, (x, rest)
    for x in ("aB", "B|a\n"):
        found = {r.v for r in rows.where(regex.description_test(f"/^(?!.*({x})$).*$/{'i' * ignore_case}")(rows.v)).collect()}
        assert found == {w for w in words if not any(fold(e.strip()) in fold(w) for e in x.split("|"))}


def test_ten_places_of_exact_values(spark):
    """Against Python's format, which rounds the exact value: doubles of all sizes, ties, and neighbours of ties."""
    draw = random.Random(5)
    held = [0.0, -0.0, 1 / 1024, 3 / 2048, -1e-12, 0.99999999995, 9.99999999995, 2.0**-11, 2.0**-12, 2.0**-43, 5e-11, 2.0**53, 2.0**63, 2.0**64 + 2.0**20, 1e30, -(2.0**125), 5e-324, float("inf"), float("-inf")]
    for _ in range(200_000):
        held += [draw.uniform(0, 10) ** draw.randint(-12, 12), draw.randrange(10**6) / 2 ** draw.randrange(64), round(draw.uniform(0, 100), draw.randrange(13)), struct.unpack("<d", struct.pack("<Q", draw.randrange(0x38 << 56, 0x47 << 56)))[0] * draw.choice((1, -1))]
    held += [math.nextafter(x, y) for x in (i / 2048 for i in range(1, 2048, 2)) for y in (0, 1)] + [i / 2048 for i in range(1, 2048, 2)]
    frame = spark.createDataFrame(pd.DataFrame({"x": held}))
    plan = frame.select("x", numfmt.usd_text("x").alias("t"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = plan.toPandas()
    assert [(x, t) for x, t in zip(got.x, got.t) if (abs(x) < 2.0**126 or math.isinf(x)) and f"{x:.10f}" != t] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (1e300,)], "x double").select(numfmt.usd_text("x").alias("t"), numfmt.usd_texts(F.array("x", F.lit(0.5))).alias("l"))
    assert [r.t for r in odd.collect()] == [None, None, "1" + "0" * 300 + ".0000000000"] and odd.first().l == [None, "0.5000000000"]


@pytest.mark.parametrize(("pattern", "want"), [("/^aws/i", ("^aws", True)), ("/test/", ("test", False)), ("/foo|bar/i", ("foo|bar", True)), ("bare", ("bare", False)), ("/noclosing", None), ("/a/b/i", ("a/b", True))])
def test_parse(pattern, want):
    assert regex.parse(pattern) == want


def test_prefix_and_translation():
    assert regex.optional_prefix("\\-RDS") == "(^|-)RDS" and regex.optional_prefix("\\-") == "(^|-)" and regex.optional_prefix("RDS\\-") == "RDS\\-"
    assert regex.to_java("a$", False) == "(?s)a\\z" and regex.to_java("a\\$", True) == "(?is)a\\$" and regex.to_java("(a$|b)[$]", False) == "(?s)(a\\z|b)[$]"
    with pytest.raises(ValueError):
        regex.attribute_pattern("x" * 201)


@pytest.mark.parametrize(("x", "general", "plain", "ten"), [(51200.0, "51200", "51200", "51200.0000000000"), (1e6, "1e+06", "1000000", "1000000.0000000000"), (0.5, "0.5", "0.5", "0.5000000000"), (1234567.0, "1.234567e+06", "1234567", "1234567.0000000000"), (0.00001, "1e-05", "0.00001", "0.0000100000"), (0.0, "0", "0", "0.0000000000"), (2.5e-11, "2.5e-11", "0.000000000025", "0.0000000000")])
def test_numbers(spark, x, general, plain, ten):
    assert (numfmt.general(x), numfmt.plain(x), spark.range(1).select(numfmt.usd_text(F.lit(x)).alias("t")).first().t) == (general, plain, ten)


@pytest.mark.parametrize(("pattern", "value", "want"), [
    ("^[[:digit:]]+$", "123", True), ("^[[:digit:]]+$", "dig", False), ("/^[^[:space:]]+$/", "a b", False), ("/^[^[:space:]]+$/", "ab", True), ("/^[[:upper:][:digit:]_]+$/", "A_1", True), ("/^[]x[:alpha:]-]+$/", "a]-x", True),
    ("/\\mlarge\\M/", "m5 large x", True), ("/\\mlarge\\M/", "xlarge", False), ("/[[:<:]]m5/", "a.m5", True), ("/[[:<:]]m5/", "am5", False), ("/\\yfoo\\Y/", "foobar", True), ("/(a$|b)/", "a\n", False), ("/(a$|b)/", "xa", True), ("/^[a&&b]$/", "&", True),
])
def test_attribute_patterns_of_the_store(spark, pattern, value, want):
    row = spark.createDataFrame([(value,)], "v string")
    assert row.select(regex.rlike(row.v, regex.attribute_pattern(pattern)).alias("x")).first().x is want


@pytest.mark.parametrize(("pattern", "value", "want"), [("/^[[:digit:]]+$/", "12", True), ("/^[[:digit:]]+$/", "dig", False), ("/[[:nothing:]]/", "n", False), ("/(a$|b)/", "a\n", False), ("/^(?!.*Spot)[[:alpha:] ]+$/", "On Demand", True), ("/^(?!.*Spot)[[:alpha:] ]+$/", "D2", False)])
def test_description_patterns_with_classes(spark, pattern, value, want):
    assert described(spark, pattern, value) is want


def price(**given):
    return tuple(given.get(f, "") for f in PRICE_FIELDS)


@pytest.fixture(scope="module")
def products(spark):
    values = ["m5.xlarge", "M5.XLARGE", 'Quote"d\\Back', "", "unicode é ü", "<&>", " padded ", None]
    rows = []
    for i, v in enumerate(values):
        attributes = {} if v is None else {"k": v}
        if i == 1:
            attributes["usagetype"] = "Global-x"
        rows.append((f"h{i}", f"s{i}", "aws", "r1" if i < 5 else "", "ec2", "f", attributes, [price(purchaseOption=["on_demand", "On-Demand", "reserved"][i % 3], unit="h", USD=str(i), startUsageAmount=["", "0", "10"][i % 3], description=f"line\n{i}")]))
    return spark.createDataFrame(rows, PRODUCT).cache()


def hashes(df):
    return [r.product_hash for r in df.select("product_hash").collect()]


@pytest.mark.parametrize("value", ["m5.xlarge", "M5.XLARGE", 'Quote"d\\Back', "", "unicode é ü", "<&>", " padded "])
def test_attribute_equality(products, value):
    found = hashes(query.plan_products(products, ProductFilter("aws", attribute_filters=(AttributeFilter("k", value),))))
    assert len(found) == 1


def test_optional_predicates(products):
    run = lambda **f: hashes(query.plan_products(products, ProductFilter(**f)))
    assert len(run()) == 8 and run(region="") == ["h5", "h6", "h7"] and run(region="r1") == ["h0", "h2", "h3", "h4"]
    both = (AttributeFilter("k", "m5.xlarge"), AttributeFilter("k", "<&>"))
    assert run(attribute_filters=both) == []
    assert run(attribute_filters=(AttributeFilter("k", None, "/^m5/i"),)) == ["h0", "h1"]
    assert len(run(attribute_filters=(AttributeFilter("k", None, "/open"),))) == 8 == len(run(attribute_filters=(AttributeFilter("k"),)))
    assert run(limit=2, offset=3) == ["h3", "h4"] and run(limit=2, offset=3, after_hash="h5") == ["h6", "h7"] and len(run(offset=-4)) == 8
    assert [query.effective_limit(n) for n in (0, -1, 10, 5000, 999999, None)] == [5000, 5000, 10, 5000, 5000, 5000]
    with pytest.raises(ValueError):
        run(attribute_filters=(AttributeFilter("k", None, "y" * 300),))


@pytest.mark.parametrize("f", [ProductFilter(), ProductFilter("aws"), ProductFilter(service="x"), ProductFilter("", "x"), ProductFilter("aws", ""), ProductFilter("", "")])
def test_guard(f):
    with pytest.raises(FilterTooBroad):
        query.guard(f)


@pytest.mark.parametrize(("f", "left"), [
    (PriceFilter(purchase_option="ondemand"), 6), (PriceFilter(purchase_option="On_Demand"), 6), (PriceFilter(start_usage_amount="0"), 6), (PriceFilter(start_usage_amount=""), 0), (PriceFilter(start_usage_amount="0.0"), 0),
    (PriceFilter(unit="H"), 0), (PriceFilter(description_regex="/^line$/"), 0), (PriceFilter(description_regex="/line.1/"), 0), (PriceFilter(description_regex="/1$/"), 1), (PriceFilter(description_regex="/(bad/"), 0),
    (PriceFilter(description_regex="/^(?!.*2).*/"), 7), (PriceFilter(), 8), (None, 8), (PriceFilter(end_usage_amount=""), 8), (PriceFilter(term_length="1yr"), 0),
])
def test_price_filters_keep_products(products, f, left):
    rows = filter_prices(products, f).collect()
    assert len(rows) == 8 and sum(len(r.prices) for r in rows) == left


def test_pushdown_reaches_the_scan(products, tmp_path):
    products.write.parquet(f"{tmp_path}/p")
    stored = products.sparkSession.read.parquet(f"{tmp_path}/p")
    products.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = query.matching(stored, ProductFilter("aws", "ec2", region="r1")).select("product_hash", "prices.USD")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vendor_name,aws)" in plan and "EqualTo(region,r1)" in plan and "prices:array<struct<USD:string>>" in plan and "sku" not in plan.split("ReadSchema")[1]


def test_attributes_sorted(products):
    rows = query.sorted_attributes(products.where("product_hash = 'h1'")).first()
    assert [tuple(x) for x in rows.attributes] == [("k", "M5.XLARGE"), ("usagetype", "Global-x")]

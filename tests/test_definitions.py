import json

import pytest

from pricewright.plans import definitions as D

SAMPLE = '''
kind = "demo_server"
display_name = "Demo server"
provider = "aws"
[mappings.box]
service = "DemoCompute"
product_family = "Box"
attribute_filters = [
  { key = "size", expr = 'default(box_size, "b.small")' },
  { key = "mode", expr = 'pick(default(spread, false), "Multi", "Single")' },
  { key = "net", const = "open" },
]
[[dimensions]]
id = "hours"
unit = "hours"
quantity = "monthly_hours() * default(count, 1)"
rate = 'price("box")'
[[dimensions]]
id = "disk"
unit = "GB"
quantity = 'sum_field(disks, "gb")'
rate = "0.1"
when = "count_blocks(disks) > 0"
[fixture]
attributes = { count = 2 }
expected_monthly_cost = 146
exact = true
'''


def value(spark, expression: str, attributes: dict, prices: dict | None = None):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(json.dumps(attributes), prices or {})], "a string, p map<string,double>")
    return row.select(D.Compiler(F.col("a"), F.col("p")).build(D.Parser(expression).whole()).column.alias("x")).first().x


CASES = [
    ("1 + 2 * 3", {}, 7.0), ("(1 + 2) * 3 - 4 / 2", {}, 7.0), ('"a" + string(3) + "b"', {}, "a3b"), ('default(x, 5) + 1', {"x": 2}, 3.0), ('default(x, default(y, "z"))', {}, "z"),
    ('pick(default(x, false), "yes", "no")', {"x": True}, "yes"), ('default(x, "q") == "q" ? 1 : 2', {}, 1.0), ('x > 3 and not (y == "b")', {"x": 4, "y": "a"}, True), ("x > 3 || false", {}, False),
    ('let a = default(x, 2); let b = a * 2; a + b', {}, 6.0), ("count_blocks(x)", {"x": [{}, {}]}, 2.0), ("count_blocks(x)", {}, 0.0), ("count_blocks(x)", {"x": {"k": 1}}, 1.0), ('sum_field(x, "g")', {"x": [{"g": 1.5}, {"g": 2}, {}]}, 3.5),
    ('split("a.b.c", ".")[1]', {}, "b"), ('last(split(x, "-"))', {"x": "p-q-r"}, "r"), ('float(split("P1_v2", "_v")[1]) + 1', {}, 3.0), ("len(x)", {"x": [1, 2, 3]}, 3.0), ('len("four")', {}, 4.0),
    ('upper("ab") + lower("CD")', {}, "ABcd"), ('replace("a_b_c", "_", "-")', {}, "a-b-c"), ('strip_prefix("Standard_D2", "Standard_")', {}, "D2"), ('trimSuffix("10Gi", "Gi")', {}, "10"), ('x | default("d")', {}, "d"),
    ('toJSON(x) contains "arm64"', {"x": ["arm64"]}, True), ('x startsWith "Pre" and x endsWith "LRS"', {"x": "Premium_LRS"}, True), ('x in ["a", "b"]', {"x": "b"}, True), ('x not in ["a"]', {"x": "b"}, True), ('x matches "^[0-9]+$"', {"x": "42"}, True),
    ('{"a": 1, "b": 2}[x] ?? 9', {"x": "b"}, 2.0), ('{"a": 1}[x] ?? 9', {"x": "q"}, 9.0), ('x?.y ?? "none"', {"x": {"y": "deep"}}, "deep"), ('x?.y ?? "none"', {}, "none"), ('x[0].size', {"x": [{"size": 7}]}, "7"),
    ('cluster_config_instance_type', {"cluster_config": {"instance_type": "m5"}}, "m5"), ("monthly_hours()", {}, 730.0), ("-x + 1", {"x": 3}, -2.0), ('x == nil', {}, True), ('type(x)', {"x": "s"}, "string"), ("7 / 2", {}, 3.5),
]


@pytest.mark.parametrize(("expression", "attributes", "want"), CASES)
def test_expressions(spark, expression, attributes, want):
    assert value(spark, expression, attributes) == want


def test_definition_costs_resources(spark):
    d = D.parse(SAMPLE)
    rows = spark.createDataFrame([("a", '{"count": 2}', {"box": 0.1}), ("b", '{"disks": [{"gb": 100}], "spread": true}', {"box": 0.2}), ("c", "{}", {})], "id string, attributes string, prices map<string,double>")
    got = {r.id: r.monthly_cost for r in D.monthly_cost(rows, d).collect()}
    assert got == pytest.approx({"a": 146.0, "b": 156.0, "c": 0.0})
    assert D.fixture_holds(got["a"], d.fixture) and not D.fixture_holds(147, d.fixture)
    f = D.filter_values(rows, d.mappings[0]).where("id = 'b'").first().filters
    assert f == {"size": "b.small", "mode": "Multi", "net": "open"}
    assert d.mappings[0].product_filter("aws", f, "eu-west-1").attribute_filters[2].value == "open"
    plan = D.monthly_cost(rows, d)._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("wrong", ["1 +", "f(1", "a ? b", "@", "x | 3"])
def test_wrong_expressions_are_refused(wrong):
    with pytest.raises(D.DefinitionError):
        D.Parser(wrong).whole()


def test_free_kinds():
    assert D.free_kinds('[kinds]\ndemo_role = "no charge"\n') == {"demo_role": "no charge"}

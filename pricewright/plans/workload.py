"""The operators as named queries over the star-schema tables, which stand in for price lists, and SQL that agrees.

Products are the distinct pairs of part and supplier in ``lineitem``: vendor from the part's key, brand as service,
type as family, the supplier's nation as region, and a price for each line. Runs of vendors come from ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.functions.hashing import price_hash, product_hash
from pricewright.model import AttributeFilter, PriceFilter, ProductFilter
from pricewright.operators import prices as P
from pricewright.plans import query, runs, store
from pricewright.schema import PRICE_FIELDS

NOW = "2024-01-31 00:00:00"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their parts, suppliers and nations.

    These are joined without hints: Spark broadcasts those that are small by its own threshold.
    """
    line = _table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    part = _table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = _table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = _table(spark, d, "nation").select("n_nationkey", "n_name")
    return line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def _product() -> list[Column]:
    """The fields of a row's product."""
    key = F.col("l_partkey")
    vendor = F.when(key % 3 == 0, "aws").when(key % 3 == 1, "azure").otherwise("gcp")
    sku = F.concat(F.lit("SKU-"), key.cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return [key, F.col("l_suppkey"), vendor.alias("vendor_name"), F.col("p_brand").alias("service"), F.col("p_type").alias("product_family"), F.col("n_name").alias("region"), sku.alias("sku"), F.col("p_name"), F.col("p_size")]


def _price(of: Callable[[str], Column]) -> dict[str, Column]:
    """The fields of a price, of a line whose columns ``of`` gives."""
    number, flag, status = of("l_linenumber"), of("l_returnflag"), of("l_linestatus")
    return {
        "purchaseOption": F.when(flag == "N", "on_demand").when(flag == "A", "OnDemand").otherwise("reserved"), "unit": status, "USD": of("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "startUsageAmount": F.when(number == 1, "").otherwise((number - 1).cast("string")),
        "description": F.concat_ws(" ", flag, status, number.cast("string")), "termLength": F.when(flag == "R", "1yr").otherwise(""),
    }


def lines_v(spark: SparkSession, d: str) -> DataFrame:
    """A row for each price: the product's fields and the price's."""
    return _joined(spark, d).select(*_product(), "l_linenumber", *(c.alias(n) for n, c in _price(F.col).items()))


def products_v(spark: SparkSession, d: str) -> DataFrame:
    """Products with their nested prices, in the order of the prices' fields. Filters on a product go below the grouping.

    Few lines share a product, so lines are exchanged as they are, once and by part, and become texts after that.
    """
    line = ("l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    own = ("l_partkey", "l_suppkey", "p_brand", "p_type", "n_name", "p_name", "p_size")
    grouped = _joined(spark, d).select(*own, *line).repartition("l_partkey").groupBy(*own).agg(F.collect_list(F.struct(*line)).alias("lines"))
    price = F.sort_array(F.transform("lines", lambda x: F.struct(*(c.alias(n) for n, c in _price(lambda name: x[name]).items()))))
    rows = grouped.select(*_product(), price.alias("prices"))
    usage = F.concat(F.when(F.col("l_suppkey") % 10 == 0, "Global-").otherwise(""), F.col("p_name"))
    base = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("usagetype"), usage)
    attributes = F.when(F.col("p_size") % 2 == 0, F.map_concat(base, F.create_map(F.lit("os"), F.lit("Linux")))).otherwise(base)
    full = F.transform("prices", lambda p: F.struct(F.lit("").alias("priceHash"), *((p[f] if f in ("purchaseOption", "unit", "USD", "startUsageAmount", "description", "termLength") else F.lit("")).alias(f) for f in PRICE_FIELDS[1:])))
    hash_ = product_hash(F.col("vendor_name"), F.col("region"), F.col("service"), F.col("sku"))
    return rows.select(hash_.alias("product_hash"), "sku", "vendor_name", "region", "service", "product_family", attributes.alias("attributes"), full.alias("prices"), "l_partkey", "l_suppkey")


#: The same rows for DuckDB.
LINES = """lines_v AS (
SELECT l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS vendor_name, p_brand AS service, p_type AS product_family, n_name AS region,
 'SKU-' || l_partkey || '-' || l_suppkey AS sku, p_name, p_size, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'on_demand' WHEN 'A' THEN 'OnDemand' ELSE 'reserved' END AS "purchaseOption",
 l_linestatus AS unit, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS "USD", CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS "startUsageAmount",
 l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber AS description, CASE WHEN l_returnflag = 'R' THEN '1yr' ELSE '' END AS "termLength"
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
PRODUCTS = f"""WITH {LINES}, products_v AS (
SELECT substr(sha256(concat_ws(chr(0), vendor_name, region, service, sku)), 1, 32) AS product_hash, sku, vendor_name, region, service, product_family, p_name AS a_name, CAST(p_size AS VARCHAR) AS a_size,
 CASE WHEN l_suppkey % 10 = 0 THEN 'Global-' ELSE '' END || p_name AS a_usagetype, CASE WHEN p_size % 2 = 0 THEN 'Linux' END AS a_os, l_partkey, l_suppkey
FROM (SELECT DISTINCT l_partkey, l_suppkey, vendor_name, service, product_family, region, sku, p_name, p_size FROM lines_v)),
prices_v AS (SELECT product_hash, products_v.sku, products_v.vendor_name, products_v.region, products_v.service, lines_v.* EXCLUDE (sku, vendor_name, region, service) FROM products_v JOIN lines_v USING (l_partkey, l_suppkey))
"""
RUNS = f"""WITH runs_v AS (SELECT event_id AS id, 'v' || user_id AS vendor, ts AS finished_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) AS products FROM events)
"""


def runs_v(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "running").otherwise("success")
    return _table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vendor"), F.col("ts").alias("finished_at"), status.alias("status"), F.floor("value").cast("long").alias("products"))


def _add(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


_FLAT = ("product_hash", "sku", "vendor_name", "region", "service", "product_family")
_COLS = ", ".join(_FLAT)


def _looked_up(name: str, f: ProductFilter, where: str, tail: str = "ORDER BY product_hash LIMIT 5000") -> None:
    """A lookup as a query, its flat columns shown."""
    _add(name, f"{PRODUCTS} SELECT {_COLS} FROM products_v WHERE {where} {tail}")(lambda spark, d, f=f: query.plan_products(products_v(spark, d), f).select(*_FLAT))


_HERE = {"vendor_name": "aws", "service": "Brand#20", "region": "NATION_9"}
_IN = "vendor_name = 'aws' AND service = 'Brand#20'"
_OWN = "NOT starts_with(a_usagetype, 'Global')"
_looked_up("filter_equality", ProductFilter(vendor_name="aws", service="Brand#20", product_family="STANDARD"), f"{_IN} AND product_family = 'STANDARD'")
_looked_up("filter_region_excludes_global", ProductFilter(**_HERE), f"{_IN} AND region = 'NATION_9' AND {_OWN}")
_looked_up("filter_attr_containment", ProductFilter("aws", "Brand#20", attribute_filters=(AttributeFilter("os", "Linux"),)), f"{_IN} AND a_os = 'Linux'")
_looked_up("filter_same_key_two_values", ProductFilter("aws", "Brand#20", attribute_filters=(AttributeFilter("os", "Linux"), AttributeFilter("os", "Windows"))), f"{_IN} AND a_os = 'Linux' AND a_os = 'Windows'")
_looked_up("filter_two_keys", ProductFilter("aws", "Brand#20", attribute_filters=(AttributeFilter("os", "Linux"), AttributeFilter("size", "4"))), f"{_IN} AND a_os = 'Linux' AND a_size = '4'")
_looked_up("filter_regex_classes", ProductFilter("aws", attribute_filters=(AttributeFilter("usagetype", value_regex="/^[[:upper:]][[:alpha:]]+\\-.* \\mbolt$/"),)), "vendor_name = 'aws' AND regexp_matches(a_usagetype, '^[A-Z][A-Za-z]+-.* bolt$')")
_looked_up("filter_attr_regex", ProductFilter("aws", attribute_filters=(AttributeFilter("name", value_regex="/^(red|old) .*t$/"),)), "vendor_name = 'aws' AND regexp_matches(a_name, '^(red|old) .*t$')")
_looked_up("filter_attr_regex_ci", ProductFilter("aws", attribute_filters=(AttributeFilter("usagetype", value_regex="/^gLOBAL-.*BOLT/i"),)), "vendor_name = 'aws' AND regexp_matches(a_usagetype, '^gLOBAL-.*BOLT', 'i')")
_looked_up("filter_regex_prefix_norm", ProductFilter("gcp", attribute_filters=(AttributeFilter("usagetype", value_regex="/\\-small [bg]/"),)), "vendor_name = 'gcp' AND regexp_matches(a_usagetype, '(^|-)small [bg]')")
_looked_up("filter_regex_malformed_skipped", ProductFilter("aws", "Brand#20", attribute_filters=(AttributeFilter("name", value_regex="/unclosed"),)), _IN)
_looked_up("filter_value_before_regex", ProductFilter("aws", "Brand#20", attribute_filters=(AttributeFilter("os", "Linux", "/nothing/"),)), f"{_IN} AND a_os = 'Linux'")
_looked_up("filter_sku", ProductFilter(sku="SKU-1616-79"), "sku = 'SKU-1616-79'")
_looked_up("page_limit", ProductFilter("azure", limit=100), "vendor_name = 'azure'", "ORDER BY product_hash LIMIT 100")
_looked_up("page_offset", ProductFilter("azure", limit=100, offset=250), "vendor_name = 'azure'", "ORDER BY product_hash LIMIT 100 OFFSET 250")
_looked_up("page_keyset", ProductFilter("azure", limit=100, offset=7, after_hash="8"), "vendor_name = 'azure' AND product_hash > '8'", "ORDER BY product_hash LIMIT 100")


def _prices(f: ProductFilter, p: PriceFilter | None):
    """A lookup with its nested prices exploded; products without a price keep a row."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = P.filter_prices(query.matching(products_v(spark, d), f), p).select("product_hash", F.explode_outer("prices").alias("p"))
        return found.select("product_hash", *(F.col(f"p.{c}").alias(c.lower()) for c in ("purchaseOption", "unit", "USD", "startUsageAmount", "description")))

    return run


def _price_sql(where: str, price: str, join: str = "LEFT JOIN") -> str:
    return f"""{PRODUCTS} SELECT p.product_hash, x."purchaseOption" AS purchaseoption, x.unit AS unit, x."USD" AS usd, x."startUsageAmount" AS startusageamount, x.description AS description
FROM products_v p {join} prices_v x ON p.product_hash = x.product_hash AND {price} WHERE {where}"""


_WIDE, _P_IN = ProductFilter("aws", "Brand#20"), "p.vendor_name = 'aws' AND p.service = 'Brand#20'"
_add("price_filter_option_normalised", _price_sql(_P_IN, """lower(replace(replace(x."purchaseOption", '-', ''), '_', '')) = 'ondemand'"""))(_prices(_WIDE, PriceFilter(purchase_option="on-demand")))
_add("price_filter_start_zero", _price_sql(_P_IN, """CASE WHEN x."startUsageAmount" = '' THEN '0' ELSE x."startUsageAmount" END = '0'"""))(_prices(_WIDE, PriceFilter(start_usage_amount="0")))
_add("price_filter_multi", _price_sql(_P_IN, """x.unit = 'O' AND x."purchaseOption" = 'reserved' AND x."termLength" = '1yr' """))(_prices(_WIDE, PriceFilter("reserved", "O", term_length="1yr")))
_add("price_filter_description", _price_sql(_P_IN, "x.description = 'A F 2'"))(_prices(_WIDE, PriceFilter(description="A F 2")))
_add("price_filter_description_regex", _price_sql(_P_IN, "regexp_matches(x.description, '^[ar] f [1-3]$', 'i')"))(_prices(_WIDE, PriceFilter(description_regex="/^[ar] f [1-3]$/i")))
_add("price_filter_regex_malformed", _price_sql(_P_IN, "false"))(_prices(_WIDE, PriceFilter(description_regex="/unclosed")))
_add("description_regex_lookahead", _price_sql(_P_IN, "NOT contains(x.description, 'O')"))(_prices(_WIDE, PriceFilter(description_regex="/^(?!.*O).*$/")))
_add("description_regex_lookbehind", _price_sql(_P_IN, "regexp_matches(x.description, '[0-9]$') AND NOT contains(x.description, 'F ')"))(_prices(_WIDE, PriceFilter(description_regex="/(?<!F )[0-9]$/")))


@_add("products_without_matching_prices", f"""{PRODUCTS} SELECT p.product_hash, CAST(count(x.description) AS BIGINT) AS n_prices FROM products_v p LEFT JOIN prices_v x ON p.product_hash = x.product_hash AND x.description = 'R O 7' WHERE p.vendor_name = 'gcp' GROUP BY 1""")
def _(spark, d):
    found = P.filter_prices(query.matching(products_v(spark, d), ProductFilter("gcp")), PriceFilter(description="R O 7"))
    return found.select("product_hash", F.size("prices").cast("long").alias("n_prices"))


@_add("attributes_exploded_sorted", f"""{PRODUCTS} SELECT product_hash, list_position(list_sort([x.k FOR x IN kv IF x.v IS NOT NULL]), e.k) - 1 AS pos, e.k AS key, e.v AS value
FROM (SELECT product_hash, [{{'k': 'name', 'v': a_name}}, {{'k': 'os', 'v': a_os}}, {{'k': 'size', 'v': a_size}}, {{'k': 'usagetype', 'v': a_usagetype}}] AS kv FROM products_v WHERE vendor_name = 'aws'), unnest(kv) AS t(e) WHERE e.v IS NOT NULL""")
def _(spark, d):
    rows = query.sorted_attributes(query.matching(products_v(spark, d), ProductFilter("aws")))
    return rows.select("product_hash", F.posexplode("attributes").alias("pos", "e")).select("product_hash", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


@_add("product_hash", f"{PRODUCTS} SELECT sku, region, product_hash FROM products_v")
def _(spark, d):
    return products_v(spark, d).select("sku", "region", "product_hash")


@_add("price_hash", f"""{PRODUCTS} SELECT product_hash, description, product_hash || '-' || substr(sha256(concat_ws(chr(0), product_hash, "purchaseOption", unit, "startUsageAmount", description, "termLength", '', '')), 1, 32) AS price_hash FROM prices_v""")
def _(spark, d):
    rows = lines_v(spark, d).withColumn("product_hash", product_hash(F.col("vendor_name"), F.col("region"), F.col("service"), F.col("sku")))
    h = price_hash(F.col("product_hash"), F.col("purchaseOption"), F.col("unit"), F.col("startUsageAmount"), F.col("description"), F.col("termLength"))
    return rows.select("product_hash", "description", h.alias("price_hash"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("l_partkey", "l_suppkey", F.col("purchaseOption").alias("purchaseoption"), "unit", F.col("USD").alias("usd"), F.col("startUsageAmount").alias("startusageamount"), "description")


_SHOW_SQL = 'l_partkey, l_suppkey, "purchaseOption" AS purchaseoption, unit, "USD" AS usd, "startUsageAmount" AS startusageamount, description'
_KEY = ["l_partkey", "l_suppkey"]


@_add("slot_coverage", f"""WITH {LINES}, f AS (SELECT *, description LIKE '%F%' OR l_linenumber = 2 AS auth FROM lines_v), w AS (SELECT *, max(auth::INT) OVER (PARTITION BY l_partkey, "purchaseOption", "startUsageAmount", "termLength") AS covered FROM f)
SELECT {_SHOW_SQL} FROM w WHERE auth OR covered = 0""")
def _(spark, d):
    rows = lines_v(spark, d).withColumn("authoritative", F.col("description").contains("F") | (F.col("l_linenumber") == 2))
    return _shown(P.slot_coverage(rows, ["l_partkey"], ("purchaseOption", "startUsageAmount", "termLength")))


@_add("dedup_exact", f"""WITH {LINES}, w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, "purchaseOption", unit, "startUsageAmount", "termLength" ORDER BY description, "USD", l_suppkey) AS n FROM lines_v) SELECT {_SHOW_SQL} FROM w WHERE n = 1""")
def _(spark, d):
    return _shown(P.dedup_exact(lines_v(spark, d), ["l_partkey"], [F.col("description"), F.col("USD"), F.col("l_suppkey")], ("purchaseOption", "unit", "startUsageAmount", "termLength")))


@_add("dedup_tier_min", f"""WITH {LINES}, w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, "purchaseOption", "startUsageAmount", "termLength" ORDER BY CAST("USD" AS DOUBLE), description, l_suppkey) AS n FROM lines_v) SELECT {_SHOW_SQL} FROM w WHERE n = 1""")
def _(spark, d):
    return _shown(P.dedup_tier_min(lines_v(spark, d), ["l_partkey"], [F.col("description"), F.col("l_suppkey")]))


@_add("grouped_prices", f"""WITH {LINES} SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n_prices, min("USD") AS first_usd, string_agg("USD", ',' ORDER BY "USD") AS all_usd FROM lines_v GROUP BY 1, 2""")
def _(spark, d):
    rows = P.collected(lines_v(spark, d), _KEY, [F.col("USD")], ("USD",))
    usd = F.transform("prices", lambda p: p["USD"])
    return rows.select(*_KEY, F.size("prices").cast("long").alias("n_prices"), F.get(usd, 0).alias("first_usd"), F.array_join(usd, ",").alias("all_usd"))


@_add("max_nonzero_price", f"""{PRODUCTS} SELECT product_hash, max(CAST("USD" AS DOUBLE)) FILTER (WHERE CAST("USD" AS DOUBLE) <> 0) AS max_usd FROM prices_v GROUP BY 1""")
def _(spark, d):
    lines = lines_v(spark, d).select(*_KEY, "vendor_name", "region", "service", "sku", "USD")  # of a price, only what is asked for
    rows = P.collected(lines, [*_KEY, "vendor_name", "region", "service", "sku"], [F.col("USD")], ("USD",))
    return rows.select(product_hash(F.col("vendor_name"), F.col("region"), F.col("service"), F.col("sku")).alias("product_hash"), P.max_nonzero_price(F.col("prices")).alias("max_usd"))


@_add("tier_end_lead", """WITH s AS (SELECT DISTINCT l_partkey, l_linenumber AS tier FROM lineitem) SELECT l_partkey, CAST(tier AS VARCHAR) AS tier, coalesce(CAST(lead(tier) OVER (PARTITION BY l_partkey ORDER BY tier) AS VARCHAR), '') AS tier_end FROM s""")
def _(spark, d):
    sets = _table(spark, d, "lineitem").groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_set("l_linenumber")), lambda x: x.cast("string")).alias("s"))
    return sets.select("l_partkey", F.explode(F.arrays_zip(F.col("s").alias("tier"), P.tier_ends(F.col("s")).alias("tier_end"))).alias("x")).select("l_partkey", "x.tier", "x.tier_end")


@_add("region_lookup_broadcast", """SELECT s_suppkey, CASE n_name WHEN 'NATION_1' THEN 'us-east-1' WHEN 'NATION_2' THEN 'eu-west-1' WHEN 'NATION_9' THEN 'ap-south-1' ELSE n_name END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, d):
    names = {"NATION_1": "us-east-1", "NATION_2": "eu-west-1", "NATION_9": "ap-south-1"}
    from pricewright.sources.aws import literal_map

    rows = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.coalesce(F.try_element_at(literal_map(names), F.col("n_name")), F.col("n_name")).alias("region"))


def _before_after(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and a load: parts of even keys were there; those divisible by 3 come, some dearer, some the same."""
    part = _table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    price = lambda usd: F.array(F.struct(*((F.lit("") if f != "USD" else usd).alias(f) for f in PRICE_FIELDS)))
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    shape = lambda df, usd: df.select(F.col("p_partkey").cast("string").alias("product_hash"), F.col("p_name").alias("sku"), F.lit("aws").alias("vendor_name"), F.lit("r").alias("region"), F.lit("s").alias("service"), F.lit("f").alias("product_family"), F.create_map(F.lit("name"), F.col("p_name")).alias("attributes"), price(usd).alias("prices"))
    old = shape(part.where("p_partkey % 2 = 0"), money(F.col("p_retailprice"))).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new = shape(part.where("p_partkey % 3 = 0"), F.when(F.col("p_partkey") % 4 == 0, F.lit("1.00")).otherwise(money(F.col("p_retailprice"))))
    return old, new


_MERGE = """WITH o AS (SELECT p_partkey AS k, p_name AS sku, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS usd FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS k, p_name AS sku, CASE WHEN p_partkey % 4 = 0 THEN '1.00' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS usd FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT CAST(coalesce(o.k, n.k) AS VARCHAR) AS product_hash, coalesce(n.sku, o.sku) AS sku, coalesce(n.usd, o.usd) AS usd, n.k IS NOT NULL AND (o.k IS NULL OR n.usd <> o.usd) AS written FROM o FULL JOIN n ON o.k = n.k)
"""


def _merged(spark, d) -> DataFrame:
    old, new = _before_after(spark, d)
    return store.merged(old, new, F.lit(NOW).cast("timestamp"))


@_add("upsert_merge", f"{_MERGE} SELECT product_hash, sku, usd, written FROM m")
def _(spark, d):
    return _merged(spark, d).select("product_hash", "sku", F.get("prices", 0)["USD"].alias("usd"), (F.col("updated_at") > "2024-01-15").alias("written"))


@_add("upsert_changed_only", f"{_MERGE} SELECT product_hash, usd FROM m WHERE written")
def _(spark, d):
    return _merged(spark, d).where(F.col("updated_at") > "2024-01-15").select("product_hash", F.get("prices", 0)["USD"].alias("usd"))


@_add("stale_anti_join", """SELECT CAST(p_partkey AS VARCHAR) AS product_hash FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0""")
def _(spark, d):
    old, new = _before_after(spark, d)
    return store.stale(old, "aws", F.lit(NOW).cast("timestamp"), new.select("product_hash")).select("product_hash")


@_add("seen_semi_join", f"{RUNS} SELECT r.id AS run_id, r.vendor AS product_hash FROM runs_v r WHERE r.status = 'running' AND r.id <> 5")
def _(spark, d):
    ledger = runs_v(spark, d)
    return store.clear_seen(ledger.select(F.col("id").alias("run_id"), F.col("vendor").alias("product_hash")), 5, ledger)


@_add("seen_marked", "SELECT DISTINCT CAST(7 AS BIGINT) AS run_id, CAST(l_partkey AS VARCHAR) AS product_hash FROM lineitem")
def _(spark, d):
    none = spark.createDataFrame([], "run_id long, product_hash string")
    return store.mark_seen(none, 7, _table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("product_hash")))


@_add("snapshot_history", f"""{RUNS} SELECT id AS scrape_run_id, vendor AS product_hash, CAST(products AS VARCHAR) AS usd FROM runs_v WHERE NOT (status <> 'running' AND finished_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY)""")
def _(spark, d):
    from datetime import timedelta

    ledger = runs_v(spark, d)
    history = ledger.select(F.col("id").alias("scrape_run_id"), F.col("vendor").alias("product_hash"), F.col("products").cast("string").alias("usd"))
    return runs.pruned_snapshots(history, runs.pruned(ledger, F.lit(NOW).cast("timestamp"), timedelta(days=10)))


_LATEST = f"""{RUNS}, l AS (SELECT vendor, max_by(status, id) AS latest_status, coalesce(bool_or(status = 'success'), false) AS saw_success, max_by(products, id) FILTER (WHERE status = 'success') AS success_products, max_by(finished_at, id) FILTER (WHERE status = 'success') AS finished_at FROM runs_v GROUP BY vendor)
"""


@_add("status_latest_run", f"{_LATEST} SELECT vendor, latest_status, saw_success, success_products FROM l")
def _(spark, d):
    return runs.latest(runs_v(spark, d)).select("vendor", "latest_status", "saw_success", "success_products")


@_add("vendor_status", f"""{_LATEST} SELECT v.vendor, CASE WHEN latest_status IS NULL AND NOT coalesce(saw_success, false) THEN 'never' WHEN latest_status = 'running' THEN 'scraping' WHEN latest_status = 'failed' THEN 'failed' WHEN NOT coalesce(saw_success, false) THEN 'never'
WHEN coalesce(success_products, 0) = 0 THEN 'empty' WHEN finished_at < TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN 'stale' ELSE 'ready' END AS status FROM (SELECT DISTINCT vendor FROM runs_v UNION ALL SELECT 'nobody') v LEFT JOIN l USING (vendor)""")
def _(spark, d):
    ledger = runs_v(spark, d)
    listed = ledger.select("vendor").distinct().unionByName(spark.createDataFrame([("nobody",)], "vendor string"))
    return runs.vendor_status(ledger, F.lit(NOW).cast("timestamp"), listed).select("vendor", "status")


@_add("run_prune", f"{RUNS} SELECT id, vendor, status FROM runs_v WHERE NOT (status <> 'running' AND finished_at < TIMESTAMP '{NOW}' - INTERVAL 15 DAY)")
def _(spark, d):
    from datetime import timedelta

    return runs.pruned(runs_v(spark, d), F.lit(NOW).cast("timestamp"), timedelta(days=15)).select("id", "vendor", "status")


@_add("run_reap", f"{RUNS} SELECT id, CASE WHEN status = 'running' AND finished_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND finished_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'reaped: exceeded timeout' END AS error FROM runs_v")
def _(spark, d):
    ledger = runs_v(spark, d).withColumns({"started_at": F.col("finished_at"), "error": F.lit(None).cast("string")})
    return runs.reaped(ledger, F.lit(NOW).cast("timestamp")).select("id", "status", "error")


@_add("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_add("union_terms", """SELECT l_partkey, 'on_demand' AS option, l_extendedprice AS usd FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_partkey, 'reserved' AS option, l_extendedprice AS usd FROM lineitem WHERE l_returnflag = 'R'""")
def _(spark, d):
    line = _table(spark, d, "lineitem")
    part = lambda flag, name: line.where(F.col("l_returnflag") == flag).select("l_partkey", F.lit(name).alias("option"), F.col("l_extendedprice").alias("usd"))
    return store.union([part("N", "on_demand"), part("R", "reserved")])


@_add("service_discovery", """WITH w AS (SELECT 'nation_' || i AS n FROM range(3, 9) t(i)), p AS (SELECT n_name AS name, 'pinned-' || n_nationkey AS id FROM nation WHERE n_nationkey < 5)
SELECT name, id FROM p UNION ALL SELECT n_name, 'found-' || n_nationkey FROM nation WHERE lower(n_name) IN (SELECT n FROM w) AND n_name NOT IN (SELECT name FROM p)""")
def _(spark, d):
    from pricewright.sources.gcp import merged_services

    nation = _table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    pinned = nation.where("n_nationkey < 5").select(F.col("n_name").alias("name"), F.concat(F.lit("pinned-"), key).alias("id"))
    listed = nation.select(F.col("n_name").alias("displayName"), F.concat(F.lit("found-"), key).alias("serviceId"))
    return merged_services(pinned, listed, spark.createDataFrame([(f"nation_{i}",) for i in range(3, 9)], "name string"))


@_add("region_fan_out", """SELECT n_nationkey, unnest(CASE n_nationkey % 3 WHEN 0 THEN [lower(n_name), 'Global'] WHEN 1 THEN [lower(n_name), 'Zone 1'] ELSE [lower(n_name), 'Global', 'Zone 1'] END) AS region FROM nation""")
def _(spark, d):
    from pricewright.sources.azure import regions

    rows = _table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("r"), F.when(F.col("n_nationkey") % 3 == 0, "Load Balancer").when(F.col("n_nationkey") % 3 == 1, "Azure DNS").otherwise("VPN Gateway").alias("s"))
    return rows.select("n_nationkey", F.explode(regions(F.col("r"), F.col("s"))).alias("region"))


@_add("windowed_events", """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(value), 2) AS DECIMAL(18,2))::VARCHAR AS total FROM events GROUP BY 1, 2""")
def _(spark, d):
    from pricewright.streaming.landing import windowed

    found = windowed(_table(spark, d, "events"), "6 hours")
    return found.select("start", "event_type", "n", F.round("total", 2).cast("decimal(18,2)").cast("string").alias("total"))


@_add("exact_number_text", """SELECT DISTINCT l_extendedprice AS x, printf('%.10f', l_extendedprice / 7) AS usd, printf('%.10f', l_extendedprice / 1024) AS tie FROM lineitem""")
def _(spark, d):
    from pricewright.functions.numfmt import usd_text

    x = F.col("x")
    return _table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x")).distinct().select("x", usd_text(x / 7).alias("usd"), usd_text(x / 1024).alias("tie"))


_DEFINITION = """
kind = "demo_part"
provider = "aws"
[[dimensions]]
id = "hours"
quantity = 'monthly_hours() * (type startsWith "PROMO" ? 0.5 : 1)'
rate = "default(size, 1) * 0.25"
[[dimensions]]
id = "disks"
quantity = 'sum_field(disks, "gb")'
rate = 'price("disk") ?? 2'
when = 'count_blocks(disks) > 0 and not (brand in ["Brand#1", "Brand#2"])'
"""


@_add("definition_costs", """SELECT p_partkey, CAST(round(730 * CASE WHEN starts_with(p_type, 'PROMO') THEN 0.5 ELSE 1 END * p_size * 0.25 + CASE WHEN p_size % 2 = 0 AND p_brand NOT IN ('Brand#1', 'Brand#2') THEN (p_size + 10) * CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 2 END ELSE 0 END, 3) AS DECIMAL(18,3))::VARCHAR AS cost FROM part""")
def _(spark, d):
    from pricewright.plans import definitions

    gb = F.array(F.struct(F.col("p_size").alias("gb")), F.struct(F.lit(10).alias("gb")))
    attributes = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, gb).alias("disks")))
    prices = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("disk"), F.lit(0.5))).otherwise(F.create_map().cast("map<string,double>"))
    rows = _table(spark, d, "part").select("p_partkey", attributes.alias("attributes"), prices.alias("prices"))
    found = definitions.monthly_cost(rows, definitions.parse(_DEFINITION))
    return found.select("p_partkey", F.round("monthly_cost", 3).cast("decimal(18,3)").cast("string").alias("cost"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of one vendor's service in a region, with the prices on demand of each product."""
    f = ProductFilter("azure", "Brand#18", region="NATION_12")
    found = P.filter_prices(query.plan_products(products_v(spark, d), f), PriceFilter(purchase_option="on-demand"))
    return found.select("product_hash", "sku", "region", F.explode_outer("prices").alias("p")).select("product_hash", "sku", "region", F.col("p.USD").alias("usd"), F.col("p.unit").alias("unit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pricewright.plans import landed_rows  # noqa: F401  (adds its own)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


"""Retail price rows of the second vendor, as products.

One row prices one meter in one region. Rows are fanned out to the regions under which their product is looked up,
grouped into products, and where a slot has an authoritative price, the others for that slot go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricewright.functions.hashing import _digest, price_hash, product_hash
from pricewright.functions.numfmt import general_text, number, usd_text
from pricewright.operators.prices import TIER
from pricewright.schema import PRICE_FIELDS

#: A page of the API.
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("currencyCode", "unitOfMeasure", "armRegionName", "location", "serviceName", "serviceFamily", "productName", "skuName", "armSkuName", "meterName", "type", "reservationTerm")]
    + [T.StructField("retailPrice", T.DoubleType()), T.StructField("tierMinimumUnits", T.DoubleType()), T.StructField("isPrimaryMeterRegion", T.BooleanType())]
)
PAGE = T.StructType([T.StructField("Items", T.ArrayType(ITEM)), T.StructField("NextPageLink", T.StringType())])

#: Services whose products are looked up under virtual regions.
VIRTUAL_SERVICES = ("Azure DNS", "VPN Gateway", "Load Balancer")
#: Rows that count although they are not marked primary, by what of them must hold.
ALWAYS_PRODUCTS = ("IP Addresses",)
ALWAYS_PRODUCT_PREFIXES = ("Azure Cosmos DB", "SQL Database Single", "SQL Database Basic", "SQL Database Premium", "Virtual Machines", "Container Registry", "Logic Apps", "Key Vault", "Event Hubs")
ALWAYS_METERS = ("Disk Operations",)
ALWAYS_PRODUCT_AND_METER = (("Managed Disks", "Disk Transactions"),)
ALWAYS_SERVICES = ("Azure Analysis Services", "Azure Purview", "Azure Site Recovery")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def authoritative() -> Column:
    product, meter, service = (F.coalesce(c, F.lit("")) for c in ("productName", "meterName", "serviceName"))
    always = [product.isin(*ALWAYS_PRODUCTS), service.isin(*VIRTUAL_SERVICES, *ALWAYS_SERVICES)]
    always += [product.startswith(p) for p in ALWAYS_PRODUCT_PREFIXES] + [meter.contains(m) for m in ALWAYS_METERS]
    always += [product.endswith(p) & meter.contains(m) for p, m in ALWAYS_PRODUCT_AND_METER]
    return F.coalesce("isPrimaryMeterRegion", F.lit(False)) | _any(always)


def coarse_region(region: Column) -> Column:
    low = F.lower(region)
    return F.when(low.contains("usgov"), "US Gov").when(low.contains("china"), "China").otherwise("Global")


def zone_region(region: Column) -> Column:
    low = F.lower(region)
    return F.when(low.startswith("usgov"), "US Gov Zone 1").when(low.startswith("germany"), "DE Zone 1").when(low.startswith("china"), "Zone 1 (China)").otherwise("Zone 1")


def regions(region: Column, service: Column) -> Column:
    """All regions of a row: its own and the virtual ones of its service, ``Global`` without either."""
    region = F.coalesce(region, F.lit(""))
    coarse = F.when(service.isin("Load Balancer", "VPN Gateway"), coarse_region(region))
    zone = F.when(service.isin("Azure DNS", "VPN Gateway"), zone_region(region))
    found = F.array_distinct(F.array_compact(F.array(F.nullif(region, F.lit("")), coarse, zone)))
    return F.when(F.size(found) == 0, F.array(F.lit("Global"))).otherwise(found)


def is_virtual(region: Column) -> Column:
    return region.startswith("Zone") | (region == "Global") | region.startswith("US Gov") | region.startswith("DE ") | region.contains("China")


def product_name(name: Column) -> Column:
    """Series names of virtual machines lose a trailing version."""
    return F.when(name.startswith("Virtual Machines"), F.regexp_replace(name, " v[0-9]+\\z", "")).otherwise(name)


def operating_system(service: Column, name: Column) -> Column:
    cloud = name.contains("Cloud Services") | name.contains("CloudServices")
    return F.when(service == "Virtual Machines", F.when(cloud, None).when(name.endswith(" Windows") | name.endswith(" Win"), "Windows").otherwise("Linux"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Landed pages as rows with ``ord``, their order: service and page where the pages name them, else the file and the
    row in it; and the place in the page. It is the same however the pages are dealt to tasks."""
    named = {"service", "page"} <= set(pages.columns)
    at = (F.col("service"), F.col("page").cast("long")) if named else (F.input_file_name(), F.monotonically_increasing_id())
    rows = pages.select(at[0].alias("_from"), at[1].alias("_page"), "Items").select("_from", "_page", F.posexplode("Items").alias("_i", "item"))
    return rows.select("item.*", F.struct("_from", "_page", "_i").alias("ord"))


def products(rows: DataFrame) -> DataFrame:
    """Products of price rows (the columns of ITEM and ``ord``)."""
    texts = [f.name for f in ITEM.fields if isinstance(f.dataType, T.StringType)]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts}).withColumn("authoritative", authoritative())
    vendor, start = F.lit("azure"), F.when(F.col("tierMinimumUnits") > 0, general_text("tierMinimumUnits")).otherwise("0")
    own = {"name": product_name(F.col("productName")), "purchaseOption": F.col("type"), "unit": F.col("unitOfMeasure"), "USD": usd_text("retailPrice"), "startUsageAmount": start, "termLength": F.col("reservationTerm")}
    heads, key = ["serviceName", "serviceFamily", "armSkuName"], ["name", "skuName", "meterName", "region"]
    rows = rows.select(*heads, *key[1:3], *(c.alias(n) for n, c in own.items()), "authoritative", "ord", regions(F.col("armRegionName"), F.col("serviceName")).alias("regions"))
    rows = rows.select("*", F.explode("regions").alias("region")).drop("regions")  # what is said above is worked out once for all regions
    # all of this is by product, so rows are exchanged and sorted once; virtual regions keep a tier's lowest price, others the first of equal prices
    tier = [*key, *TIER]
    slot, first = [*tier, "unit"], [F.desc("authoritative"), F.col("ord")]
    exact = [*slot, "USD"]
    over = lambda columns: Window.partitionBy(*columns)
    rows = rows.repartition(*key).sortWithinPartitions(*exact, *first)
    rows = rows.withColumn("_stays", F.col("authoritative") | ~F.max("authoritative").over(over(slot)))  # as slot_coverage; of equal prices, these come first
    place = F.struct(F.coalesce(number(F.col("USD")), F.lit(0.0)).alias("usd"), "ord", "unit", "USD")
    rows = rows.withColumn("_first", F.row_number().over(over(exact).orderBy(*first)) == 1).withColumn("_place", F.when(F.col("_stays"), place))
    rows = rows.withColumns({"_least": F.min("_place").over(over(tier)), "_at": F.min(F.when(F.col("_stays"), F.col("ord"))).over(over(tier))})
    virtual = is_virtual(F.col("region"))
    kept = F.col("_stays") & F.col("_first") & (~virtual | (F.col("_place") == F.col("_least")))
    price = F.struct(F.when(virtual, F.col("_at")).otherwise(F.col("ord")).alias("at"), "purchaseOption", "unit", "USD", "startUsageAmount", "termLength")
    grouped = rows.groupBy(*key).agg(F.min(F.struct("ord", *heads)).alias("_head"), F.sort_array(F.collect_list(F.when(kept, price))).alias("prices"))

    def whole(p: Column) -> Column:
        given = {"description": F.col("meterName")} | {f: p[f] for f in ("purchaseOption", "unit", "USD", "startUsageAmount", "termLength")}
        h = price_hash(F.col("product_hash"), given["purchaseOption"], given["unit"], given["startUsageAmount"], given["description"], given["termLength"])
        return F.struct(h.alias("priceHash"), *(F.coalesce(given.get(f, F.lit("")), F.lit("")).alias(f) for f in PRICE_FIELDS[1:]))

    grouped = grouped.select(*key, *(F.col(f"_head.{c}").alias(c) for c in heads), _digest((F.lit("azure-sku"), F.col("name"), F.col("skuName"), F.col("meterName"))).alias("sku"), "prices")
    hash_ = product_hash(vendor, F.col("region"), F.col("serviceName"), F.concat("sku", "region"))
    attributes = F.map_from_arrays(F.array(*map(F.lit, ("productName", "skuName", "meterName", "armSkuName", "serviceFamily"))), F.array("name", "skuName", "meterName", "armSkuName", "serviceFamily"))
    system = operating_system(F.col("serviceName"), F.col("name"))
    out = grouped.select(hash_.alias("product_hash"), "sku", vendor.alias("vendor_name"), "region", F.col("serviceName").alias("service"), F.col("serviceFamily").alias("product_family"),
        F.when(system.isNotNull(), F.map_concat(attributes, F.create_map(F.lit("os"), system))).otherwise(attributes).alias("attributes"), "prices", "meterName")
    return out.withColumn("prices", F.transform("prices", whole)).drop("meterName")


def with_price_hashes(products: DataFrame, start: str | None = None) -> DataFrame:
    """Gives every price its hash; ``start`` replaces the start of the range in it."""

    def named(p: Column) -> Column:
        at = p["startUsageAmount"] if start is None else F.lit(start)
        h = price_hash(F.col("product_hash"), p["purchaseOption"], p["unit"], at, p["description"], p["termLength"], p["termPurchaseOption"], p["termOfferingClass"])
        return F.struct(h.alias("priceHash"), *(F.coalesce(p[f], F.lit("")).alias(f) for f in PRICE_FIELDS[1:]))

    return products.withColumn("prices", F.transform("prices", named))

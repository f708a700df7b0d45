"""SKUs of the third vendor as products, and machine types made up from prices of cores and memory."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.functions.hashing import price_hash, product_hash
from pricewright.functions.numfmt import number, plain_texts, usd_text, usd_texts
from pricewright.operators.prices import tier_ends
from pricewright.schema import PRICE_FIELDS
from pricewright.sources.azure import with_price_hashes

_S, _A, _F = T.StringType(), T.ArrayType, T.StructField
SKU = T.StructType([
    _F("skuId", _S), _F("name", _S), _F("description", _S),
    _F("category", T.StructType([_F(n, _S) for n in ("serviceDisplayName", "resourceFamily", "resourceGroup", "usageType")])),
    _F("serviceRegions", _A(_S)),
    _F("pricingInfo", _A(T.StructType([_F("pricingExpression", T.StructType([_F("usageUnit", _S), _F("tieredRates", _A(T.StructType([_F("startUsageAmount", T.DoubleType()), _F("unitPrice", T.StructType([_F("currencyCode", _S), _F("units", _S), _F("nanos", T.LongType())]))])))]))]))),
])
PAGE = T.StructType([_F("skus", _A(SKU)), _F("nextPageToken", _S)])

#: How the descriptions of core and memory prices begin, by family.
CORE = {"n1": "N1 Predefined Instance Core", "n2": "N2 Instance Core", "n2d": "N2D AMD Instance Core", "e2": "E2 Instance Core", "c2": "Compute optimized Core", "c2d": "C2D AMD Instance Core", "t2d": "T2D AMD Instance Core", "t2a": "T2A Arm Instance Core"}
RAM = {"n1": "N1 Predefined Instance Ram", "n2": "N2 Instance Ram", "n2d": "N2D AMD Instance Ram", "e2": "E2 Instance Ram", "c2": "Compute optimized Ram", "c2d": "C2D AMD Instance Ram", "t2d": "T2D AMD Instance Ram", "t2a": "T2A Arm Instance Ram"}
#: Machine types, each with its cores and GB of memory.
MACHINES = """
n1-standard-1 1 3.75, n1-standard-2 2 7.5, n1-standard-4 4 15, n1-standard-8 8 30, n1-standard-16 16 60, n1-standard-32 32 120, n1-standard-64 64 240, n1-standard-96 96 360
n1-highmem-2 2 13, n1-highmem-4 4 26, n1-highmem-8 8 52, n1-highmem-16 16 104, n1-highmem-32 32 208, n1-highmem-64 64 416, n1-highmem-96 96 624
n1-highcpu-2 2 1.8, n1-highcpu-4 4 3.6, n1-highcpu-8 8 7.2, n1-highcpu-16 16 14.4, n1-highcpu-32 32 28.8, n1-highcpu-64 64 57.6, n1-highcpu-96 96 86.4
n2-standard-2 2 8, n2-standard-4 4 16, n2-standard-8 8 32, n2-standard-16 16 64, n2-standard-32 32 128, n2-standard-48 48 192, n2-standard-64 64 256, n2-standard-80 80 320
n2-standard-96 96 384, n2-standard-128 128 512
n2-highmem-2 2 16, n2-highmem-4 4 32, n2-highmem-8 8 64, n2-highmem-16 16 128, n2-highmem-32 32 256, n2-highmem-48 48 384, n2-highmem-64 64 512, n2-highmem-80 80 640
n2-highmem-96 96 768, n2-highmem-128 128 864
n2-highcpu-2 2 2, n2-highcpu-4 4 4, n2-highcpu-8 8 8, n2-highcpu-16 16 16, n2-highcpu-32 32 32, n2-highcpu-48 48 48, n2-highcpu-64 64 64, n2-highcpu-80 80 80
n2-highcpu-96 96 96
e2-micro 0.25 1
e2-small 0.5 2
e2-medium 1 4
e2-standard-2 2 8, e2-standard-4 4 16, e2-standard-8 8 32, e2-standard-16 16 64, e2-standard-32 32 128
e2-highmem-2 2 16, e2-highmem-4 4 32, e2-highmem-8 8 64, e2-highmem-16 16 128
e2-highcpu-2 2 2, e2-highcpu-4 4 4, e2-highcpu-8 8 8, e2-highcpu-16 16 16, e2-highcpu-32 32 32
n2d-standard-2 2 8, n2d-standard-4 4 16, n2d-standard-8 8 32, n2d-standard-16 16 64, n2d-standard-32 32 128, n2d-standard-48 48 192, n2d-standard-64 64 256
n2d-standard-80 80 320, n2d-standard-96 96 384, n2d-standard-128 128 512, n2d-standard-224 224 896
n2d-highmem-2 2 16, n2d-highmem-4 4 32, n2d-highmem-8 8 64, n2d-highmem-16 16 128, n2d-highmem-32 32 256, n2d-highmem-48 48 384, n2d-highmem-64 64 512
n2d-highmem-80 80 640, n2d-highmem-96 96 768
n2d-highcpu-2 2 2, n2d-highcpu-4 4 4, n2d-highcpu-8 8 8, n2d-highcpu-16 16 16, n2d-highcpu-32 32 32, n2d-highcpu-48 48 48, n2d-highcpu-64 64 64, n2d-highcpu-80 80 80
n2d-highcpu-96 96 96, n2d-highcpu-128 128 128, n2d-highcpu-224 224 224
c2-standard-4 4 16, c2-standard-8 8 32, c2-standard-16 16 64, c2-standard-30 30 120, c2-standard-60 60 240
c2d-standard-2 2 8, c2d-standard-4 4 16, c2d-standard-8 8 32, c2d-standard-16 16 64, c2d-standard-32 32 128, c2d-standard-56 56 224, c2d-standard-112 112 448
c2d-highmem-2 2 16, c2d-highmem-4 4 32, c2d-highmem-8 8 64, c2d-highmem-16 16 128, c2d-highmem-32 32 256, c2d-highmem-56 56 448, c2d-highmem-112 112 896
c2d-highcpu-2 2 2, c2d-highcpu-4 4 4, c2d-highcpu-8 8 8, c2d-highcpu-16 16 16, c2d-highcpu-32 32 32, c2d-highcpu-56 56 56, c2d-highcpu-112 112 112
t2d-standard-1 1 4, t2d-standard-2 2 8, t2d-standard-4 4 16, t2d-standard-8 8 32, t2d-standard-16 16 64, t2d-standard-32 32 128, t2d-standard-48 48 192
t2d-standard-60 60 240
t2a-standard-1 1 4, t2a-standard-2 2 8, t2a-standard-4 4 16, t2a-standard-8 8 32, t2a-standard-16 16 64, t2a-standard-32 32 128, t2a-standard-48 48 192
"""


def machine_types() -> list[tuple[str, str, float, float]]:
    """family, machine type, cores, GB."""
    listed = (m.split() for m in MACHINES.replace("\n", ",").split(",") if m.strip())
    return sorted((name.split("-")[0], name, float(cores), float(gb)) for name, cores, gb in listed)


def service_name(name: Column) -> Column:
    return F.when(name == "Networking", "Compute Engine").otherwise(name)


def from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("skus").alias("sku")).select("sku.*")


def merged_services(pinned: DataFrame, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Services by name and id: the pinned ones, and those listed whose name is wanted in any case; pinned ids win."""
    found = listed.join(wanted.select(F.lower("name").alias("_w")).distinct(), F.lower("displayName") == F.col("_w"), "left_semi").select(F.col("displayName").alias("name"), F.col("serviceId").alias("id"))
    return pinned.select("name", "id").unionByName(found.join(pinned, "name", "left_anti"))


def products(skus: DataFrame) -> DataFrame:
    """Products of SKUs: the first pricing, one product per region, tiers as prices."""
    none = F.lit("")
    flat = skus.withColumn("_p", F.get("pricingInfo", 0)["pricingExpression"]).where("size(_p.tieredRates) > 0")
    tiers = F.col("_p.tieredRates")
    money = F.transform(tiers, lambda t: F.coalesce(t["unitPrice"]["units"].try_cast("bigint"), F.lit(0)).cast("double") + F.coalesce(t["unitPrice"]["nanos"], F.lit(0)) / F.lit(1e9))
    written = flat.withColumns({"_usd": usd_texts(money), "_start": plain_texts(F.transform(tiers, lambda t: F.coalesce(t["startUsageAmount"], F.lit(0.0))))})
    rows = F.arrays_zip(F.col("_usd").alias("usd"), F.col("_start").alias("start"), tier_ends(F.col("_start")).alias("end"))
    prices = F.transform(rows, lambda x: F.struct(none.alias("priceHash"), F.coalesce("category.usageType", none).alias("purchaseOption"), F.coalesce("_p.usageUnit", none).alias("unit"), x["usd"].alias("USD"), x["start"].alias("startUsageAmount"), x["end"].alias("endUsageAmount"), F.coalesce("description", none).alias("description"), none.alias("termLength"), none.alias("termPurchaseOption"), none.alias("termOfferingClass")))
    out = written.withColumn("prices", prices).withColumn("region", F.explode("serviceRegions")).withColumn("service", service_name(F.coalesce("category.serviceDisplayName", none)))
    attributes = F.map_from_arrays(F.array(F.lit("description"), F.lit("resourceGroup")), F.array(F.coalesce("description", none), F.coalesce("category.resourceGroup", none)))
    out = out.select(product_hash(F.lit("gcp"), F.col("region"), F.col("service"), F.col("skuId")).alias("product_hash"), F.col("skuId").alias("sku"), F.lit("gcp").alias("vendor_name"), "region", "service", F.coalesce("category.resourceFamily", none).alias("product_family"), attributes.alias("attributes"), "prices")
    return with_price_hashes(out)


def unit_prices(products: DataFrame, patterns: DataFrame) -> DataFrame:
    """The lowest price that is not zero of each family's cores or memory, by region and purchase option.

    A description may hold several patterns; matching by substring is a nested loop over the eight broadcast ones.
    """
    machine = products.where((F.col("service") == "Compute Engine") & ~F.col("attributes")["description"].contains("SUD") & ~F.col("attributes")["description"].contains("Commitment"))
    hit = machine.join(F.broadcast(patterns), F.col("attributes")["description"].contains(F.col("pattern")))
    price = hit.select("family", "region", F.explode("prices").alias("p")).where("p.USD <> '0.0000000000'")
    return price.groupBy("family", "region", F.col("p.purchaseOption").alias("purchase_option")).agg(F.min(number(F.col("p.USD"))).alias("usd")).where("usd is not null")


def synthesized(spark: SparkSession, products: DataFrame) -> DataFrame:
    """Products of machine types in every region that prices both cores and memory of their family."""
    listed = lambda d: spark.createDataFrame(sorted(d.items()), "family string, pattern string")
    core = unit_prices(products, listed(CORE)).withColumnRenamed("usd", "core")
    ram = unit_prices(products, listed(RAM)).withColumnRenamed("usd", "ram")
    specs = F.broadcast(spark.createDataFrame(machine_types(), "family string, machine string, cores double, gb double"))
    rows = core.join(ram, ["family", "region", "purchase_option"]).join(specs, "family")
    rows = rows.withColumn("USD", usd_text(F.col("core") * F.col("cores") + F.col("ram") * F.col("gb")))
    sku = F.concat(F.lit("mt-"), "machine")
    rows = rows.withColumn("product_hash", product_hash(F.lit("gcp"), F.col("region"), F.lit("Compute Engine"), sku))
    none = F.lit("")
    named = price_hash(F.col("product_hash"), F.col("purchase_option"), F.lit("h"), F.lit("0"), F.col("machine"))
    values = {"priceHash": named, "purchaseOption": F.col("purchase_option"), "unit": F.lit("h"), "USD": F.col("USD"), "description": F.concat("machine", F.lit(" in "), "region")}
    price = F.struct(*(values.get(f, none).alias(f) for f in PRICE_FIELDS))
    grouped = rows.groupBy("product_hash", "machine", "region").agg(F.sort_array(F.collect_list(price)).alias("prices"))
    attributes = F.map_from_arrays(F.array(F.lit("machineType"), F.lit("description")), F.array(F.col("machine"), F.concat("machine", F.lit(" predefined instance"))))
    return grouped.select("product_hash", sku.alias("sku"), F.lit("gcp").alias("vendor_name"), "region", F.lit("Compute Engine").alias("service"), F.lit("Compute Instance").alias("product_family"), attributes.alias("attributes"), "prices")



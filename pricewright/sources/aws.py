"""Offer files of the first vendor: nested maps of products and terms, flattened, joined and grouped into products."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.functions.hashing import product_hash
from pricewright.functions.numfmt import number, usd_text
from pricewright.schema import PRICE_FIELDS
from pricewright.sources.azure import with_price_hashes

_S, _F = T.StringType(), T.StructField
_MAP = T.MapType(_S, _S)
_DIMENSION = T.StructType([_F("unit", _S), _F("pricePerUnit", T.StructType([_F("USD", _S), _F("CNY", _S)])), _F("beginRange", _S), _F("endRange", _S), _F("description", _S)])
_TERM = T.MapType(_S, T.MapType(_S, T.StructType([_F("priceDimensions", T.MapType(_S, _DIMENSION)), _F("termAttributes", T.StructType([_F("LeaseContractLength", _S), _F("PurchaseOption", _S), _F("OfferingClass", _S)]))])))
_LISTED = T.StructType([_F("sku", _S), _F("productFamily", _S), _F("attributes", _MAP)])
OFFER = T.StructType([
    _F("products", T.MapType(_S, _LISTED)),
    _F("terms", T.StructType([_F("OnDemand", _TERM), _F("Reserved", _TERM)])),
])
#: What an offer file is cut into: a product, or the offers of a product on one kind of terms, as JSON text.
KINDS = ("OnDemand", "Reserved")
ENTRY = T.StructType([_F("service", _S), _F("sku", _S), _F("value", _S), _F("kind", _S)])
REGION_INDEX = T.StructType([_F("regions", T.MapType(_S, T.StructType([_F("currentVersionUrl", _S)])))])
CNY_PER_USD = 6.2069

#: Names of locations and their region codes.
LOCATIONS = {
    "US East (N. Virginia)": "us-east-1", "US East (Ohio)": "us-east-2", "US West (N. California)": "us-west-1", "US West (Oregon)": "us-west-2",
    "Africa (Cape Town)": "af-south-1", "Asia Pacific (Hong Kong)": "ap-east-1", "Asia Pacific (Hyderabad)": "ap-south-2", "Asia Pacific (Jakarta)": "ap-southeast-3",
    "Asia Pacific (Melbourne)": "ap-southeast-4", "Asia Pacific (Mumbai)": "ap-south-1", "Asia Pacific (Osaka)": "ap-northeast-3", "Asia Pacific (Seoul)": "ap-northeast-2",
    "Asia Pacific (Singapore)": "ap-southeast-1", "Asia Pacific (Sydney)": "ap-southeast-2", "Asia Pacific (Tokyo)": "ap-northeast-1", "Canada (Central)": "ca-central-1",
    "Canada West (Calgary)": "ca-west-1", "EU (Frankfurt)": "eu-central-1", "EU (Ireland)": "eu-west-1", "EU (London)": "eu-west-2", "EU (Milan)": "eu-south-1",
    "EU (Paris)": "eu-west-3", "EU (Spain)": "eu-south-2", "Europe (Spain)": "eu-south-2", "EU (Stockholm)": "eu-north-1", "EU (Zurich)": "eu-central-2",
    "Europe (Zurich)": "eu-central-2", "Israel (Tel Aviv)": "il-central-1", "Middle East (Bahrain)": "me-south-1", "Middle East (UAE)": "me-central-1",
    "South America (Sao Paulo)": "sa-east-1", "AWS GovCloud (US-East)": "us-gov-east-1", "AWS GovCloud (US-West)": "us-gov-west-1", "Asia Pacific (Malaysia)": "ap-southeast-5",
    "Asia Pacific (Thailand)": "ap-southeast-7", "Asia Pacific (Taipei)": "ap-east-2", "Asia Pacific (New Zealand)": "ap-southeast-6", "Mexico (Central)": "mx-central-1",
    "China (Beijing)": "cn-north-1", "China (Ningxia)": "cn-northwest-1",
}
#: Product families under another name.
FAMILIES = {"DNS Domain Names": "DNS Zone", "DNS Query": "DNS Query"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def proper_regions(index: DataFrame) -> DataFrame:
    """region and url of an index file; local and wavelength zones, told by more than two hyphens, stay out."""
    rows = index.select(F.explode("regions").alias("region", "r")).select("region", F.col("r.currentVersionUrl").alias("url"))
    return rows.where(F.length(F.regexp_replace("region", "[^-]", "")) <= 2)


def region(attributes: Column) -> Column:
    """The code of a region proper, else the code of the location's name, nothing for everywhere, else the location."""
    get = lambda k: F.coalesce(attributes[k], F.lit(""))
    location = get("location")
    named = F.try_element_at(literal_map(LOCATIONS), location)
    return F.when((get("regionCode") != "") & (get("locationType") == "AWS Region"), get("regionCode")).when(named.isNotNull(), named).when(location.isin("Any", "Global"), "").otherwise(location)


def dollars(per_unit: Column, rate: float = CNY_PER_USD) -> Column:
    """The price in USD, or converted from CNY; null if neither is given or CNY is no number."""
    cny = number(per_unit["CNY"])
    return F.coalesce(F.nullif(per_unit["USD"], F.lit("")), F.when(cny == 0, "0.0000000000").otherwise(usd_text(cny / F.lit(rate))))


def normalized(attributes: Column, service: Column) -> Column:
    """Attributes with what a few services need: bare instance types, a mode of clusters, a family of queries."""
    get = lambda k: F.coalesce(attributes[k], F.lit(""))
    put = lambda k, v: F.map_concat(F.map_filter(attributes, lambda key, _: key != k), F.create_map(F.lit(k), v))
    usage = get("usagetype")
    bare = F.regexp_replace(get("instanceType"), "^([^-]+)-[A-Z].*$", "$1")
    mode = F.when(usage.contains("EKS-Auto"), "Auto").when(usage.contains("AmazonEKS-Hours") | usage.contains("EKS-Cluster") | usage.contains("Cluster-Hours"), "Classic")
    query = (get("productFamily") == "") & (get("operation").startswith("Query") | usage.contains("DataScannedBytes"))
    return (
        F.when((service == "AmazonSageMaker") & (get("instanceType") != bare), put("instanceType", bare))
        .when((service == "AmazonEKS") & (get("mode") == "") & mode.isNotNull(), put("mode", mode))
        .when((service == "AmazonAthena") & query, put("productFamily", F.lit("Query")))
        .otherwise(attributes)
    )


def terms(offers: Column, reserved: Column, rate: float = CNY_PER_USD) -> Column:
    """The price dimensions of a product's offers on one kind of terms, as an array of prices without their hashes."""
    none = F.lit("")

    def price(d: Column, attributes: Column) -> Column:
        term = lambda k: F.when(reserved, F.coalesce(attributes[k], none)).otherwise(none)
        fields = {
            "purchaseOption": F.when(reserved, "reserved").otherwise("on_demand"), "unit": F.coalesce(d["unit"], none), "USD": dollars(d["pricePerUnit"], rate),
            "startUsageAmount": F.coalesce(d["beginRange"], none), "endUsageAmount": F.when(d["endRange"] == "Inf", "").otherwise(F.coalesce(d["endRange"], none)), "description": F.coalesce(d["description"], none),
            "termLength": term("LeaseContractLength"), "termPurchaseOption": term("PurchaseOption"), "termOfferingClass": term("OfferingClass"),
        }
        return F.struct(*(fields[f].alias(f) for f in PRICE_FIELDS if f != "priceHash"))

    def of_offer(offer: Column) -> Column:
        dimensions = F.filter(F.map_values(offer["priceDimensions"]), lambda d: ~reserved | (F.coalesce(d["unit"], none) != "Quantity"))
        return F.coalesce(F.transform(dimensions, lambda d: price(d, offer["termAttributes"])), F.array())

    return F.filter(F.flatten(F.transform(F.map_values(offers), of_offer)), lambda p: p["USD"].isNotNull())


def products(offers: DataFrame, rate: float = CNY_PER_USD) -> DataFrame:
    """Products of offer files that are rows (the columns of OFFER and ``service``)."""
    listed = offers.select("service", F.explode("products").alias("sku", "p"))
    of_kind = lambda k: offers.select("service", F.explode(f"terms.{k}").alias("sku", "offers"), F.lit(k == "Reserved").alias("reserved"))
    return _products(listed.unionByName(of_kind("OnDemand"), True).unionByName(of_kind("Reserved"), True), rate)


def products_of(entries: DataFrame, rate: float = CNY_PER_USD) -> DataFrame:
    """Products of what offer files were cut into (the columns of ENTRY): the same, of files of any size."""
    listed = F.col("kind") == "products"
    read = lambda where, schema: F.from_json(F.when(where, F.col("value")), schema)
    rows = entries.select("service", "sku", read(listed, _LISTED).alias("p"), read(F.col("kind").isin(*KINDS), _TERM.valueType).alias("offers"), (F.col("kind") == "Reserved").alias("reserved"))
    return _products(rows, rate)


def _products(rows: DataFrame, rate: float) -> DataFrame:
    """Products of rows (service, sku, p, offers, reserved) that each list a product or hold its offers on one kind of terms;
    those without a price stay out.

    A product's prices meet as arrays, one for each row. They stand in the order of all their fields: the files hold them in
    maps, which have none.
    """
    priced = rows.select("service", "sku", "p", terms(F.col("offers"), F.col("reserved"), rate).alias("prices"))
    grouped = priced.groupBy("service", "sku").agg(F.collect_list("p").alias("listed"), F.flatten(F.collect_list("prices")).alias("prices")).where("size(prices) > 0")
    listed = grouped.select("service", "sku", "prices", F.explode("listed").alias("p"))
    listed = listed.select("service", "sku", F.sort_array("prices").alias("prices"), F.coalesce("p.productFamily", F.lit("")).alias("family"), F.coalesce("p.attributes", F.create_map().cast("map<string,string>")).alias("raw"))
    rows = listed.withColumn("attributes", normalized(F.col("raw"), F.col("service"))).withColumn("region", region(F.col("raw")))
    family = F.coalesce(F.try_element_at(literal_map(FAMILIES), F.col("family")), F.col("family"))
    family = F.when(family == "", F.coalesce(F.col("attributes")["productFamily"], F.lit(""))).otherwise(family)
    out = rows.select(product_hash(F.lit("aws"), F.col("region"), F.col("service"), F.col("sku")).alias("product_hash"), "sku", F.lit("aws").alias("vendor_name"), "region", "service", family.alias("product_family"), "attributes", "prices")
    return with_price_hashes(out)

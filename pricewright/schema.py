"""The product model: one row per product, prices nested, attributes in a map."""

from pyspark.sql import types as T

PRICE_FIELDS = ("priceHash", "purchaseOption", "unit", "USD", "startUsageAmount", "endUsageAmount", "description", "termLength", "termPurchaseOption", "termOfferingClass")
PRICE = T.StructType([T.StructField(n, T.StringType()) for n in PRICE_FIELDS])
PRODUCT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("product_hash", "sku", "vendor_name", "region", "service", "product_family")]
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("prices", T.ArrayType(PRICE))]
)
#: As a seed file writes it.
SEED = T.StructType([T.StructField(n, T.StringType()) for n in ("productHash", "sku", "vendorName", "region", "service", "productFamily")] + PRODUCT.fields[6:])
RUN = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("vendor", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("products", T.LongType()), T.StructField("deleted", T.LongType()), T.StructField("error", T.StringType())]
)
VENDORS = ("aws", "azure", "gcp")
#: Attributes that many filters ask for: the store writes them as columns of their own, which Parquet can push down.
HOT_KEYS = ("instanceType", "usagetype", "meterName", "armSkuName", "description")

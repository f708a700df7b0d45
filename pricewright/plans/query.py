"""The served lookup as a lazy plan: predicates for what the filter names, order by hash, a page.

Flat columns are compared as they are, so a store partitioned by vendor and service is pruned and the others reach
the scan; an attribute is compared in its own column if the table has one, as tables that ``store`` reads do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions import regex
from pricewright.model import AttributeFilter, FilterTooBroad, ProductFilter
from pricewright.operators.prices import filter_prices  # noqa: F401  (part of the lookup)
from pricewright.plans.store import key_column

MAX_ROWS = 5_000
COLUMNS = ("product_hash", "sku", "vendor_name", "region", "service", "product_family", "attributes", "prices")


def effective_limit(limit: int | None) -> int:
    return limit if limit and 0 < limit <= MAX_ROWS else MAX_ROWS


def attribute(products: DataFrame, key: str) -> Column:
    """An attribute by name; null if the product has none."""
    own = key_column(key)
    return F.col(own) if own in products.columns else F.col("attributes")[key]


def keys_of(f: ProductFilter) -> list[str]:
    """The attributes that a filter asks for: what a store should read as columns."""
    return [a.key for a in f.attribute_filters]


def attribute_condition(products: DataFrame, f: AttributeFilter) -> Column | None:
    """Equality if the filter has a value, else a match; None where it asks for nothing or its pattern is malformed."""
    if f.value is not None:
        return attribute(products, f.key) == f.value
    pattern = regex.attribute_pattern(f.value_regex) if f.value_regex is not None else None
    return None if pattern is None else regex.rlike(attribute(products, f.key), pattern)


def conditions(products: DataFrame, f: ProductFilter) -> list[Column]:
    for a in f.attribute_filters:
        if a.value_regex is not None:
            regex.check_length(a.value_regex)
    found = [F.col(c) == v for c, v in (("vendor_name", f.vendor_name), ("service", f.service), ("product_family", f.product_family), ("region", f.region), ("sku", f.sku)) if v is not None]
    if f.region is not None:  # a region's own prices, not those of the whole world listed under it
        usage = attribute(products, "usagetype")
        found.append(usage.isNull() | ~usage.startswith("Global"))
    return found + [c for a in f.attribute_filters if (c := attribute_condition(products, a)) is not None]


def matching(products: DataFrame, f: ProductFilter) -> DataFrame:
    for c in conditions(products, f):
        products = products.where(c)
    return products


def plan_products(products: DataFrame, f: ProductFilter) -> DataFrame:
    """One page of the products that satisfy ``f``, by hash. A cursor goes before an offset."""
    out = matching(products, f)
    if f.after_hash:
        out = out.where(F.col("product_hash") > f.after_hash)
    out = out.select(*COLUMNS).orderBy("product_hash")
    if f.offset > 0 and not f.after_hash:
        out = out.offset(f.offset)
    return out.limit(effective_limit(f.limit))


def guard(f: ProductFilter) -> None:
    """Served requests must name a vendor and a service."""
    if not f.vendor_name or not f.service:
        raise FilterTooBroad("vendorName and service are required")


def sorted_attributes(products: DataFrame) -> DataFrame:
    """Attributes as an array of key and value, by key."""
    return products.withColumn("attributes", F.array_sort(F.map_entries("attributes")))


def as_json(products: DataFrame) -> DataFrame:
    """Products as one JSON text each, attributes by key, absent prices as an empty array."""
    return sorted_attributes(products).select(*COLUMNS).select(F.to_json(F.struct(*COLUMNS)).alias("product"))

"""Operators on the prices of a product: filters on nested prices, slot coverage, deduplication, ranges of tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.functions import regex
from pricewright.functions.numfmt import number
from pricewright.model import PriceFilter

#: A price slot: what a price is the price of, within a product.
SLOT = ("purchaseOption", "unit", "startUsageAmount", "termLength")
EXACT = ("purchaseOption", "unit", "startUsageAmount", "USD", "termLength")
TIER = ("purchaseOption", "startUsageAmount", "termLength")


def normal_option(option: Column | str) -> Column:
    """Vendors spell purchase options with hyphens, underscores and capitals; none of them counts."""
    return F.lower(F.translate(F.col(option) if isinstance(option, str) else option, "-_", ""))


def price_condition(f: PriceFilter):
    """A function from a price struct to a condition; None if the filter asks for nothing."""
    tests = []
    if f.purchase_option is not None:
        want = f.purchase_option.lower().replace("-", "").replace("_", "")
        tests.append(lambda p: normal_option(p["purchaseOption"]) == want)
    for name, value in (("unit", f.unit), ("description", f.description), ("endUsageAmount", f.end_usage_amount), ("termLength", f.term_length), ("termPurchaseOption", f.term_purchase_option), ("termOfferingClass", f.term_offering_class)):
        if value is not None:
            tests.append(lambda p, name=name, value=value: F.coalesce(p[name], F.lit("")) == value)
    if f.start_usage_amount is not None:
        tests.append(lambda p: F.when(F.coalesce(p["startUsageAmount"], F.lit("")) == "", "0").otherwise(p["startUsageAmount"]) == f.start_usage_amount)
    if f.description_regex is not None:
        test = regex.description_test(f.description_regex)
        tests.append(lambda p: test(F.coalesce(p["description"], F.lit(""))))
    return (lambda p: reduce(lambda a, b: a & b, (t(p) for t in tests))) if tests else None


def filter_prices(products: DataFrame, f: PriceFilter | None) -> DataFrame:
    """Keeps the prices that satisfy ``f``, in order; a product without any stays, with none."""
    if f is None:
        return products
    out, keep = products, price_condition(f)
    if keep is not None:
        out = out.withColumn("prices", F.filter("prices", keep))
    return out


def slot_coverage(rows: DataFrame, product: list[str], slot: tuple[str, ...] = SLOT, authoritative: str = "authoritative") -> DataFrame:
    """Drops rows that are not authoritative where the product has an authoritative one for the same slot."""
    covered = F.max(F.col(authoritative).cast("int")).over(Window.partitionBy(*product, *slot))
    return rows.withColumn("_covered", covered).where((F.col("_covered") == 0) | F.col(authoritative)).drop("_covered")


def exact_rank(product: list[str], order: list, key: tuple[str, ...] = EXACT) -> Column:
    """The place of a row among those of its (product, ``key``), from 1."""
    return F.row_number().over(Window.partitionBy(*product, *key).orderBy(*order))


def tier_rank(product: list[str], order: list, key: tuple[str, ...] = TIER) -> Column:
    """The place of a row among those of its (product, tier), from 1, the lowest price first, then the first in order; text
    that is no number counts as 0."""
    return F.row_number().over(Window.partitionBy(*product, *key).orderBy(F.coalesce(number(F.col("USD")), F.lit(0.0)), *order))


def tier_place(product: list[str], order: list, key: tuple[str, ...] = TIER) -> Column:
    """The place of the tier's first row, which the row of its lowest price takes."""
    return F.min(F.struct(*order) if len(order) > 1 else order[0]).over(Window.partitionBy(*product, *key))


def dedup_exact(rows: DataFrame, product: list[str], order: list, key: tuple[str, ...] = EXACT) -> DataFrame:
    """The first row of each (product, ``key``)."""
    return rows.withColumn("_n", exact_rank(product, order, key)).where("_n = 1").drop("_n")


def dedup_tier_min(rows: DataFrame, product: list[str], order: list, key: tuple[str, ...] = TIER, position: str = "_place") -> DataFrame:
    """The row of the lowest price of each (product, tier), the first of equals; ``position`` gets tier_place."""
    return rows.withColumn(position, tier_place(product, order, key)).withColumn("_n", tier_rank(product, order, key)).where("_n = 1").drop("_n")


def tier_ends(starts: Column) -> Column:
    """For an array of tier starts, the next tier's start, empty for the last."""
    return F.transform(starts, lambda x, i: F.coalesce(F.get(starts, i + 1), F.lit("")))


def max_nonzero_price(prices: Column) -> Column:
    """The highest price of an array that is not zero, null if there is none."""
    return F.array_max(F.filter(F.transform(prices, lambda p: number(p["USD"])), lambda x: x != 0))


def collected(rows: DataFrame, product: list[str], order: list, fields: tuple[str, ...]) -> DataFrame:
    """One row per product with its prices as an array, in order."""
    price = F.struct(*(F.col(f) for f in fields))
    packed = F.sort_array(F.collect_list(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), price.alias("price"))))
    return rows.groupBy(*product).agg(F.transform(packed, lambda x: x["price"]).alias("prices"))

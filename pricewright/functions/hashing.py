"""Content hashes that name products and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(parts: tuple[Column, ...]) -> Column:
    """The first 32 hexadecimal digits of SHA-256 over the parts, a zero byte between them; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 32)


def product_hash(vendor: Column, region: Column, service: Column, sku: Column) -> Column:
    return _digest((vendor, region, service, sku))


def price_hash(product: Column, option: Column, unit: Column, start: Column, description: Column, term: Column | None = None, term_option: Column | None = None, offering: Column | None = None) -> Column:
    """Not unique: neither the end of the range nor the price itself is in it."""
    none = F.lit("")
    rest = (none if c is None else c for c in (term, term_option, offering))
    return F.concat(product, F.lit("-"), _digest((product, option, unit, start, description, *rest)))

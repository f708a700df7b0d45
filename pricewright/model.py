"""Filters as plain values; None means not asked for, an empty string is a value like any other."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AttributeFilter:
    key: str
    value: str | None = None
    value_regex: str | None = None


@dataclass(frozen=True)
class ProductFilter:
    vendor_name: str | None = None
    service: str | None = None
    product_family: str | None = None
    region: str | None = None
    sku: str | None = None
    attribute_filters: tuple[AttributeFilter, ...] = field(default_factory=tuple)
    limit: int = 0
    offset: int = 0
    after_hash: str | None = None


@dataclass(frozen=True)
class PriceFilter:
    purchase_option: str | None = None
    unit: str | None = None
    description: str | None = None
    description_regex: str | None = None
    start_usage_amount: str | None = None
    end_usage_amount: str | None = None
    term_length: str | None = None
    term_purchase_option: str | None = None
    term_offering_class: str | None = None


class FilterTooBroad(ValueError):
    """The request names no vendor or no service."""


class BudgetSpent(RuntimeError):
    """The request has had all the products it may return."""

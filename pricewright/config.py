"""Settings of an engine, from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    path: str = ""
    concurrency: int = 4
    concurrency_aws: int = 0
    concurrency_azure: int = 8
    concurrency_gcp: int = 0
    snapshots: bool = False
    batch_requests: int = 50
    query_seconds: int = 30
    query_depth: int = 10
    introspection: bool = True
    cny_per_usd: float = 6.2069
    products_per_request: int = 5_000
    lookups_per_request: int = 50

    def concurrency_for(self, vendor: str) -> int:
        """The vendor's own number of partitions, or the common one."""
        own = {"aws": self.concurrency_aws, "azure": self.concurrency_azure, "gcp": self.concurrency_gcp}.get(vendor.lower(), 0)
        return own if own > 0 else self.concurrency

    def checked(self) -> Settings:
        if not self.path:
            raise ValueError("PRICEWRIGHT_PATH must name the store's folder")
        return self


def load(env: Mapping[str, str] = os.environ) -> Settings:
    """Unset, empty or unreadable variables leave the default."""

    def number(name: str, default, kind=int):
        try:
            return kind(env.get(name, "").strip() or default)
        except ValueError:
            return default

    def flag(name: str, default: bool) -> bool:
        said = env.get(name, "").strip().lower()
        return default if said not in ("1", "t", "true", "0", "f", "false") else said in ("1", "t", "true")

    d = Settings()
    hidden = flag("DISABLE_INTROSPECTION", env.get("ENV", "").lower() == "production")
    return Settings(
        env.get("PRICEWRIGHT_PATH", ""), number("SCRAPE_CONCURRENCY", d.concurrency), number("SCRAPE_CONCURRENCY_AWS", d.concurrency_aws), number("SCRAPE_CONCURRENCY_AZURE", d.concurrency_azure), number("SCRAPE_CONCURRENCY_GCP", d.concurrency_gcp),
        flag("ENABLE_PRICE_SNAPSHOTS", d.snapshots), number("MAX_BATCH_SIZE", d.batch_requests), number("QUERY_TIMEOUT_SECS", d.query_seconds), number("MAX_QUERY_DEPTH", d.query_depth), not hidden,
        number("CNY_USD_RATE", d.cny_per_usd, float), number("MAX_PRODUCTS_PER_REQUEST", d.products_per_request), number("MAX_PRODUCT_QUERIES_PER_REQUEST", d.lookups_per_request),
    )

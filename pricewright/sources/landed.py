"""Reading what has been fetched: offer files, pages, seed files, catalogs; and a data source that pages by itself.

Vendors' APIs are read by the Python data source ``pages``: as many services at once as the settings allow, retries with
growing pauses, a rate limit and its burst shared out over them, and a status row for each service, so one that fails is counted and does
not stop the others. Files that have been landed are read by Spark's own readers, with fixed schemas.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pricewright.config import Settings
from pricewright.schema import PRICE_FIELDS, SEED
from pricewright.sources import aws, azure, gcp


def offers(spark: SparkSession, path: str, service: str | None = None) -> DataFrame:
    """Offer files (JSON, gzip or not) of a service, or of the services that the files are named after."""
    rows = spark.read.schema(aws.OFFER).option("multiLine", True).json(path)
    return rows.withColumn("service", F.lit(service) if service else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-[a-z]{2}(?:-[a-z]+)+-\d)?\.json(?:\.gz)?$", 1))


def region_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files that name each region's offer file."""
    return spark.read.schema(aws.REGION_INDEX).option("multiLine", True).json(path)


def azure_rows(spark: SparkSession, path: str) -> DataFrame:
    return azure.from_pages(spark.read.schema(azure.PAGE).option("multiLine", True).json(path))


def azure_answers(pages: DataFrame) -> DataFrame:
    """Rows of what the data source ``pages`` has fetched; failed fetches have none. A page is parsed in a generator, so once:
    as a column it would be parsed again by each condition on it."""
    read = pages.where("body is not null").select("service", "page", F.explode(F.array(F.from_json("body", azure.PAGE)["Items"])).alias("Items"))
    return azure.from_pages(read)


def gcp_skus(spark: SparkSession, path: str) -> DataFrame:
    return gcp.from_pages(spark.read.schema(gcp.PAGE).option("multiLine", True).json(path))


def seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of products; absent texts are empty."""
    rows = spark.read.schema(SEED).option("multiLine", True).json(path)
    text = lambda c: F.coalesce(c, F.lit(""))
    prices = F.transform(F.coalesce("prices", F.array()), lambda p: F.struct(*(text(p[f]).alias(f) for f in PRICE_FIELDS)))
    return rows.select(text(F.col("productHash")).alias("product_hash"), text(F.col("sku")).alias("sku"), text(F.col("vendorName")).alias("vendor_name"), text(F.col("region")).alias("region"), text(F.col("service")).alias("service"), text(F.col("productFamily")).alias("product_family"), "attributes", prices.alias("prices"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """provider, kind, toml of definition files ``<provider>/<kind>.toml`` right under ``path``."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)\.toml$", 1).alias("provider"), F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)\.toml$", 2).alias("kind")
    return spark.read.text(f"{path}/*/*.toml", wholetext=True).select(*name, F.col("value").alias("toml"))


def catalog_bundle(entries: DataFrame) -> dict:
    """The catalog as one document: entries by provider and kind, their number, and the SHA-256 that serves as ETag.
    A catalog is written by hand and small; it is put together on the driver."""
    rows = sorted((r.provider, r.kind, r.toml) for r in entries.select("provider", "kind", "toml").toLocalIterator())
    digest = hashlib.sha256()
    for row in rows:
        for part in row:
            digest.update(part.encode() + b"\0")
    return {"schema_version": "1", "hash": digest.hexdigest(), "count": len(rows), "entries": [{"provider": p, "kind": k, "toml": t} for p, k, t in rows]}


def catalog_response(bundle: dict, if_none_match: str | None = None) -> tuple[int, str, str]:
    """Status, ETag and body of a catalog request; no body if the client has this version."""
    etag = f'"{bundle["hash"]}"'
    return (304, etag, "") if if_none_match == etag else (200, etag, json.dumps(bundle))


class Failed(Exception):
    """A fetch that may or may not be worth another try."""

    def __init__(self, message: str, again: bool = True):
        super().__init__(message)
        self.again = again


def with_retries(fetch: Callable[[], str], tries: int = 5, pause: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``fetch`` until it succeeds, pauses doubling, or fails for good."""
    for n in range(tries):
        try:
            return fetch()
        except Failed as e:
            if not e.again or n == tries - 1:
                raise
            sleep(pause * 2**n)
    raise AssertionError


class RateLimit:
    """At most ``rate`` calls a second after a burst of ``burst``; a part of a common limit, whose burst may be 0, saves up
    one call at most."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def share(self, i: int, n: int) -> RateLimit:
        """The limit of the i-th of ``n`` callers: all together call as often as this limit lets one."""
        return RateLimit(self.rate / n, self.burst // n + (i < self.burst % n), self.clock, self.sleep)

    def wait(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(max(1, self.burst), self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def odata_quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def _link(page: str, field: str) -> str:
    """The link to the next page, or its token; empty on the last page. A page that is no JSON object is a failed fetch."""
    try:
        return json.loads(page).get(field) or ""
    except (ValueError, AttributeError) as e:
        raise Failed(f"not a page: {e}", again=False) from e


class _Services(InputPartition):
    def __init__(self, number: int, names: list[str]):
        self.number, self.names = number, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.services = [s for s in options.get("services", "").split(";") if s]
        self.url, self.next = options["url"], options.get("next", "NextPageLink")
        self.at_once = max(1, min(len(self.services), int(options.get("concurrency", 8))))
        self.per_second, self.burst = float(options.get("rate", 20)), int(options.get("burst", 5))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 10))
        self.starts, self.most = json.loads(options.get("starts", "{}")), int(options.get("most", 0))

    def partitions(self) -> list[InputPartition]:
        """As many as may be read at once; each reads its services one after another, within its share of the limit."""
        return [_Services(i, self.services[i :: self.at_once]) for i in range(self.at_once if self.services else 0)]

    def _fetch(self, url: str) -> str:
        from urllib import error, request

        try:
            with request.urlopen(url, timeout=120) as answer:  # noqa: S310
                return answer.read().decode()
        except error.HTTPError as e:
            raise Failed(str(e), e.code == 429 or e.code >= 500) from e
        except OSError as e:
            raise Failed(str(e)) from e

    def read(self, partition: _Services) -> Iterator[tuple]:
        limit = RateLimit(self.per_second, self.burst).share(partition.number, self.at_once)
        for name in partition.names:
            yield from self._pages(name, limit)

    def _pages(self, service: str, limit: RateLimit) -> Iterator[tuple]:
        from urllib.parse import quote

        first = self.url.replace("{service}", quote(odata_quoted(service)))
        begun, link = self.starts.get(service, (0, None))
        n, more = begun, True
        try:
            while more and (not self.most or n < begun + self.most):
                limit.wait()
                url = first if not link else link if "://" in link else f"{first}&pageToken={quote(link)}"
                page = with_retries(lambda url=url: self._fetch(url), self.tries, self.pause)
                link = _link(page, self.next)
                yield service, n, page, None
                n, more = n + 1, bool(link)
        except Failed as e:
            yield service, n, None, str(e)


class Pages(DataSource):
    """``spark.read.format("pages")``: service, page, body, error. Options: services (by semicolons), url with
    ``{service}``, next (the field of the next page's link or token), concurrency (services read at once), rate and burst
    (of all together), tries, pause; starts (as JSON, for services that do not begin anew, the number of a page and its
    link or token) and most (pages of a service, 0 for all)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "service string, page int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def pages(spark: SparkSession, vendor: str, services: list[str], url: str, settings: Settings | None = None, **options: str) -> DataFrame:
    """What a vendor's API says about ``services``, as many at once as the settings have for the vendor."""
    spark.dataSource.register(Pages)
    at_once = (settings or Settings()).concurrency_for(vendor)
    return spark.read.format("pages").options(services=";".join(services), url=url, concurrency=str(at_once), **options).load()


def failed_services(pages: DataFrame) -> int:
    return pages.where("error is not null").select("service").distinct().count()

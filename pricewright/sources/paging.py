"""Reading a vendor's pages in rounds, so that what has stopped goes on where it was.

A round asks for a bounded number of pages of each service that has more, as many services at once as the settings allow,
and lands them in a folder of its own. A position, which only one reader can take by its number, then says which folders
hold pages and, for each service, the number of the next page and its link or token. What a lost executor has not
returned is asked for again from the round's position; a round that no position lists is not read. The driver holds the
positions, a line for each service, and no pages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.config import Settings
from pricewright.plans.runs import published
from pricewright.sources import landed

#: Pages of a service that a round asks for: what a stop costs at most.
MOST = 20
LANDED = "service string, page int, body string, next string, error string"


class Moved(RuntimeError):
    """Another reader has taken the next position."""


class Paging:
    """One pass over a vendor's services in the folder ``path``. A pass begun anew takes another folder.

    A service without pages has one answer without items. A service that fails keeps the pages that came before, and
    ``read`` tries it again from the one that failed. Services named twice are read once; one that is added later
    begins at its first page.
    """

    def __init__(self, spark: SparkSession, path: str, vendor: str, services: Iterable[str], url: str, settings: Settings | None = None, most: int = MOST, **options: str):
        if most < 1:
            raise ValueError("a round asks for at least one page")
        self.spark, self.path, self.vendor, self.services = spark, path.rstrip("/"), vendor, sorted(set(services))
        self.url, self.settings, self.most, self.options = url, settings, most, options
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _state(self) -> tuple[int, dict]:
        """The number of the last position, and what it says."""
        numbers = [int(n) for s in self._fs.listStatus(self._at("_at")) if (n := s.getPath().getName()).isdigit()] if self._fs.exists(self._at("_at")) else []
        if not numbers:
            return 0, {"folders": [], "services": {}}
        return max(numbers), json.loads(self.spark.read.text(f"{self.path}/_at/{max(numbers)}", wholetext=True).first().value)

    def positions(self) -> dict[str, tuple[int, str | None, str | None]]:
        """Of each service that has been asked: the pages that have landed, the link or token of the next one (None if
        there is none), and the error that the last try ended with."""
        return {s: tuple(p) for s, p in self._state()[1]["services"].items()}

    def open(self) -> list[str]:
        """Services that have more pages: not yet asked, stopped on the way, or failed."""
        return self._open(self._state()[1])

    def _open(self, state: dict) -> list[str]:
        return [s for s in self.services if (p := state["services"].get(s)) is None or p[1] or p[2]]

    def round(self, services: Iterable[str] | None = None) -> list[str]:
        """Lands the next pages of ``services`` (by default of all that are open); returns those that have more and have
        not failed."""
        n, state = self._state()
        asked = [s for s in self._open(state) if services is None or s in set(services)]
        if not asked:
            return []
        starts = {s: p[:2] for s in asked if (p := state["services"].get(s))}
        pages = landed.pages(self.spark, self.vendor, asked, self.url, self.settings, **{**self.options, "starts": json.dumps(starts), "most": str(self.most)})
        folder, link = f"pages-{uuid.uuid4().hex}", F.get_json_object("body", f"$.{self.options.get('next', 'NextPageLink')}")
        pages.withColumn("next", F.when(link != "", link)).select("service", "page", "body", "next", "error").write.parquet(f"{self.path}/{folder}")
        new = self.spark.read.schema(LANDED).parquet(f"{self.path}/{folder}")
        # the last page of a service tells its next link; where that page failed, its own link is that of the one before
        ends = new.groupBy("service").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max_by("next", F.when(F.col("error").isNull(), F.col("page"))).alias("next"), F.max("error").alias("error"))
        said = dict(state["services"])
        for r in ends.collect():
            before, link, _ = said.get(r.service, (0, None, None))
            said[r.service] = [before + r.n, r.next if r.n else link, r.error]
        if not published(self._fs, self._at, "_at", n + 1, json.dumps({"folders": [*state["folders"], folder], "services": said})):
            self._fs.delete(self._at(folder), True)
            raise Moved(f"position {n + 1} has been taken")
        for old in range(1, n):
            self._fs.delete(self._at(f"_at/{old}"), False)
        return [s for s in asked if said[s][1] and not said[s][2]]

    def read(self) -> DataFrame:
        """All pages, those that earlier readers have landed among them, once each; for services that have failed in the
        end, a row with the error. As the data source ``pages`` returns them."""
        left = self.round()
        while left:
            left = self.round(left)
        return self.landed()

    def landed(self) -> DataFrame:
        """What has landed so far, and the errors of the last tries."""
        state = self._state()[1]
        failed = [(s, p[0], None, p[2]) for s, p in sorted(state["services"].items()) if p[2]]
        errors = self.spark.createDataFrame(failed, "service string, page int, body string, error string")
        if not state["folders"]:
            return errors
        pages = self.spark.read.schema(LANDED).parquet(*(f"{self.path}/{f}" for f in state["folders"]))
        return pages.where("error is null").select("service", "page", "body", "error").unionByName(errors)


class PagedSource:
    """A vendor for ``Engine.ingest`` that is read by ``Paging``: one batch, as slots are covered over a whole service.
    ``products`` makes products of answers."""

    def __init__(self, name: str, paging: Paging, products: Callable[[DataFrame], DataFrame]):
        self.name, self._paging, self._products = name, paging, products

    def batches(self, spark: SparkSession) -> Iterator[DataFrame]:
        yield self._products(self._paging.read())

    def failed_services(self) -> int:
        return sum(1 for s, p in self._paging.positions().items() if p[2] and s in self._paging.services)

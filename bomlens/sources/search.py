"""Search of remote projects as a data source: filters go to the service, pages are read in lanes until one is empty.

The service is a function from a query and a page to rows; offline it reads a table's rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "full_name string, language string, stars long, size_kb long"
Fetch = Callable[[dict, int, int], list[tuple]]
#: Lanes that read side by side; how often a page is asked for before its error is raised, and the pause before the second time (then doubled).
LANES, ATTEMPTS, PAUSE_S = 4, 3, 0.1


class PageError(RuntimeError):
    """A page that could not be read."""


class Lane(InputPartition):
    def __init__(self, number: int, step: int):
        self.number, self.step = number, step


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, query: dict, limit: int):
        self.fetch, self.query, self.limit = fetch, dict(query), limit

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """The language and bounds of stars are the service's; what it can't do is left to Spark. Bounds are whole numbers, both inclusive."""
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("language",) and isinstance(f, EqualTo) and self.query.get("language") in (None, value):
                self.query["language"] = value
            elif at == ("stars",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self._bound("stars_min", value + isinstance(f, GreaterThan), max)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self._bound("stars_max", value - isinstance(f, LessThan), min)
            else:
                yield f

    def _bound(self, name: str, value: int, better: Callable) -> None:
        was = self.query.get(name)
        self.query[name] = str(value if was is None else better(int(was), value))

    def partitions(self) -> list[Lane]:
        """Lane n reads pages n, n + LANES, ...; how many pages there are is known only when one is empty."""
        pages = -(-self.limit // self.size())
        step = max(1, min(LANES, pages))
        return [Lane(n, step) for n in range(step)]

    def size(self) -> int:
        """Pages have 1 to 100 rows."""
        return min(100, max(1, self.limit))

    def page(self, number: int) -> list[tuple]:
        """One page; a failure is tried again alone, and at last raised with the page's number."""
        for attempt in range(ATTEMPTS):
            try:
                return self.fetch(self.query, number, self.size())
            except Exception as e:  # noqa: BLE001  what a service raises
                if attempt + 1 == ATTEMPTS:
                    raise PageError(f"page {number} of {self.query}: {e}") from e
                time.sleep(PAUSE_S * 2**attempt)
        return []

    def read(self, lane: Lane) -> Iterator[tuple]:
        for number in range(lane.number, -(-self.limit // self.size()), lane.step):
            rows = self.page(number)
            if not rows:
                return
            yield from rows[: self.limit - number * self.size()]


def search_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; options: language, stars_min, stars_max, limit. With
    ``spark.sql.python.filterPushdown.enabled`` on, filters on language and stars reach the service before the limit; otherwise give them as options."""

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            o = self.options
            return PagedReader(fetch, {k: o.get(k) for k in ("language", "stars_min", "stars_max")}, int(o.get("limit", "10")))

    return Search


def table_service(folder: str) -> Fetch:
    """A stand-in for the service over a Parquet table of the source's columns: best first, ties by name. A worker reads the answer to a query once."""
    held: dict[tuple, list[tuple]] = {}

    def fetch(query: dict, page: int, size: int) -> list[tuple]:
        key = tuple(sorted(query.items()))
        if key not in held:
            import pyarrow.compute as pc
            import pyarrow.dataset as ds
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(folder)
            keep = pc.scalar(True)
            if query.get("language") is not None:
                keep &= pc.field("language") == query["language"]
            if query.get("stars_min") is not None:
                keep &= pc.field("stars") >= int(query["stars_min"])
            if query.get("stars_max") is not None:
                keep &= pc.field("stars") <= int(query["stars_max"])
            t = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["full_name", "language", "stars", "size_kb"], filter=keep).sort_by([("stars", "descending"), ("full_name", "ascending")])
            held.clear()
            held[key] = list(zip(*(c.to_pylist() for c in t.columns)))
        return held[key][page * size : (page + 1) * size]

    return fetch


def search(spark: SparkSession, source: str, *, language: str, limit: int, stars: tuple[int, int] | None = None) -> DataFrame:
    """The best projects of a language, each once."""
    reader = spark.read.format(source).option("language", language).option("limit", str(limit))
    if stars:
        reader = reader.option("stars_min", str(stars[0])).option("stars_max", str(stars[1]))
    return reader.load().dropDuplicates(["full_name"]).orderBy(F.desc("stars"), "full_name").limit(limit)


def search_languages(spark: SparkSession, source: str, languages: list[str], limit: int) -> DataFrame:
    """A quota for each language, then each project once."""
    from bomlens.operators.selection import quotas

    found = None
    for language, quota in quotas(limit, languages).items():
        if quota:
            one = search(spark, source, language=language, limit=quota)
            found = one if found is None else found.unionByName(one)
    return found.dropDuplicates(["full_name"])

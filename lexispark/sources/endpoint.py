"""A SPARQL endpoint as a data source: spark.read.format("sparql").option("endpoint", url).option("query", text).load().

Each task asks for one page of the result (LIMIT and OFFSET are added to the query), so a query that is read in pages needs an ORDER BY of its own. All columns are
strings, named by the query's variables; unbound is null.
"""

from __future__ import annotations

import json
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def ask(endpoint: str, query: str, timeout: float = 60.0) -> dict:
    """What the endpoint says, as the SPARQL protocol has it."""
    request = Request(endpoint, urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"})
    with urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


class EndpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> StructType:
        """By `vars` (comma-joined), or the query's outputs."""
        named = self.options.get("vars")
        if named is None:
            from lexispark.plans.sparql_text import parse_query

            q = parse_query(self.options["query"])
            named = ",".join(v.name for v in q.outputs)
        return StructType([StructField(v.strip(), StringType()) for v in named.split(",")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[_Page]:
        """One page, or `pages` of `pagesize` rows each; the last one reads on until a page isn't full."""
        return [_Page(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, page: _Page):
        size = int(self.options.get("pagesize", 0))
        offset, last = page.offset * size, page.offset == int(self.options.get("pages", 1)) - 1
        while True:
            query = self.options["query"] + (f"\nLIMIT {size} OFFSET {offset}" if size else "")
            found = ask(self.options["endpoint"], query, float(self.options.get("timeout", 60)))["results"]["bindings"]
            for b in found:
                yield tuple(b[v]["value"] if v in b else None for v in self.names)
            if not size or not last or len(found) < size:
                return
            offset += size


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EndpointSource)

"""Types of named entities: their names, gathered once by a query, the models that say how much a span looks like one, and resolving a span to an entity.

Everything that is built is a table under the type's folder (results, aliases, grams, ratings, lengths); what is there is not built again unless asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import aliases, info, standardise
from lexispark.operators import models, similarity, store
from lexispark.plans.sparql_text import load_query
from lexispark.sources import endpoint as remote
from lexispark.sources import rdf


@dataclass(frozen=True)
class EntityType:
    """query_file: SPARQL with the outputs entity and name; endpoint: the name of a graph given to build(), or a URL; result_file: a result in JSON, read instead of asking."""

    name: str
    folder: str
    query_file: str | None = None
    endpoint: str | None = None
    result_file: str | None = None
    most_words: int = 3
    gram: int = 3
    keep: int = 5
    cutoff: float = 0.1

    @staticmethod
    def from_config(config: dict) -> EntityType:
        q, i = config.get("query", {}), config.get("identifier", {})
        more = {k: v for k, v in (("keep", i.get("max_matches")), ("cutoff", i.get("max_percent_diff"))) if v is not None}
        return EntityType(config["name"], config["model"]["build_folder"], q.get("query_file"), q.get("endpoint"), q.get("result_file"), **more)

    def _at(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _ask(self, spark: SparkSession, graphs: dict[str, DataFrame]) -> DataFrame:
        if self.result_file is not None and (self.endpoint is None or store.exists_file(spark, self.result_file)):
            return rdf.sparql_json(spark, self.result_file).select("entity", "name")
        if self.query_file is None or self.endpoint is None:
            raise ValueError(f"{self.name} has neither a result nor a query with an endpoint")
        if self.endpoint in graphs:
            return load_query(self.query_file).to_df(graphs[self.endpoint]).select("entity", "name")
        remote.register(spark)
        with open(self.query_file) as f:
            return spark.read.format("sparql").option("endpoint", self.endpoint).option("query", f.read()).load().select("entity", "name")

    def build(self, spark: SparkSession, graphs: dict[str, DataFrame] | None = None, rebuild: bool = False) -> EntityType:
        results = store.built(spark, self._at("results"), lambda: self._ask(spark, {} if graphs is None else graphs), rebuild)
        named = store.built(spark, self._at("aliases"), lambda: alias_rows(results), rebuild).select(F.col("stand").alias("s"))
        grams = store.built(spark, self._at("grams"), lambda: similarity.gram_model(named, "s", self.gram), rebuild)
        store.built(spark, self._at("lengths"), lambda: models.distribution(named.select(F.length("s").alias("v")), "v"), rebuild)
        store.built(spark, self._at("ratings"), lambda: models.distribution(named.join(models.rate(named, "s", grams, self.gram), "s"), "rating"), rebuild)
        return self

    def clean(self, spark: SparkSession) -> None:
        for table in ("results", "aliases", "grams", "lengths", "ratings"):
            store.clean(spark, self._at(table))

    def aliases(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._at("aliases"))

    def probabilities(self, items: DataFrame, item: str) -> DataFrame:
        """(item, p) of each distinct item: the product of where its length and its rating lie among the names' lengths and ratings."""
        read = items.sparkSession.read.parquet
        own = items.select(item).distinct()
        rated = models.rate(own, item, read(self._at("grams")), self.gram).withColumn("_v", F.length(item))
        placed = models.cdf(models.cdf(rated, "rating", read(self._at("ratings")), "_p"), "_v", read(self._at("lengths")), "_q", whole=True)
        return placed.select(item, models.joined_probability([("_p", 1.0), ("_q", 1.0)]).alias("p"))

    def identify(self, asked: DataFrame, query: str) -> DataFrame:
        """(query, uri, given, d, gap, rank) of the entities that each standardised query may mean: the closest and those that tie with it, by rank."""
        own = self.aliases(asked.sparkSession)
        ranked = similarity.identify(asked, query, own.select("stand", "uri").distinct(), "stand", "uri", self.gram, self.keep)
        # an entity has one given name
        given = own.groupBy("uri").agg(F.min("given").alias("given"))
        return similarity.near_ties(ranked, query, self.cutoff).join(given, "uri").select(query, "uri", "given", "d", "gap", "rank")


def alias_rows(results: DataFrame) -> DataFrame:
    """(uri, given, stand, ord) from (entity, name): the name, and its first and last word if it has two at least."""
    each = results.where("entity is not null and name is not null").select(F.col("entity").alias("uri"), F.col("name").alias("given"), F.posexplode(aliases(F.col("name"))).alias("ord", "_a"))
    return each.select("uri", "given", standardise(F.col("_a")).alias("stand"), "ord").where("stand <> ''")


class EntityTypes:
    """The types of a configuration, by name."""

    def __init__(self, types: list[EntityType]):
        self.types = {t.name: t for t in types}

    @staticmethod
    def from_config(configs: list[dict]) -> EntityTypes:
        return EntityTypes([EntityType.from_config(c) for c in configs])

    def __getitem__(self, name: str) -> EntityType:
        return self.types[name]

    def __iter__(self) -> Iterator[EntityType]:
        return iter(self.types.values())

    def build(self, spark: SparkSession, graphs: dict[str, DataFrame] | None = None, rebuild: bool = False) -> EntityTypes:
        """All types at the same time: each is a chain of small jobs."""
        with ThreadPoolExecutor(max(1, len(self.types))) as pool:
            list(pool.map(lambda t: t.build(spark, graphs, rebuild), self))
        return self

    def clean(self, spark: SparkSession) -> None:
        for t in self:
            t.clean(spark)

    def scored(self, spans: DataFrame) -> DataFrame:
        """spans (…, n, span) with kind and info, -ln p, for every type and every span that may be of it: of few enough words, and of a probability above 0."""
        out = None
        for t in self:
            own = spans.where(F.col("n") <= t.most_words)
            p = t.probabilities(own, "span").where("p > 0").select("span", F.lit(t.name).alias("kind"), info(F.col("p")).alias("info"))
            hit = own.join(p, "span")
            out = hit if out is None else out.unionByName(hit)
        return out

    def resolved(self, named: DataFrame, choose: str | Callable = "first") -> DataFrame:
        """(kind, name, uri, given) for (kind, name): see chosen()."""
        out = None
        for t in self:
            own = named.where(F.col("kind") == t.name).select("kind", "name", standardise(F.col("name")).alias("_s")).distinct()
            found = chosen(t.identify(own.select("_s").distinct(), "_s"), "_s", choose)
            hit = own.join(found, "_s").select("kind", "name", "uri", "given")
            out = hit if out is None else out.unionByName(hit)
        return out


def chosen(ties: DataFrame, query: str, choose: str | Callable[[str, list[tuple[str, str]]], int | None] = "first") -> DataFrame:
    """(query, uri, given): what each query means. choose: "first" takes the closest, "none" only what nothing ties with, and a function gets the query and
    the candidates (given, uri) of those with several, by rank, and says which place, or None. The function runs on the driver; a query has a few candidates at most.
    """
    if choose == "first":
        return ties.where("rank = 1").select(query, "uri", "given")
    many = ties.withColumn("_n", F.count("*").over(Window.partitionBy(query)))
    single = many.where("_n = 1").select(query, "uri", "given")
    if choose == "none":
        return single
    if not callable(choose):
        raise ValueError(f"no way to choose: {choose}")
    asked: dict[str, list[tuple[str, str]]] = {}
    for r in many.where("_n > 1").orderBy(query, "rank").collect():
        asked.setdefault(r[query], []).append((r["given"], r["uri"]))
    taken = [(q, c[k][1], c[k][0]) for q, c in asked.items() if (k := choose(q, c)) is not None]
    return single.union(ties.sparkSession.createDataFrame(taken, single.schema))

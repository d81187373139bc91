"""Triples (s, p, o, o_lang) over the star-schema tables, and readers of the formats that name lists come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import table

EX = "http://ex/"
TYPE, LABEL = "rdf:type", "rdfs:label"


def uri(kind: str, key: str):
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(key).cast("string"))


def _triples(df: DataFrame, s, p: str, o, lang: str | None = None) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(lang).cast("string").alias("o_lang"))


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers, customers, nations and regions, their labels and types, and who supplied what (distinct). One narrow scan for each predicate, so a predicate that a query names reads its table only."""
    t = lambda name: table(spark, sf_dir, name)
    part, supplier, customer, nation, region = t("part"), t("supplier"), t("customer"), t("nation"), t("region")
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        _triples(part, uri("part", "p_partkey"), TYPE, F.lit("ex:Part")),
        _triples(part, uri("part", "p_partkey"), LABEL, F.col("p_name"), "en"),
        _triples(part, uri("part", "p_partkey"), "ex:type", F.col("p_type")),
        _triples(part, uri("part", "p_partkey"), "ex:brand", F.col("p_brand")),
        _triples(supplier, uri("supplier", "s_suppkey"), TYPE, F.lit("ex:Supplier")),
        _triples(supplier, uri("supplier", "s_suppkey"), LABEL, F.col("s_name"), "en"),
        _triples(supplier, uri("supplier", "s_suppkey"), "ex:nation", uri("nation", "s_nationkey")),
        _triples(customer, uri("customer", "c_custkey"), TYPE, F.lit("ex:Customer")),
        _triples(customer, uri("customer", "c_custkey"), "ex:nation", uri("nation", "c_nationkey")),
        _triples(customer, uri("customer", "c_custkey"), "ex:segment", F.col("c_mktsegment")),
        _triples(nation, uri("nation", "n_nationkey"), LABEL, F.col("n_name"), "en"),
        _triples(nation, uri("nation", "n_nationkey"), "ex:region", uri("region", "n_regionkey")),
        _triples(region, uri("region", "r_regionkey"), LABEL, F.col("r_name"), "en"),
        _triples(supplied, uri("part", "l_partkey"), "ex:suppliedBy", uri("supplier", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def write_triples(triples: DataFrame, path: str) -> None:
    """Parquet by predicate, so that a constant predicate prunes partitions."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


#: What a SPARQL result in JSON holds, whatever its variables.
RESULT = "head struct<vars array<string>>, results struct<bindings array<map<string, struct<type string, value string, `xml:lang` string>>>>"


def bindings(documents: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """Rows of the SPARQL results that a column holds as JSON texts: for each variable v, columns v, v_type, v_lang; unbound is null. Other columns of documents come along.

    The texts are parsed once, by a schema that doesn't depend on the variables, and nothing is collected.
    """
    parsed = documents.withColumn("_r", F.from_json(F.col(column), RESULT)).withColumn("_b", F.explode("_r.results.bindings"))
    cols = []
    for v in variables:
        own = F.col("_b")[v]
        cols += [own["value"].alias(v), own["type"].alias(f"{v}_type"), own["xml:lang"].alias(f"{v}_lang")]
    return parsed.select(*[c for c in documents.columns if c != column], *cols)


def variables(documents: DataFrame, column: str) -> list[str]:
    """The variables that the results' heads name, in the order of the first."""
    heads = documents.select(F.from_json(F.col(column), RESULT)["head"]["vars"].alias("v")).where("v is not null")
    return list(dict.fromkeys(v for r in heads.distinct().limit(100).collect() for v in r["v"]))


def result_json(rows: DataFrame, to: str = "result", rows_a_document: int = 1000) -> DataFrame:
    """(to): SPARQL results in JSON, of some rows each; strings are literals, or URIs if they begin with http. Null is unbound."""
    names = rows.columns
    value = lambda c: F.struct(F.when(F.col(c).cast("string").rlike("^https?://"), F.lit("uri")).otherwise(F.lit("literal")).alias("type"), F.col(c).cast("string").alias("value"))
    one = F.struct(*[F.when(F.col(c).isNotNull(), value(c)).alias(c) for c in names])
    part = F.floor(F.monotonically_increasing_id() / rows_a_document)
    grouped = rows.select(one.alias("_b"), part.alias("_part")).groupBy("_part").agg(F.collect_list("_b").alias("bindings"))
    head = F.struct(F.array(*[F.lit(c) for c in names]).alias("vars"))
    return grouped.select(F.to_json(F.struct(head.alias("head"), F.struct("bindings").alias("results"))).alias(to))


def sparql_json(spark: SparkSession, path: str) -> DataFrame:
    """The files of SPARQL results in JSON at path as rows, see bindings()."""
    files = spark.read.text(path, wholetext=True)
    return bindings(files, "value", variables(files, "value"))


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """(name): the last quoted cell of each line of a text table."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r'\| "(.*)"$', 1).alias("name"))
    return lines.where("name <> ''")


def name_frequencies(spark: SparkSession, path: str, least: float = 0.0005) -> DataFrame:
    """(name, percent, sex) from CSV with a header and the columns year, name, percent, sex; rarer names left out."""
    rows = spark.read.option("header", True).schema("year string, name string, percent double, sex string").csv(path)
    return rows.where(F.col("percent") >= least).select(F.lower(F.trim("name")).alias("name"), "percent", "sex")


def names_by_sex(frequencies: DataFrame) -> DataFrame:
    """(name, boy, girl): whether a name is one of boys, and of girls."""
    return frequencies.groupBy("name").agg(F.bool_or(F.col("sex") == "boy").alias("boy"), F.bool_or(F.col("sex") == "girl").alias("girl"))

"""From questions to graph-pattern queries: parse with entity spans that were scored by joins, rank, resolve, construct."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import standardise, tokens
from lexispark.operators import membership
from lexispark.plans.grammar import Grammar, Node, Spans, Terminal, Word, rules
from lexispark.plans.sparql import Lit, Modifiers, Pattern, Query, Ref, Triple, Union, Var
from lexispark.session import table
from lexispark.sources import rdf

#: The shapes of questions: parts of a supplier (of a type, of the type of a part), suppliers of a part or of parts of both types.
RULES = """
Question -> WHAT PartsOf
Question -> WHO SUPPLIED part
Question -> WHICH SUPPLIERS HAVE SUPPLIED BOTH Types PARTS
PartsOf -> Kind HAS supplier SUPPLIED
PartsOf -> Kind HAS supplier SUPPLIED THAT ARE THE SAME TYPE AS part
Kind -> PARTS
Kind -> Types PARTS
Types -> type
Types -> Types AND type
"""
ENTITIES = ("part", "supplier", "type")
NODE = "struct<node_id:int,parent_id:int,depth:int,ord:int,symbol:string,is_terminal:boolean,start:int,end:int,text:string,info:double>"
#: Interpretations that travel together.
BLOCK = 512


def _terminals(spans: dict[str, tuple]) -> dict[str, Terminal]:
    own = rules(RULES)
    names = {s for r in own for s in r.tail} - {r.head for r in own}
    return {s: Spans(spans.get(s, ())) if s in ENTITIES else Word(s) for s in names}


def grammar(spans: dict[str, tuple]) -> Grammar:
    return Grammar(rules(RULES), _terminals(spans))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, stand, uri, name): what questions can name. A name of several parts stands for the least key."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), rdf.uri("part", "k").alias("uri"))
    named = named.unionAll(supplier.select(F.lit("supplier"), "s_name", rdf.uri("supplier", "s_suppkey")))
    named = named.unionAll(part.select(F.lit("type"), "p_type", "p_type").distinct())
    return named.select("kind", standardise(F.col("name")).alias("stand"), "uri", "name")


def scored_spans(questions: DataFrame, known: DataFrame) -> DataFrame:
    """questions (id, text) with tokens and spans: an array of (kind, start, n, info, uri) of the runs of tokens that name an entity, information by how many share the name."""
    asked = questions.select("id", tokens(F.col("text")).alias("tokens"))
    per = known.withColumn("info", F.log2(F.count("*").over(Window.partitionBy("kind", "stand"))).cast("double"))
    hit = membership.spans(asked, "id", "tokens").join(per, F.col("span") == F.col("stand")).select("id", F.struct("kind", "start", "n", "info", "uri").alias("s"))
    found = hit.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return asked.join(found, "id", "left")


def parse(scored: DataFrame) -> DataFrame:
    """(id, interp, consumed, n_tokens, decisions, info, tree) for each derivation of a prefix of a question, in the order of the grammar: all of them, in blocks as they come.

    Parsing runs row by row in the workers; it never calls Spark, as the spans come with the row. The rules are compiled once for a task.
    """
    names = ["id", "interp", "consumed", "n_tokens", "decisions", "info", "tree"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, rows = grammar({}).compiled(), []
        for batch in batches:
            for id_, words, spans in zip(batch["id"], batch["tokens"], batch["spans"], strict=True):
                by: dict[str, list] = {}
                for s in spans if spans is not None else ():
                    by.setdefault(s["kind"], []).append((s["start"], s["n"], s["info"]))
                words = list(words) if words is not None else []
                own = compiled.with_terminals(_terminals({x: tuple(dict.fromkeys(y)) for x, y in by.items()}))
                for k, (tree, end) in enumerate(own.parse_all(words)):
                    rows.append((id_, k, end, len(words), tree.decisions(), float(tree.info), tree.flat()))
                    if len(rows) == BLOCK:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return scored.select("id", "tokens", "spans").mapInPandas(run, f"id long, interp int, consumed int, n_tokens int, decisions array<int>, info double, tree array<{NODE}>")


def best(parses: DataFrame, keep: int = 1) -> DataFrame:
    """The interpretations of each whole question with the least information, the first of equals."""
    w = Window.partitionBy("id").orderBy("info", "interp")
    return parses.where("consumed = n_tokens").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


EX = "ex:"


def construct(tree: Node, uris: dict[tuple[str, int], str]) -> Query:
    """The query of a question's tree. uris: what each (kind, start) resolves to.

    Parts of types asked of a supplier may be of any of the types; suppliers of two types must have supplied parts of both.
    """
    part, supplier = Var("part"), Var("supplier")
    of = lambda leaf: uris[leaf.symbol, leaf.start]
    q = Query()
    q.modifiers = Modifiers(distinct=True, limit=100)
    kinds = [of(x) for x in tree.find("type")]
    suppliers, parts = tree.find("supplier"), tree.find("part")
    if suppliers:
        q.output(part).add(Triple(part, Ref("ex:suppliedBy"), Ref(of(suppliers[0]))))
        options = [Pattern().add(Triple(part, Ref("ex:type"), Lit(k))) for k in kinds]
        if len(options) == 1:
            q.add(options[0].triples[0])
        elif options:
            q.add(Union(options))
        if parts:
            q.add(Triple(Ref(of(parts[0])), Ref("ex:type"), same := Var("same")), Triple(part, Ref("ex:type"), same))
        q.modifiers.order = [(part, False)]
        return q
    q.output(supplier)
    q.modifiers.order = [(supplier, False)]
    if parts:
        return q.add(Triple(Ref(of(parts[0])), Ref("ex:suppliedBy"), supplier))
    for k in kinds:
        own = q.variable("part")
        q.add(Triple(own, Ref("ex:suppliedBy"), supplier), Triple(own, Ref("ex:type"), Lit(k)))
    return q


def ask(spark: SparkSession, sf_dir: str, question: str) -> Query | None:
    """The query that a question means by its best interpretation; None if none covers it."""
    asked = spark.createDataFrame([(1, question)], "id long, text string")
    row = scored_spans(asked, entities(spark, sf_dir)).first()
    by: dict[str, list] = {}
    uris = {}
    for s in row["spans"] or ():
        by.setdefault(s["kind"], []).append((s["start"], s["n"], s["info"]))
        uris.setdefault((s["kind"], s["start"]), s["uri"])
    chosen = None
    for t, end in grammar({k: tuple(dict.fromkeys(v)) for k, v in by.items()}).compiled().parse_all(row["tokens"]):
        if end == len(row["tokens"]) and (chosen is None or t.info < chosen.info):
            chosen = t
    return construct(chosen, uris) if chosen is not None else None


def answer(spark: SparkSession, sf_dir: str, question: str) -> DataFrame | None:
    q = ask(spark, sf_dir, question)
    return None if q is None else q.to_df(rdf.star_triples(spark, sf_dir))

"""From questions to SPARQL by plug-ins: a grammar, and rules that walk the tree of a question and build its query.

A configuration names the entity types, the tokenizer, the grammar's factory and the construction rules (module and class), as JSON has them. Spans are scored by joins
before parsing and names resolved by joins after it; parsing and construction run in the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import tokenizer
from lexispark.operators import membership
from lexispark.plans.entities import EntityTypes
from lexispark.plans.grammar import Grammar, Leaf, Node, Spans
from lexispark.plans.questions import NODE
from lexispark.plans.sparql import Query
from lexispark.plans.sparql_text import parse_query


class GenerationError(Exception):
    """A tree that no query can be made of."""


class GrammarFactory:
    def grammar(self, kinds: list[str]) -> Grammar:
        """A grammar in which the names of the kinds of entities are symbols without rules or terminals."""
        raise NotImplementedError


class ConstructionRule:
    def consume(self, node: Node | Leaf, query: Query, context: Context) -> bool:
        """Adds to the query what the node says. True: nothing below the node is visited."""
        raise NotImplementedError


class Context(dict):
    """What rules tell one another, and which entity each leaf of a tree is: (words, name, uri)."""

    def __init__(self, identities: dict[tuple[str, int], tuple[str, str, str]] | None):
        super().__init__()
        self._identities, self._handed = identities, {}

    def uri(self, leaf: Leaf) -> str:
        """Of the entity that a leaf names; a stand-in while it is tried whether a query can be made."""
        if self._identities is None:
            return "http://nothing/"
        found = self._identities.get((leaf.symbol, leaf.start))
        if found is None:
            raise GenerationError(f"nothing is known as {leaf.value}")
        return found[2]

    def hand(self, node: Node | Leaf, value: object) -> None:
        """Leaves something for whoever visits the node."""
        self._handed[id(node)] = value

    def handed(self, node: Node | Leaf) -> object:
        return self._handed.get(id(node))


def load(config: dict) -> object:
    """An instance of the class that a configuration names."""
    return getattr(import_module(config["module"]), config["class"])()


def construct(tree: Node, rules: list[ConstructionRule], identities: dict | None = None) -> Query:
    """Visits the tree and asks the rules in turn until one stops. A node's first child comes first, the others from the last on: what rules tell one another depends on it."""
    query, context, todo = Query(), Context(identities), [tree]
    while todo:
        node = todo.pop()
        if not any(rule.consume(node, query, context) for rule in rules) and isinstance(node, Node) and node.kids:
            todo += [*node.kids[1:], node.kids[0]]
    return query


def from_flat(nodes) -> Node | Leaf:
    """The tree of an array column as Node.flat() made it; rules aren't kept."""
    kids: dict[int, list] = {}
    made = None
    for x in sorted(nodes, key=lambda x: -x["node_id"]):
        own = tuple(reversed(kids.pop(x["node_id"], [])))
        made = Leaf(x["symbol"], x["text"], x["start"], x["end"], x["info"]) if x["is_terminal"] else Node(-1, x["symbol"], own)
        kids.setdefault(x["parent_id"], []).append(made)
    return made


class Pipeline:
    def __init__(self, spark: SparkSession, config: dict, graphs: dict[str, DataFrame] | None = None):
        self.spark, self.graphs = spark, graphs
        self.types = EntityTypes.from_config(config["named_entity_types"])
        self.tokens = tokenizer(config["tokenizer"])
        generator = config["sparql_generator"]
        self.factory, self.rules = load(generator["grammar_factory"]), [load(c) for c in generator["construction_rules"]]

    def build(self, rebuild: bool = False) -> Pipeline:
        self.types.build(self.spark, self.graphs, rebuild)
        return self

    def clean(self) -> None:
        self.types.clean(self.spark)

    def scored(self, questions: DataFrame) -> DataFrame:
        """questions (id, text) as (id, tokens, spans): what each run of a few tokens may name, and its information."""
        asked = questions.select("id", self.tokens(F.col("text")).alias("tokens"))
        each = membership.spans(asked, "id", "tokens", max(t.most_words for t in self.types))
        found = self.types.scored(each).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "n", "info"))).alias("spans"))
        return asked.join(found, "id", "left")

    def interpreted(self, scored: DataFrame) -> DataFrame:
        """(id, interp, info, tree): of each question's whole readings, the one with the least information (the first of equals) that a query can be made of."""
        kinds, factory, rules = [t.name for t in self.types], self.factory, self.rules

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grammar = factory.grammar(kinds)
            compiled = grammar.compiled()
            for batch in batches:
                rows = []
                for id_, words, spans in zip(batch["id"], batch["tokens"], batch["spans"], strict=True):
                    words = list(words) if words is not None else []
                    by: dict[str, list] = {k: [] for k in kinds}
                    for s in spans if spans is not None else ():
                        by[s["kind"]].append((s["start"], s["n"], s["info"]))
                    own = compiled.with_terminals(grammar.terminals | {k: Spans(tuple(v)) for k, v in by.items()})
                    best = None
                    # a reading is tried only if it would be the best, so that no reading has to be kept but that one
                    for k, (tree, end) in enumerate(own.parse_all(words)):
                        if end == len(words) and (best is None or tree.info < best[2]):
                            try:
                                construct(tree, rules)
                            except GenerationError:
                                continue
                            best = (id_, k, float(tree.info), tree.flat())
                    if best is not None:
                        rows.append(best)
                yield pd.DataFrame(rows, columns=["id", "interp", "info", "tree"])

        return scored.mapInPandas(run, f"id long, interp int, info double, tree array<{NODE}>")

    def texts(self, questions: DataFrame, choose: str | Callable = "first") -> DataFrame:
        """(id, info, sparql) for each question that has a reading; sparql is null where a name in it is not known, or too many are (see entities.chosen)."""
        read = self.interpreted(self.scored(questions))
        leaves = read.select("id", F.explode("tree").alias("x")).where("x.is_terminal").select("id", F.col("x.symbol").alias("kind"), F.col("x.start").alias("start"), F.col("x.text").alias("name"))
        leaves = leaves.where(F.col("kind").isin([t.name for t in self.types]))
        known = leaves.join(self.types.resolved(leaves.select("kind", "name").distinct(), choose), ["kind", "name"])
        per = known.groupBy("id").agg(F.collect_list(F.struct("kind", "start", "name", "given", "uri")).alias("identities"))
        rules = self.rules

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for tree, identities in zip(batch["tree"], batch["identities"], strict=True):
                    known = {(x["kind"], x["start"]): (x["name"], x["given"], x["uri"]) for x in (identities if identities is not None else ())}
                    try:
                        out.append(construct(from_flat(tree), rules, known).to_sparql())
                    except GenerationError:
                        out.append(None)
                yield pd.DataFrame({"id": batch["id"], "info": batch["info"], "sparql": out})

        return read.join(per, "id", "left").select("id", "info", "tree", "identities").mapInPandas(run, "id long, info double, sparql string")

    def sparql(self, question: str, choose: str | Callable = "first") -> str | None:
        row = self.texts(self.spark.createDataFrame([(1, question)], "id long, text string"), choose).first()
        return row["sparql"] if row else None

    def answer(self, question: str, triples: DataFrame, choose: str | Callable = "first") -> DataFrame | None:
        """What the question's query finds among the triples; None if it has no query."""
        text = self.sparql(question, choose)
        return parse_query(text).to_df(triples) if text else None

"""Questions about books, their authors and genres: a grammar, and the rules that turn its trees into queries.

Over the star schema parts stand for books, suppliers for authors and types of parts for genres; see triples().
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.plans.generator import ConstructionRule, Context, GrammarFactory
from lexispark.plans.grammar import Grammar, Inclusion, Leaf, Node, Word, rules
from lexispark.plans.sparql import Filter, Lit, Modifiers, Pattern, Query, Ref, Triple, Union, Var, call
from lexispark.session import table
from lexispark.sources.rdf import uri

#: The grammar's rules, in order, as the order of a grammar is part of its meaning.
RULES = """
S -> subject_question
subject_question -> books_request
subject_question -> authors_request
books_request -> WHAT general_books HAS author WROTE
books_request -> WHAT BOOKS HAS author WROTE THAT book_info
authors_request -> WHAT general_authors HAS WROTE general_books
authors_request -> WHO HAS WROTE general_books
authors_request -> WHAT AUTHOR WROTE book
authors_request -> WHO WROTE book
general_books -> BOOKS
general_books -> genre
general_books -> genre BOOKS
general_books -> genre AND genre
general_books -> genre AND genre BOOKS
general_authors -> AUTHOR
general_authors -> genre AUTHOR
book_info -> ARE THE SAME GENRE AS book
"""
#: The namespaces of the queries.
NAMESPACES = {
    "dbpprop:": "http://dbpedia.org/property/", "dbp:": "http://dbpedia.org/resource/", "dbpowl:": "http://dbpedia.org/ontology/",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#", "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}
#: A small lexicon of our own: what is a kind of what, and the forms in which a meaning is written. A lexical database can stand in as tables, see membership.hyponym_lemmas.
KINDS = {"author": ("novelist", "poet"), "book": ("novel", "textbook"), "write": ("publish", "scrawl")}
FORMS = {
    "author": "AUTHOR AUTHORS WRITER WRITERS", "novelist": "NOVELIST NOVELISTS", "poet": "POET POETS", "book": "BOOK BOOKS", "novel": "NOVEL NOVELS", "textbook": "TEXTBOOK TEXTBOOKS",
    "write": "WRITE WRITES WROTE WRITTEN PENNED AUTHORED", "publish": "PUBLISH PUBLISHED", "scrawl": "SCRAWL SCRAWLED",
}


def forms(meaning: str) -> frozenset[str]:
    """The forms of a meaning and of all its kinds."""
    return frozenset(FORMS[meaning].split()).union(*[forms(kind) for kind in KINDS.get(meaning, ())])


class Books(GrammarFactory):
    def grammar(self, kinds: list[str]) -> Grammar:
        own = rules(RULES)
        words = {s: Word(s) for r in own for s in r.tail if s not in {x.head for x in own} and s not in kinds}
        # members are compared with joined words, so WILL HAVE is never met; it is kept as a value
        sets = {"WHAT": Inclusion(frozenset(("WHAT", "WHICH")), 1), "HAS": Inclusion(frozenset(("HAVE", "HAS", "WILL", "WILL HAVE", "DONE")), 2)}
        meant = {symbol: Inclusion(forms(meaning), 1) for symbol, meaning in (("AUTHOR", "author"), ("BOOKS", "book"), ("WROTE", "write"))}
        return Grammar(own, words | sets | meant)


def _first(node: Node | Leaf, symbol: str) -> Node | Leaf | None:
    found = node.find(symbol) if isinstance(node, Node) else []
    return found[0] if found else None


def _english(name: Var) -> Filter:
    return Filter(call("langMatches", call("lang", name), Lit("EN")))


class Setup(ConstructionRule):
    def consume(self, node, query: Query, context: Context) -> bool:
        if node.symbol == "subject_question":
            for short, full in NAMESPACES.items():
                query.namespace(short, full)
            query.modifiers = Modifiers(distinct=True, limit=100)
        return False


class BooksRequest(ConstructionRule):
    """Books with their titles and genres, of an author."""

    def consume(self, node, query: Query, context: Context) -> bool:
        if node.symbol != "books_request":
            return False
        book, title, genre = Var("book"), Var("title"), Var("genre")
        context["subject"] = book
        query.output(book, title, genre)
        query.add(Triple(book, query.referent("rdfs:label"), title), Triple(book, query.referent("dbpprop:genre"), genre), _english(title))
        query.add(Triple(book, query.referent("dbpowl:author"), Ref(context.uri(_first(node, "author")))))
        if (general := _first(node, "general_books")) is not None:
            # two genres of the books of one author: either will do
            context.hand(general, book)
            context["either"] = True
        return False


class GeneralBooks(ConstructionRule):
    """Books of genres: of either, or one book of each genre by the same author."""

    def consume(self, node, query: Query, context: Context) -> bool:
        if node.symbol != "general_books":
            return False
        book, genres = context.handed(node), node.find("genre")
        if len(genres) == 1:
            context["either"] = False
        patterns = []
        for leaf in genres:
            one = book or query.variable("book")
            if book is None and "author" in context:
                query.add(Triple(one, query.referent("dbpowl:author"), context["author"]))
            patterns.append(Pattern().add(Triple(one, query.referent("dbpprop:genre"), Ref(context.uri(leaf)))))
        if genres and context.get("either"):
            query.add(Union(patterns))
        else:
            query.add(*[t for p in patterns for t in p.triples])
        return True


class AuthorsRequest(ConstructionRule):
    """Authors with their names, of a book if one is named."""

    def consume(self, node, query: Query, context: Context) -> bool:
        if node.symbol != "authors_request":
            return False
        author, name = Var("author"), Var("name")
        context["author"] = author
        query.output(author, name).add(Triple(author, query.referent("rdfs:label"), name), _english(name))
        if (book := _first(node, "book")) is not None:
            query.add(Triple(Ref(context.uri(book)), query.referent("dbpowl:author"), author))
        return False


class BookInfo(ConstructionRule):
    """Of the same genre as a book."""

    def consume(self, node, query: Query, context: Context) -> bool:
        if node.symbol != "book_info":
            return False
        shared, genre = query.variable("genre"), query.referent("dbpprop:genre")
        query.add(Triple(Ref(context.uri(_first(node, "book"))), genre, shared), Triple(context["subject"], genre, shared))
        return True


def config(folder: str, endpoint: str = "star") -> dict:
    """The pipeline's configuration, with tables under the folder. endpoint: see plans.entities.EntityType."""
    here = Path(__file__).parent
    types = [{"name": n, "query": {"query_file": str(here / f"{n}.sparql"), "endpoint": endpoint}, "model": {"build_folder": f"{folder}/{n}"}} for n in ("author", "book", "genre")]
    return {
        "named_entity_types": types,
        "sparql_generator": {"grammar_factory": {"module": __name__, "class": "Books"}, "construction_rules": [{"module": __name__, "class": c} for c in ("Setup", "BooksRequest", "GeneralBooks", "AuthorsRequest", "BookInfo")]},
        "tokenizer": "SimpleTokenizer",
    }


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as books (parts), authors (suppliers) and genres (types), by the predicates that the queries name."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    label, genre, author = NAMESPACES["rdfs:"] + "label", NAMESPACES["dbpprop:"] + "genre", NAMESPACES["dbpowl:"] + "author"
    of_type = F.concat(F.lit("http://ex/type/"), F.col("p_type"))
    one = lambda df, s, p, o, lang=None: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang"))
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        one(part, uri("part", "p_partkey"), label, F.col("p_name"), "en"), one(part, uri("part", "p_partkey"), genre, of_type), one(part.select("p_type").distinct(), of_type, label, F.col("p_type"), "en"),
        one(supplier, uri("supplier", "s_suppkey"), label, F.col("s_name"), "en"), one(sold, uri("part", "l_partkey"), author, uri("supplier", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out

"""SELECT queries from their text: the grammar of plans.sparql.Query, so that to_sparql() can be read back and query files be run on triples."""

from __future__ import annotations

import re
from pathlib import Path

from lexispark.plans.sparql import Bind, Expr, Filter, Lit, Modifiers, Pattern, Query, Ref, Term, Triple, Union, Var

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"""
    r"""|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*(?::(?:[\w-]|\.(?=[\w-]))*)?|:[\w-]+)|(?P<mark>\^\^|&&|\|\||[<>!]=|[{}().;,*/+<>=!-])"""
)
_RDF_TYPE = Ref("rdf:type")
_AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")
#: Fixed value: functions by the case in which SPARQL writes them.
_FUNCTIONS = {f.lower(): f for f in ("bound", "langMatches", "lang", "regex", "str", "ucase", "lcase", "strlen", "concat", "strstarts", "contains")}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class SparqlError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise SparqlError(f"can't read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.query = 0, Query()

    # tokens

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def word(self, *wanted: str) -> str | None:
        """Passes over one of the words, in any case."""
        kind, text = self.peek()
        if kind in ("name", "mark") and text.upper() in wanted:
            self.at += 1
            return text.upper()
        return None

    def need(self, *wanted: str) -> str:
        found = self.word(*wanted)
        if found is None:
            raise SparqlError(f"{' or '.join(wanted)} is missing before {self.peek()[1]!r}")
        return found

    # terms

    def term(self) -> Term:
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Ref(text[1:-1])
        if kind == "string":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
            if self.peek()[0] == "lang":
                return Lit(value, self.take()[1][1:])
            if self.word("^^"):
                self.term()  # values are strings; their types aren't kept
            return Lit(value)
        if kind == "number":
            return Lit(text)
        if kind == "name" and ":" in text:
            return self.referent(text)
        if kind == "name" and text.lower() in ("true", "false"):
            return Lit(text.lower())
        raise SparqlError(f"a term is missing before {text!r}")

    def referent(self, name: str) -> Ref:
        try:
            return self.query.referent(name)
        except KeyError as e:
            raise SparqlError(str(e)) from None

    # expressions, the loosest first

    _LEVELS = (("||",), ("&&",), ("=", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"))

    def expression(self, level: int = 0):
        if level == len(self._LEVELS):
            return self.primary()
        out = self.expression(level + 1)
        while op := self.word(*self._LEVELS[level]):
            out = Expr(op, (out, self.expression(level + 1)))
        return out

    def primary(self):
        if self.word("!"):
            return Expr("!", (self.primary(),))
        if self.word("("):
            out = self.expression()
            self.need(")")
            return out
        kind, text = self.peek()
        if kind == "name" and text.upper() in _AGGREGATES:
            self.at += 1
            self.need("(")
            op = f"{text.upper()}_DISTINCT" if self.word("DISTINCT") else text.upper()
            args = () if self.word("*") else (self.expression(),)
            self.need(")")
            return Expr(op, args)
        if kind == "name" and ":" not in text and text.lower() in _FUNCTIONS:
            self.at += 1
            self.need("(")
            args = [self.expression()]
            while self.word(","):
                args.append(self.expression())
            self.need(")")
            return Expr(_FUNCTIONS[text.lower()], tuple(args))
        if kind == "number":
            self.at += 1
            return float(text) if "." in text else int(text)
        return self.term()

    # patterns

    def group(self) -> Pattern:
        self.need("{")
        out = Pattern()
        while not self.word("}"):
            if self.word("FILTER"):
                out.add(Filter(self.primary()))
            elif self.word("OPTIONAL"):
                out.add(self.group())
            elif self.word("BIND"):
                out.add(Bind(*self.named()))
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                out.add(Union(branches))
            else:
                for t in self.triples():
                    out.add(t)
            self.word(".")
        return out

    def triples(self) -> list[Triple]:
        subject, out = self.term(), []
        while True:
            predicate = _RDF_TYPE if self.peek() == ("name", "a") and self.take() else self.term()
            if predicate == _RDF_TYPE and "rdf:" in self.query.names:
                predicate = self.referent("rdf:type")
            while True:
                out.append(Triple(subject, predicate, self.term()))
                if not self.word(","):
                    break
            if not self.word(";") or self.peek()[1] in (".", "}"):
                return out

    def named(self) -> tuple:
        """( expression AS ?variable )"""
        self.need("(")
        value = self.expression()
        self.need("AS")
        to = self.term()
        self.need(")")
        if not isinstance(to, Var):
            raise SparqlError("AS needs a variable")
        return value, to

    # the query

    def read(self) -> Query:
        q, m = self.query, Modifiers()
        while self.word("PREFIX"):
            short, (kind, full) = self.take()[1], self.take()
            if kind != "iri":
                raise SparqlError(f"a prefix needs an IRI, not {full!r}")
            q.namespace(short, full[1:-1])
        self.need("SELECT")
        m.distinct, m.reduced = bool(self.word("DISTINCT")), bool(self.word("REDUCED"))
        if not self.word("*"):
            while self.peek()[0] == "var" or self.peek()[1] == "(":
                if self.peek()[0] == "var":
                    q.output(self.term())
                    continue
                value, to = self.named()
                if not isinstance(value, Expr) or value.op.removesuffix("_DISTINCT") not in _AGGREGATES:
                    raise SparqlError("only aggregates can be named among the outputs; use BIND for others")
                q.aggregate(value.op, value.args[0] if value.args else None, to).output(to)
            if not q.outputs:
                raise SparqlError("SELECT needs variables or *")
        self.word("WHERE")
        q.where = self.group()
        if self.word("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var":
                q.group(self.term())
        if self.word("HAVING"):
            q.having = self.primary()
        if self.word("ORDER"):
            self.need("BY")
            while (down := self.word("DESC", "ASC")) or self.peek()[0] == "var" or self.peek()[1].lower() in _FUNCTIONS or self.peek()[1].upper() in _AGGREGATES:
                m.order.append((self.primary(), down == "DESC"))
        while part := self.word("LIMIT", "OFFSET"):
            kind, n = self.take()
            if kind != "number":
                raise SparqlError(f"{part} needs a number")
            setattr(m, part.lower(), int(n))
        if self.peek()[0] != "end":
            raise SparqlError(f"can't read on from {self.peek()[1]!r}")
        q.modifiers = Modifiers(m.order, m.limit, m.offset, m.distinct, m.reduced)
        return q


def parse_query(text: str) -> Query:
    """The query that a text says. What the model lacks (sub-queries, property paths, CONSTRUCT and so on) is an error."""
    return _Reader(text).read()


def load_query(path: str) -> Query:
    """The query in a file on the driver."""
    return parse_query(Path(path).read_text())

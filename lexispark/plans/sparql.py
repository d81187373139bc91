"""A model of SPARQL SELECT queries: built as objects, printed as text, or lowered to a DataFrame over triples (s, p, o, o_lang).

Lowering: each triple pattern is a filtered projection with a column for each variable; patterns are joined on the variables
they share, those with most constants first and never without a shared variable while one is left; then unions, optionals,
bindings and filters; then grouping, outputs, distinct, order, offset and limit. Unbound is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Term:
    pass


@dataclass(frozen=True)
class Var(Term):
    name: str

    def text(self, names: dict[str, str]) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Ref(Term):
    """A URI."""

    uri: str

    def text(self, names: dict[str, str]) -> str:
        forms = [short + self.uri[len(full) :] for short, full in names.items() if self.uri.startswith(full)]
        return min(forms, key=len) if forms else self.uri if ":" in self.uri and "/" not in self.uri else f"<{self.uri}>"


@dataclass(frozen=True)
class Lit(Term):
    value: str
    lang: str | None = None

    def text(self, names: dict[str, str]) -> str:
        return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"' + (f"@{self.lang}" if self.lang else "")


@dataclass(frozen=True)
class Expr:
    """An expression: its operator and arguments, which are expressions, terms, or Python numbers."""

    op: str
    args: tuple

    def text(self, names: dict[str, str]) -> str:
        a = [x.text(names) if isinstance(x, (Expr, Term)) else str(x) for x in self.args]
        if self.op == "COUNT_DISTINCT":
            return f"COUNT(DISTINCT {a[0]})"
        if self.op in _AGGREGATES:
            return f"{self.op}({a[0] if a else '*'})"
        if self.op in _INFIX:
            return "(" + f" {self.op} ".join(a) + ")"
        return f"!({a[0]})" if self.op == "!" else f"{self.op}({', '.join(a)})"

    def column(self, langs: set[str]) -> Column:
        a = [_column(x, langs) for x in self.args]
        if self.op in _INFIX:
            out = a[0]
            for b in a[1:]:
                out = _INFIX[self.op](out, b)
            return out
        if self.op == "lang":
            return F.col(f"{self.args[0].name}__lang") if self.args[0].name in langs else F.lit(None).cast("string")
        if self.op in _AGGREGATES:
            return _AGGREGATES[self.op](a[0] if a else F.lit(1))
        return _CALLS[self.op](*a)


_INFIX = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "&&": lambda a, b: a & b, "||": lambda a, b: a | b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
}
_CALLS = {
    "!": lambda a: ~a, "bound": lambda a: a.isNotNull(), "langMatches": lambda a, b: (F.lower(a) == F.lower(b)) | F.lower(a).startswith(F.concat(F.lower(b), F.lit("-"))),
    "regex": lambda a, b: F.rlike(a, b), "str": lambda a: a.cast("string"), "ucase": F.upper, "lcase": F.lower, "strlen": lambda a: F.length(a).cast("long"), "concat": F.concat, "strstarts": lambda a, b: a.startswith(b), "contains": lambda a, b: F.contains(a, b),
}
_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT_DISTINCT": F.count_distinct}


def _variables(x) -> set[str]:
    """The variables that an expression or a term names."""
    if isinstance(x, Var):
        return {x.name}
    return set().union(*[_variables(a) for a in x.args]) if isinstance(x, Expr) else set()


def _aggregates_in(x) -> list[Expr]:
    if not isinstance(x, Expr):
        return []
    return [x] if x.op in _AGGREGATES else [y for a in x.args for y in _aggregates_in(a)]


def _replaced(x, by: dict[Expr, Var]):
    if not isinstance(x, Expr):
        return x
    return by[x] if x in by else Expr(x.op, tuple(_replaced(a, by) for a in x.args))


def _column(x, langs: set[str]) -> Column:
    if isinstance(x, Var):
        return F.col(x.name)
    if isinstance(x, Expr):
        return x.column(langs)
    return F.lit(x.value if isinstance(x, Lit) else x.uri if isinstance(x, Ref) else x)


def call(op: str, *args) -> Expr:
    return Expr(op, args)


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term

    def __post_init__(self) -> None:
        if not all(isinstance(x, Term) for x in (self.s, self.p, self.o)):
            raise TypeError("a triple holds variables, references and literals")

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.s, self.p, self.o) if isinstance(x, Var)))


@dataclass(frozen=True)
class Filter:
    condition: Expr


@dataclass(frozen=True)
class Bind:
    value: Expr
    to: Var


@dataclass
class Pattern:
    """A group of patterns; a Pattern added to another is optional."""

    triples: list[Triple] = field(default_factory=list)
    unions: list[list[Pattern]] = field(default_factory=list)
    optionals: list[Pattern] = field(default_factory=list)
    binds: list[Bind] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)

    def add(self, x) -> Pattern:
        kinds = {Triple: self.triples, Filter: self.filters, Pattern: self.optionals, Bind: self.binds}
        if isinstance(x, Union):
            self.unions.append(x.patterns)
        elif type(x) in kinds:
            kinds[type(x)].append(x)
        else:
            raise TypeError(f"can't add a {type(x).__name__} to a pattern")
        return self

    def text(self, names: dict[str, str], depth: int = 1) -> str:
        pad, out = "  " * depth, []
        out += [f"{pad}BIND ({b.value.text(names)} AS ?{b.to.name})" for b in self.binds]
        by_subject: dict[Term, list[Triple]] = {}
        for t in self.triples:
            by_subject.setdefault(t.s, []).append(t)
        for s, own in by_subject.items():
            said = f" ;\n{pad}  ".join(f"{'a' if t.p == Ref('rdf:type') else t.p.text(names)} {t.o.text(names)}" for t in own)
            out.append(f"{pad}{s.text(names)} {said} .")
        for u in self.unions:
            out.append(f"{pad}{{\n" + f"{pad}}} UNION {{\n".join(p.text(names, depth + 1) + "\n" for p in u) + f"{pad}}}")
        out += [f"{pad}OPTIONAL {{\n{p.text(names, depth + 1)}\n{pad}}}" for p in self.optionals]
        out += [f"{pad}FILTER ({f.condition.text(names)})" for f in self.filters]
        return "\n".join(out)

    def names(self) -> set[str]:
        """Every variable that the pattern or a pattern in it names."""
        out = {v for t in self.triples for v in t.variables()} | {b.to.name for b in self.binds}
        out |= set().union(*[_variables(f.condition) for f in self.filters], *[_variables(b.value) for b in self.binds])
        return out.union(*[p.names() for p in self.optionals], *[p.names() for u in self.unions for p in u])

    def lower(self, triples: DataFrame, lang_vars: frozenset[str] = frozenset(), needed: set[str] | None = None, distinct: bool = False) -> DataFrame:
        """The solutions. needed: variables that are used outside (None: all); others go as soon as nothing here needs them, and with distinct equal rows then too."""
        if needed is not None:
            rest = Pattern([], self.unions, self.optionals, self.binds, self.filters)
            needed = needed | rest.names()
        df = _bgp(self.triples, triples, lang_vars, needed, distinct) if self.triples else None
        for patterns in self.unions:
            branches = [p.lower(triples, lang_vars) for p in patterns]
            both = branches[0]
            for b in branches[1:]:
                both = both.unionByName(b, allowMissingColumns=True)
            always = set.intersection(*[set(b.columns) for b in branches])
            df = both if df is None else _join(df, both, "inner", always)
        for p in self.optionals:
            # conditions of an optional pattern may name variables from outside, so they are part of the join
            inner = Pattern(p.triples, p.unions, p.optionals, p.binds).lower(triples, lang_vars)
            outer = [] if df is None else df.columns
            own = [f for f in p.filters if _variables(f.condition) <= set(inner.columns)]
            for f in own:
                inner = inner.where(f.condition.column(_langs(inner.columns)))
            across = [f.condition for f in p.filters if f not in own]
            if df is None:
                df = inner
                for c in across:
                    df = df.where(c.column(_langs(df.columns)))
            else:
                df = _join(df, inner, "left", set(inner.columns), [c for c in across if _variables(c) <= set(outer) | set(inner.columns)])
        langs = _langs(df.columns)
        for b in self.binds:
            df = df.withColumn(b.to.name, _column(b.value, langs))
        for f in self.filters:
            df = df.where(f.condition.column(langs))
        return df


def _langs(columns: list[str]) -> set[str]:
    return {c[: -len("__lang")] for c in columns if c.endswith("__lang")}


@dataclass
class Union:
    patterns: list[Pattern]


def _scan(t: Triple, triples: DataFrame, lang_vars: frozenset[str]) -> DataFrame:
    conditions, columns = None, {}
    for name, x in (("s", t.s), ("p", t.p), ("o", t.o)):
        if isinstance(x, Var) and x.name not in columns:
            columns[x.name] = F.col(name)
            continue
        test = F.col(name) == (columns[x.name] if isinstance(x, Var) else F.lit(x.uri if isinstance(x, Ref) else x.value))
        conditions = test if conditions is None else conditions & test
    if isinstance(t.o, Lit) and t.o.lang:
        conditions = conditions & (F.lower("o_lang") == t.o.lang.lower())
    if isinstance(t.o, Var) and t.o.name in lang_vars and not t.o.name + "__lang" in columns:
        columns[t.o.name + "__lang"] = F.col("o_lang")
    return (triples if conditions is None else triples.where(conditions)).select(*[c.alias(v) for v, c in columns.items()])


def _bgp(patterns: list[Triple], triples: DataFrame, lang_vars: frozenset[str], needed: set[str] | None = None, distinct: bool = False) -> DataFrame:
    """Joined triple patterns. Those that hang together by variables nobody else needs are joined among themselves first and reduced to what is needed, so
    that conditions on different variables meet as small sets, not as products."""
    if needed is None:
        return _joined(patterns, triples, lang_vars, None, False)
    groups: list[list[Triple]] = []
    for t in patterns:
        own = set(t.variables()) - needed
        near = [g for g in groups if own & {v for x in g for v in x.variables()}]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [t]]
    # in the order of the patterns, those that have constants first
    groups.sort(key=lambda g: (-max(map(_constants, g)), min(patterns.index(t) for t in g)))
    parts = [_joined(sorted(g, key=patterns.index), triples, lang_vars, needed, distinct) for g in groups]
    df = parts.pop(0)
    while parts:
        i = next((i for i, p in enumerate(parts) if set(p.columns) & set(df.columns)), 0)
        part = parts.pop(i)
        df = _join(df, part, "inner", set(part.columns))
    return df


def _constants(t: Triple) -> int:
    return 2 * (not isinstance(t.o, Var)) + 2 * (not isinstance(t.s, Var)) + (not isinstance(t.p, Var))


def _joined(patterns: list[Triple], triples: DataFrame, lang_vars: frozenset[str], needed: set[str] | None, distinct: bool) -> DataFrame:
    todo = sorted(patterns, key=lambda t: -_constants(t))
    first = todo.pop(0)
    df, bound = _scan(first, triples, lang_vars), set(first.variables())
    while todo:
        i = next((i for i, t in enumerate(todo) if bound & set(t.variables())), 0)
        t = todo.pop(i)
        df = _join(df, _scan(t, triples, lang_vars), "inner", set(t.variables()))
        bound |= set(t.variables())
        if needed is not None:
            later = needed.union(*[x.variables() for x in todo])
            kept = [c for c in df.columns if c.removesuffix("__lang") in later]
            if len(kept) < len(df.columns):
                df = df.select(*kept).distinct() if distinct else df.select(*kept)
    return df


def _join(a: DataFrame, b: DataFrame, how: str, always: set[str], conditions: list[Expr] = ()) -> DataFrame:
    """On shared variables: equal where both sides always bind them, else compatible (equal or unbound). conditions: what else must hold, over variables of both."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared and not conditions:
        # patterns without a common variable are a product, as the query says
        return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    keys = [c for c in shared if c in always and not c.endswith("__lang")]
    rest = [c for c in shared if c not in keys]
    if not rest and not conditions:
        return a.join(b, keys, how)
    renamed = b.withColumnsRenamed({c: f"{c}__r" for c in shared})
    on = None
    for c in shared:
        test = a[c] == renamed[f"{c}__r"] if c in keys else a[c].isNull() | renamed[f"{c}__r"].isNull() | (a[c] == renamed[f"{c}__r"])
        on = test if on is None else on & test
    langs = _langs([*a.columns, *renamed.columns])
    for c in conditions:
        on = c.column(langs) if on is None else on & c.column(langs)
    joined = a.join(renamed, on, how)
    return joined.select(*[F.coalesce(a[c], renamed[f"{c}__r"]).alias(c) if c in shared else a[c] for c in a.columns], *[renamed[c] for c in renamed.columns if not c.endswith("__r")])


@dataclass
class Modifiers:
    order: list[tuple[Var | Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    reduced: bool = False

    def __post_init__(self) -> None:
        if self.distinct and self.reduced:
            raise ValueError("a query is distinct or reduced, not both")
        if any(x is not None and x < 0 for x in (self.limit, self.offset)):
            raise ValueError("limit and offset can't be negative")


class Query:
    """A SELECT query. order: (variable or expression, descending). Aggregates are over a variable or an expression; None counts rows."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}
        self.where = Pattern()
        self.outputs: list[Var] = []
        self.aggregates: list[tuple[str, Var | Expr | None, Var]] = []
        self.groups: list[Var] = []
        self.having: Expr | None = None
        self.modifiers = Modifiers()
        self._fresh = 0

    def namespace(self, prefix: str, uri: str) -> Query:
        if not prefix.endswith(":"):
            raise ValueError("a prefix ends with :")
        self.names[prefix] = uri
        return self

    def referent(self, prefixed: str) -> Ref:
        short = next((s for s in self.names if prefixed.startswith(s)), None)
        if short is None:
            raise KeyError(f"no namespace for {prefixed}")
        return Ref(self.names[short] + prefixed[len(short) :])

    def variable(self, stem: str) -> Var:
        """A variable that the query doesn't have yet."""
        self._fresh += 1
        return Var(f"{stem}_{self._fresh}")

    def add(self, *xs) -> Query:
        for x in xs:
            self.where.add(x)
        return self

    def output(self, *vs: Var) -> Query:
        self.outputs += vs
        return self

    def aggregate(self, op: str, of: Var | Expr | None, to: Var) -> Query:
        if op not in _AGGREGATES:
            raise KeyError(f"no aggregate {op}")
        self.aggregates.append((op, of, to))
        return self

    def group(self, *vs: Var) -> Query:
        self.groups += vs
        return self

    def to_sparql(self) -> str:
        m = self.modifiers
        made = {to: f"({_aggregate(op, of).text(self.names)} AS ?{to.name})" for op, of, to in self.aggregates}
        said = " ".join(made.get(v) or f"?{v.name}" for v in [*self.outputs, *[to for to in made if to not in self.outputs]])
        out = [f"PREFIX {s} <{u}>" for s, u in self.names.items()]
        out.append("SELECT " + "DISTINCT " * m.distinct + "REDUCED " * m.reduced + (said or "*"))
        out += ["WHERE {", self.where.text(self.names), "}"]
        if self.groups:
            out.append("GROUP BY " + " ".join(f"?{v.name}" for v in self.groups))
        if self.having is not None:
            out.append(f"HAVING ({self.having.text(self.names)})")
        if m.order:
            out.append("ORDER BY " + " ".join(f"DESC({v.text(self.names)})" if down else v.text(self.names) if isinstance(v, Var) else f"ASC({v.text(self.names)})" for v, down in m.order))
        if m.limit is not None:
            out.append(f"LIMIT {m.limit}")
        if m.offset is not None:
            out.append(f"OFFSET {m.offset}")
        return "\n".join(out)

    def _full(self, x):
        """With prefixed references written out by the query's namespaces."""
        if isinstance(x, Ref):
            short = max((s for s in self.names if x.uri.startswith(s)), key=len, default=None)
            return x if short is None else Ref(self.names[short] + x.uri[len(short) :])
        if isinstance(x, Expr):
            return Expr(x.op, tuple(self._full(a) for a in x.args))
        if isinstance(x, Triple):
            return Triple(self._full(x.s), self._full(x.p), self._full(x.o))
        if isinstance(x, Filter):
            return Filter(self._full(x.condition))
        if isinstance(x, Bind):
            return Bind(self._full(x.value), x.to)
        if isinstance(x, Pattern):
            each = lambda xs: [self._full(y) for y in xs]
            return Pattern(each(x.triples), [each(u) for u in x.unions], each(x.optionals), each(x.binds), each(x.filters))
        return x

    def to_df(self, triples: DataFrame) -> DataFrame:
        m, where, outputs = self.modifiers, self._full(self.where), list(self.outputs)
        having, orders = self._full(self.having), [(self._full(v), down) for v, down in m.order]
        grouped = bool(self.aggregates or self.groups or _aggregates_in(having) or any(_aggregates_in(v) for v, _ in orders))
        needed = {v.name for v in outputs} | {v.name for v in self.groups}
        needed |= set().union(*[_variables(of) for _, of, _ in self.aggregates], _variables(having), *[_variables(v) for v, _ in orders])
        df = where.lower(triples, frozenset(_lang_vars(self.where)), needed if outputs else None, m.distinct and not grouped)
        hidden: list[str] = []
        if grouped:
            made = {to.name: _aggregate(op, self._full(of)) for op, of, to in self.aggregates}
            keys = [v.name for v in self.groups if v.name not in made]
            by: dict[Expr, Var] = {e: Var(name) for name, e in made.items()}
            for e in [*_aggregates_in(having), *[e for v, _ in orders for e in _aggregates_in(v)]]:
                if e not in by:
                    hidden.append(f"_hidden{len(hidden)}")
                    by[e] = Var(hidden[-1])
            langs = _langs(df.columns)
            if by:
                df = df.groupBy(*keys).agg(*[e.column(langs).alias(v.name) for e, v in by.items()])
            else:
                df = df.select(*keys).distinct()
            outputs += [to for _, _, to in self.aggregates if to not in outputs]
            if having is not None:
                df = df.where(_replaced(having, by).column(set()))
            orders = [(_replaced(v, by), down) for v, down in orders]
        # what rows are ordered by is a column of its own, so that it may be something that is not put out
        sort = [f"_sort{i}" for i in range(len(orders))]
        df = df.withColumns({c: _column(v, _langs(df.columns)) for c, (v, _) in zip(sort, orders)}) if sort else df
        names = [v.name for v in outputs] if outputs else [c for c in df.columns if not c.endswith("__lang") and c not in hidden and c not in sort]
        if m.distinct:
            # equal rows are one, placed by the first of what they are ordered by
            firsts = [(F.max(c) if down else F.min(c)).alias(c) for c, (_, down) in zip(sort, orders)]
            df = df.groupBy(*names).agg(*firsts) if firsts else df.select(*names).distinct()
        if sort or m.limit is not None or m.offset is not None:
            # the outputs break ties, so that a limit always keeps the same rows
            df = df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, (_, down) in zip(sort, orders)], *names)
        if m.offset:
            df = df.offset(m.offset)
        if m.limit is not None:
            df = df.limit(m.limit)
        return df.select(*names)


def _aggregate(op: str, of: Var | Expr | None) -> Expr:
    return Expr(op, () if of is None else (of,))


def _lang_vars(p: Pattern) -> set[str]:
    def walk(x) -> set[str]:
        if not isinstance(x, Expr):
            return set()
        own = {x.args[0].name} if x.op == "lang" else set()
        return own.union(*[walk(a) for a in x.args]) if x.args else own

    out = set().union(*[walk(f.condition) for f in p.filters], *[walk(b.value) for b in p.binds])
    for q in [*p.optionals, *[b for u in p.unions for b in u]]:
        out |= _lang_vars(q)
    return out

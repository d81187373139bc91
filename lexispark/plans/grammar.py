"""Context-free grammars: rules, rewriting into a form that parses top down, and back-translation of parse trees.

A grammar's symbols are names; a name with a terminal is terminal, all others are nonterminal. Compiling applies, until nothing
changes and from the first again after each success: removal of unreachable rules, of direct left recursion, factoring of a
prefix that all rules of a head share, substitution of one leading nonterminal. Each step can undo itself on a parse tree, so trees
of the compiled grammar turn into trees of the original, whatever was rewritten.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

MOST_STEPS, MOST_SYMBOLS = 1000, 100_000


@dataclass(frozen=True)
class Rule:
    head: str
    tail: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.head} -> {' '.join(self.tail) or 'ε'}"

    @property
    def left_recursive(self) -> bool:
        return bool(self.tail) and self.tail[0] == self.head


def rules(text: str) -> list[Rule]:
    """One rule a line or between semicolons: `S -> A b`; nothing or ε for the empty tail."""
    out = []
    for line in re.split(r"[;\n]", text):
        if line.strip():
            head, _, tail = line.partition("->")
            out.append(Rule(head.strip(), tuple(x for x in tail.split() if x != "ε")))
    return out


# --- terminals: match(stream, at) gives (consumed, value, information) in the order in which they are tried


class Terminal:
    def match(self, stream, at: int) -> Iterable[tuple[int, object, float]]:
        raise NotImplementedError


@dataclass(frozen=True)
class Word(Terminal):
    word: str

    def match(self, stream, at):
        if at < len(stream) and stream[at] == self.word:
            yield 1, self.word, 0.0


@dataclass(frozen=True)
class String(Terminal):
    string: str

    def match(self, stream, at):
        if stream.startswith(self.string, at):
            yield len(self.string), self.string, 0.0


@dataclass(frozen=True)
class Regex(Terminal):
    pattern: str
    flags: int = 0

    def match(self, stream, at):
        if m := re.compile(self.pattern, self.flags).match(stream, at):
            yield m.end() - at, m.groups() or m[0], 0.0


@dataclass(frozen=True)
class Keyword(Terminal):
    """A whole run of word characters that is the keyword."""

    keyword: str
    case_sensitive: bool = False

    def match(self, stream, at):
        m = re.compile(r"\w+").match(stream, at)
        if m and (m[0] == self.keyword or not self.case_sensitive and m[0].lower() == self.keyword.lower()):
            yield len(m[0]), m[0], 0.0


@dataclass(frozen=True)
class Inclusion(Terminal):
    """1 to most_words words, joined without a space, that are a member; shortest first."""

    members: frozenset[str]
    most_words: int = 3

    def match(self, stream, at):
        for n in range(1, min(self.most_words, len(stream) - at) + 1):
            if "".join(stream[at : at + n]) in self.members:
                yield n, tuple(stream[at : at + n]), 0.0


@dataclass(frozen=True)
class Spans(Terminal):
    """Spans that were scored before: (start, n) to information; least information first, then shortest."""

    found: tuple[tuple[int, int, float], ...]

    def match(self, stream, at):
        for info, n in sorted((i, n) for start, n, i in self.found if start == at and at + n <= len(stream)):
            yield n, tuple(stream[at : at + n]), info


@dataclass(frozen=True)
class Repeat(Terminal):
    """A terminal least to most times (None: any number); greedy tries the most first."""

    inner: Terminal
    least: int = 0
    most: int | None = None
    greedy: bool = True

    @property
    def mark(self) -> str:
        lazy = "" if self.greedy else "?"
        if (self.least, self.most) in ((0, None), (0, 1), (1, None)):
            return {(0, None): "*", (0, 1): "?", (1, None): "+"}[self.least, self.most] + lazy
        if self.least == self.most:
            return f"{{{self.least}}}" + lazy
        return f"{{{self.least},{'' if self.most is None else self.most}}}" + lazy

    def match(self, stream, at):
        ends, values = [(0, 0.0)], []
        while self.most is None or len(ends) <= self.most:
            n, info = ends[-1]
            step = next(iter(self.inner.match(stream, at + n)), None)
            if step is None or step[0] == 0:
                break
            ends.append((n + step[0], info + step[2]))
            values.append(step[1])
        order = range(len(ends) - 1, self.least - 1, -1) if self.greedy else range(self.least, len(ends))
        for k in order:
            yield ends[k][0], tuple(values[:k]), ends[k][1]


@dataclass(frozen=True)
class SubGrammar(Terminal):
    """What another grammar derives at the place; the value is its tree."""

    grammar: Grammar

    def match(self, stream, at):
        for tree, end in self.grammar.compiled().derivations(stream, at):
            yield end - at, tree, tree.info


# --- trees


@dataclass(frozen=True, eq=False)
class Leaf:
    symbol: str
    value: object
    start: int
    end: int
    info: float = 0.0


@dataclass(frozen=True, eq=False)
class Node:
    """A rule's use. Trees may be as deep as the input is long, so nothing here recurses."""

    rule: int
    symbol: str
    kids: tuple

    @property
    def info(self) -> float:
        return sum(x.info for x in self.leaves())

    def decisions(self) -> list[int]:
        return [x.rule for x in self.walk() if isinstance(x, Node)]

    def leaves(self) -> list[Leaf]:
        return [x for x in self.walk() if isinstance(x, Leaf)]

    def walk(self, into: Callable[[Node | Leaf], bool] | None = None) -> Iterator[Node | Leaf]:
        """The nodes and leaves in preorder; where `into` says no, neither the node nor what is below it."""
        todo: list[Node | Leaf] = [self]
        while todo:
            x = todo.pop()
            if into is None or into(x):
                yield x
                if isinstance(x, Node):
                    todo.extend(reversed(x.kids))

    def find(self, symbol: str) -> list[Node | Leaf]:
        return [x for x in self.walk() if x.symbol == symbol]

    def expanded(self) -> Node:
        """With the trees of sub-grammars in place of the leaves that hold them."""
        return _rebuild(self, lambda x: Node(x.value.rule, x.symbol, x.value.expanded().kids) if isinstance(x, Leaf) and isinstance(x.value, Node) else x)

    def pretty(self) -> str:
        """A line for each node, indented by its depth; a leaf's value after a colon, ε for a rule without a tail."""
        out, todo = [], [(self, 0)]
        while todo:
            x, depth = todo.pop()
            out.append("  " * depth + x.symbol + (f":{x.value}" if isinstance(x, Leaf) else ""))
            if isinstance(x, Node):
                if not x.kids:
                    out.append("  " * (depth + 1) + "ε")
                todo.extend((k, depth + 1) for k in reversed(x.kids))
        return "\n".join(out)

    def flat(self) -> list[dict]:
        """Nodes in preorder, with their parents, for an array column; trees of sub-grammars are part of it."""
        out: list[dict] = []
        todo: list[tuple[Node | Leaf, int, int, int]] = [(self.expanded(), -1, 0, 0)]
        while todo:
            x, parent, depth, order = todo.pop()
            me, leaf = len(out), isinstance(x, Leaf)
            text = (" ".join(x.value) if isinstance(x.value, tuple) else str(x.value)) if leaf else None
            out.append({"node_id": me, "parent_id": parent, "depth": depth, "ord": order, "symbol": x.symbol, "is_terminal": leaf, "start": x.start if leaf else -1, "end": x.end if leaf else -1, "text": text, "info": float(x.info) if leaf else 0.0})
            if not leaf:
                todo.extend((k, me, depth + 1, i) for i, k in reversed(list(enumerate(x.kids))))
        # from the last node back: a node begins with its first child that has a place, and sums up their information
        for x in reversed(out):
            if x["parent_id"] >= 0:
                up = out[x["parent_id"]]
                up["info"] += x["info"]
                if x["start"] >= 0:
                    up["start"], up["end"] = x["start"], max(up["end"], x["end"])
        return out


def _rebuild(tree: Node, f: Callable[[Node | Leaf], Node | Leaf]) -> Node:
    """f on every leaf and node, children first."""
    done: list = []
    for x in reversed(list(tree.walk())):
        if isinstance(x, Node):
            n = len(x.kids)
            x = Node(x.rule, x.symbol, tuple(reversed(done[len(done) - n :])) if n else ())
            del done[len(done) - n :]
        done.append(f(x))
    return done[0]


Undo = Callable[[Node], Node]


@dataclass
class Grammar:
    rules: list[Rule]
    terminals: dict[str, Terminal] = field(default_factory=dict)
    start: str = ""

    def __post_init__(self) -> None:
        self.start = self.start or self.rules[0].head
        self._compiled: Compiled | None = None

    def parseable(self, with_manipulation: bool = False) -> bool:
        return parseable(self.rules, self.terminals, with_manipulation)

    def compiled(self) -> Compiled:
        if self._compiled is None:
            self._compiled = Compiled(self)
        return self._compiled


def _heads(own: list[Rule]) -> list[str]:
    """Nonterminals in the order in which rules mention them first."""
    heads = {r.head for r in own}
    return [s for s in dict.fromkeys(s for r in own for s in (r.head, *r.tail)) if s in heads]


def _fresh(own: list[Rule], stem: str) -> str:
    taken = {s for r in own for s in (r.head, *r.tail)}
    return next(name for i in range(len(taken) + 1) if (name := f"_{stem}{i}") not in taken)


def _rebuilt(tree: Node, rule: int, kids: tuple | None = None) -> Node:
    return Node(rule, tree.symbol, tree.kids if kids is None else kids)


def _map(tree: Node, f: Undo) -> Node:
    """f on every node, children first."""
    return _rebuild(tree, lambda x: f(x) if isinstance(x, Node) else x)


def parseable(own: list[Rule], terminals: Iterable[str] | None = None, with_manipulation: bool = False) -> bool:
    """Whether the rules can be tried from left to right: no head leads back to itself by first symbols (left out with_manipulation, as compiling
    mends it), and every first symbol without rules is a terminal (if the terminals are given)."""
    heads = {r.head for r in own}
    first = {h: {r.tail[0] for r in own if r.head == h and r.tail} for h in heads}
    if terminals is not None and any(s not in heads and s not in set(terminals) for tail in first.values() for s in tail):
        return False
    if with_manipulation:
        return True
    # heads whose first symbols are all settled are settled; what is left when nothing more is lies on a cycle or leads to one
    needs = {h: {s for s in first[h] if s in heads} for h in heads}
    while settled := [h for h, n in needs.items() if not n]:
        for h in settled:
            del needs[h]
        for n in needs.values():
            n.difference_update(settled)
    return not needs


def remove_useless(own: list[Rule], start: str) -> tuple[list[Rule], Undo, int] | None:
    reached, todo = {start}, [start]
    while todo:
        head = todo.pop()
        for s in (s for r in own if r.head == head for s in r.tail):
            if s not in reached:
                reached.add(s)
                todo.append(s)
    kept = [i for i, r in enumerate(own) if r.head in reached]
    if len(kept) == len(own):
        return None
    return [own[i] for i in kept], lambda t: _rebuilt(t, kept[t.rule]), len(own) - len(kept)


def remove_left_recursion(own: list[Rule]) -> tuple[list[Rule], Undo, int] | None:
    """H -> H b and H -> a become H -> a Z and Z -> b Z, with Z -> ε last; trees lean left again when undone."""
    for head in _heads(own):
        mine = [i for i, r in enumerate(own) if r.head == head]
        recursive = [i for i in mine if own[i].left_recursive]
        if recursive and len(recursive) == len(mine):
            raise ValueError(f"the grammar can't settle: every rule of {head} begins with {head}")
        if not recursive:
            continue
        z = _fresh(own, head)
        new = [Rule(z, (*r.tail[1:], z)) if i in recursive else Rule(head, (*r.tail, z)) if i in mine else r for i, r in enumerate(own)]
        new.append(Rule(z))

        def undo(t: Node, head=head, last=len(own), recursive=frozenset(recursive)) -> Node:
            if t.symbol != head:
                return t
            left, chain = Node(t.rule, head, t.kids[:-1]), t.kids[-1]
            while chain.rule != last:
                left, chain = Node(chain.rule, head, (left, *chain.kids[:-1])), chain.kids[-1]
            return left

        return new, undo, 1
    return None


def factor(own: list[Rule]) -> tuple[list[Rule], Undo, int] | None:
    """A prefix that all rules of a head share goes to one rule, what follows it to a new head."""
    for head in _heads(own):
        mine = [i for i, r in enumerate(own) if r.head == head]
        if len(mine) < 2:
            continue
        n = 0
        while all(n < len(own[i].tail) for i in mine) and len({own[i].tail[n] for i in mine}) == 1:
            n += 1
        if not n:
            continue
        z = _fresh(own, "")
        new = [Rule(z, r.tail[n:]) if i in mine else r for i, r in enumerate(own)] + [Rule(head, (*own[mine[0]].tail[:n], z))]

        def undo(t: Node, added=len(own), head=head) -> Node:
            return Node(t.kids[-1].rule, head, (*t.kids[:-1], *t.kids[-1].kids)) if t.rule == added else t

        return new, undo, 1
    return None


def substitute(own: list[Rule]) -> tuple[list[Rule], Undo, int] | None:
    """The first rule that begins with a nonterminal and goes on is replaced by one rule for each of the nonterminal's, at the end."""
    for i, r in enumerate(own):
        if len(r.tail) < 2 or not (subs := [j for j, s in enumerate(own) if s.head == r.tail[0]]):
            continue
        new = own[:i] + own[i + 1 :] + [Rule(r.head, (*own[j].tail, *r.tail[1:])) for j in subs]

        def undo(t: Node, i=i, subs=tuple(subs), first=len(own) - 1, name=r.tail[0], sizes=tuple(len(own[j].tail) for j in subs)) -> Node:
            if t.rule < first:
                return _rebuilt(t, t.rule if t.rule < i else t.rule + 1)
            k = t.rule - first
            return Node(i, t.symbol, (Node(subs[k], name, t.kids[: sizes[k]]), *t.kids[sizes[k] :]))

        return new, undo, 1
    return None


class Compiled:
    """A grammar whose rules can be tried from left to right without looping. steps: the rules before and after each rewriting."""

    def __init__(self, source: Grammar, most_steps: int = MOST_STEPS):
        self.source, self.rules, self.undos, self.improvements = source, list(source.rules), [], 0
        self.terminals, self.start, self.steps = source.terminals, source.start, [list(source.rules)]
        for _ in range(most_steps):
            steps = (lambda: remove_useless(self.rules, self.start), lambda: remove_left_recursion(self.rules), lambda: factor(self.rules), lambda: substitute(self.rules))
            done = next((x for step in steps if (x := step()) is not None), None)
            if done is None:
                break
            self.rules, undo, n = done
            if sum(len(r.tail) for r in self.rules) > MOST_SYMBOLS:
                raise ValueError(f"the grammar did not settle within {MOST_SYMBOLS} symbols")
            self.undos.append(undo)
            self.steps.append(self.rules)
            self.improvements += n
        else:
            raise ValueError(f"the grammar did not settle in {most_steps} steps; a head may have left-recursive rules only")
        self.by_head: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_head.setdefault(r.head, []).append(i)

    @staticmethod
    def parseable(own: list[Rule]) -> bool:
        return parseable(own)

    def with_terminals(self, terminals: dict[str, Terminal]) -> Compiled:
        """The same rules over other terminals, without compiling again."""
        out = copy.copy(self)
        out.terminals = terminals
        return out

    def to_source(self, tree: Node) -> Node:
        for undo in reversed(self.undos):
            tree = _map(tree, undo)
        return tree

    def intermediates(self, tree: Node) -> list[Node]:
        """The tree in the compiled grammar, in each one before it, and last in the source; a step that changed the leaves is an error."""
        out, leaves = [tree], [x.symbol for x in tree.leaves()]
        for undo in reversed(self.undos):
            out.append(_map(out[-1], undo))
            if [x.symbol for x in out[-1].leaves()] != leaves:
                raise AssertionError(f"rewriting changed the leaves {leaves}")
        return out

    def tree_of(self, decisions: list[int]) -> Node:
        """The tree that a list of decisions, in preorder, describes; leaves have no value and no place."""
        done: list = []
        for x in reversed(self._events(decisions)):
            done.append(x if isinstance(x, Leaf) else self._reduced(x, done))
        return done[0]

    def _events(self, decisions: list[int]) -> list:
        out, left, todo = [], list(reversed(decisions)), [self.start]
        while todo:
            symbol = todo.pop()
            if symbol in self.by_head:
                out.append(left.pop())
                todo.extend(reversed(self.rules[out[-1]].tail))
            else:
                out.append(Leaf(symbol, None, -1, -1))
        return out

    def _reduced(self, rule: int, done: list) -> Node:
        n = len(self.rules[rule].tail)
        kids = tuple(reversed(done[len(done) - n :])) if n else ()
        del done[len(done) - n :]
        return Node(rule, self.rules[rule].head, kids)

    def _tree(self, events) -> Node:
        """From a chain of rules and leaves, the last one first."""
        done: list = []
        while events is not None:
            x, events = events
            done.append(x if isinstance(x, Leaf) else self._reduced(x, done))
        return done[0]

    def _alternatives(self, todo: tuple, events, stream, at: int) -> Iterator[tuple]:
        """What the first symbol to do can become: rules in their order, or what the terminal finds."""
        symbol, rest = todo
        if symbol in self.by_head:
            for i in self.by_head[symbol]:
                after = rest
                for s in reversed(self.rules[i].tail):
                    after = (s, after)
                yield after, (i, events), at
        elif terminal := self.terminals.get(symbol):
            for n, value, info in terminal.match(stream, at):
                yield rest, (Leaf(symbol, value, at, at + n, info), events), at + n

    def _derived(self, stream, at: int) -> Iterator[tuple[tuple, int]]:
        """Every derivation of a prefix as a chain of events, and where it ends. The stack of open choices is a list, so input may be long."""
        open_choices = [iter([((self.start, None), None, at)])]
        while open_choices:
            found = next(open_choices[-1], None)
            if found is None:
                open_choices.pop()
                continue
            todo, events, end = found
            if todo is None:
                yield events, end
            else:
                open_choices.append(self._alternatives(todo, events, stream, end))

    def derivations(self, stream, at: int = 0) -> Iterator[tuple[Node, int]]:
        """(tree of this grammar, where it ends) for every derivation of a prefix: leftmost first, rules and terminals' alternatives in order."""
        for events, end in self._derived(stream, at):
            yield self._tree(events), end

    def parse_all(self, stream) -> Iterator[tuple[Node, int]]:
        """The same with trees of the source grammar."""
        for tree, end in self.derivations(stream):
            yield self.to_source(tree), end

    def parse_full(self, stream) -> Node | None:
        return next((self.to_source(self._tree(events)) for events, end in self._derived(stream, 0) if end == len(stream)), None)

    def parse_partial(self, stream) -> bool:
        return next(self._derived(stream, 0), None) is not None

    def parse_filtered(self, stream, test: Callable[[Node, int], bool]) -> Node | None:
        return next((self.to_source(t) for t, end in self.derivations(stream) if test(t, end)), None)

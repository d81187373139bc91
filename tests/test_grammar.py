import pytest

from lexispark.plans.grammar import Compiled, Grammar, Inclusion, Keyword, Node, Regex, Repeat, Rule, String, SubGrammar, Word, parseable, rules


def made(text, **terminals):
    return Grammar(rules(text), {k: String(v) for k, v in terminals.items()}).compiled()


def shown(c):
    return [str(r) for r in c.rules]


def test_factoring_and_back():
    c = made("S -> a b; S -> a c", a="a", b="b", c="c")
    assert (c.improvements, shown(c)) == (1, ["_0 -> b", "_0 -> c", "S -> a _0"])
    assert c.parse_full("ac").decisions() == [1]


def test_substitution_and_useless():
    c = made("S -> N c; N -> a; N -> b", a="a", b="b", c="c")
    assert shown(c) == ["S -> a c", "S -> b c"]
    assert c.parse_full("bc").decisions() == [0, 2]
    assert shown(made("S -> a; N -> b", a="a", b="b")) == ["S -> a"]


def test_left_recursion_and_back():
    c = made("S -> S b1; S -> a2; S -> S b2; S -> a1", b1="1", b2="2", a1="x", a2="y")
    assert shown(c) == ["_S0 -> b1 _S0", "S -> a2 _S0", "_S0 -> b2 _S0", "S -> a1 _S0", "_S0 -> ε"]
    assert next(t for t, end in c.derivations("x112") if end == 4).decisions() == [3, 0, 0, 2, 4]
    assert c.parse_full("x112").decisions() == [2, 0, 0, 3]
    assert c.parse_full("y2").decisions() == [2, 1]


def test_compilation_golden():
    source = rules("S -> A B; A -> a; A -> S A; B -> b; B -> S B")
    c = Grammar(source, {"a": String("a"), "b": String("b")}).compiled()
    assert c.improvements == 7
    assert shown(c) == ["_0 -> ε", "B -> b", "S -> a B _S0", "_S0 -> ε", "A -> a _0", "B -> a B _S0 B", "_S0 -> a _0 B _S0", "_0 -> b _S0 A", "_0 -> a B _S0 B _S0 A"]
    assert not Compiled.parseable(source) and Compiled.parseable(c.rules)
    tree = next(t for t, end in c.derivations("aabb") if end == 4)
    assert (tree.decisions(), c.to_source(tree).decisions()) == ([2, 5, 1, 3, 1, 3], [0, 1, 4, 0, 1, 3, 3])
    assert [x.symbol for x in c.to_source(tree).leaves()] == [x.symbol for x in tree.leaves()]


def test_filtered_and_partial():
    c = made("S -> A B; A -> a; B -> b A B; B -> b", a="a", b="b")
    tree, end = next((t, e) for t, e in c.derivations("ababa") if e >= 3)
    assert (tree.decisions(), end) == ([2, 1, 3, 1, 0], 4)
    assert not made("S -> a a a", a="a").parse_partial("aa")


def test_a_grammar_that_never_settles_is_an_error():
    with pytest.raises(ValueError, match="settle"):
        Compiled(Grammar(rules("S -> S a; S -> S b"), {}), 50)


@pytest.mark.parametrize(("text", "ok"), [("'test'", True), ("''test'", False), ("'''test'''", True), ("''", True), ("'''", False)])
def test_quoted_string(text, ok):
    c = Grammar(rules("S -> q Body q; Body -> char Body; Body -> q q Body; Body -> "), {"q": String("'"), "char": Regex("[^']")}).compiled()
    assert (c.parse_full(text) is not None) is ok


def test_buffalo_has_two_readings():
    text = "S -> NP VP; NP -> noun; NP -> adj noun; NP -> NP RC; RC -> NP verb; VP -> verb NP"
    c = Grammar(rules(text), {x: Word("BUFFALO") for x in ("noun", "adj", "verb")}).compiled()
    assert sum(end == 8 for _, end in c.derivations(["BUFFALO"] * 8)) >= 2


def test_terminals():
    assert list(Inclusion(frozenset({"WILLSMITH", "WILL"})).match(["WILL", "SMITH"], 0)) == [(1, ("WILL",), 0.0), (2, ("WILL", "SMITH"), 0.0)]
    assert [list(Keyword("test").match("testing Test bla", at)) for at in (0, 8, 12)] == [[], [(4, "Test", 0.0)], []]
    assert list(Keyword("Test", True).match("testing Test bla", 8)) == [(4, "Test", 0.0)]
    assert [n for n, *_ in Repeat(String("a"), 2, 3).match("baaaa", 1)] == [3, 2]
    assert [n for n, *_ in Repeat(String("a"), 2, 3, False).match("baaaa", 1)] == [2, 3]
    assert [n for n, *_ in Repeat(String("a")).match("aa", 0)] == [2, 1, 0]
    marks = [Repeat(String("a"), a, b, g).mark for a, b in ((0, None), (0, 1), (0, 10), (1, None), (1, 1), (1, 10), (2, None), (2, 10)) for g in (True, False)]
    assert marks == "* *? ? ?? {0,10} {0,10}? + +? {1} {1}? {1,10} {1,10}? {2,} {2,}? {2,10} {2,10}?".split()


def test_intermediates_keep_the_leaves():
    text = "S -> A B; A -> t0 t0; A -> t0 t1; B -> t1 t0; B -> t1 t1"
    c = made(text, t0="0", t1="1")
    assert shown(c) == ["_0 -> t0", "_0 -> t1", "_1 -> t0", "_1 -> t1", "B -> t1 _1", "S -> t0 _0 B"]
    trees = c.intermediates(c.tree_of([5, 0, 4, 2]))
    assert [t.decisions() for t in trees] == [[5, 0, 4, 2], [6, 0, 5, 2], [0, 5, 1, 6, 3], [0, 5, 1, 3], [0, 1, 3]]
    assert all([x.symbol for x in t.leaves()] == ["t0", "t0", "t1", "t0"] for t in trees)
    c.undos[0] = lambda t: Node(t.rule, t.symbol, t.kids[:1])
    with pytest.raises(AssertionError, match="leaves"):
        c.intermediates(c.tree_of([5, 0, 4, 2]))


def test_decompiling_a_repeated_terminal():
    own = rules("S -> b a_; S -> S b a_")
    c = Grammar(own, {"b": String("b"), "a_": Repeat(String("a"), 2, 3)}).compiled()
    assert shown(c) == ["S -> b a_ _S0", "_S0 -> b a_ _S0", "_S0 -> ε"]
    assert c.to_source(c.tree_of([0, 2])).decisions() == [0]
    c = Grammar(rules("S -> B a_; B -> B b; B -> b"), {"b": String("b"), "a_": Repeat(String("a"), 2, 3)}).compiled()
    assert shown(c) == ["_B0 -> b _B0", "_B0 -> ε", "S -> b _B0 a_"]
    tree, end = next(c.parse_all("bbaaaa"))
    assert end == 5 and tree.pretty() == "S\n  B\n    B\n      b:b\n    b:b\n  a_:('a', 'a', 'a')"
    assert "".join("".join(x.value) for x in tree.leaves()) == "bbaaa"


def test_walking_with_a_filter_and_finding():
    c = Grammar(rules("S -> A b S; S -> ; A -> a; A -> a a; A -> a a a"), {"a": String("a"), "b": String("b")}).compiled()
    tree = c.parse_full("aabaaabab")
    seen = [x.symbol for x in tree.walk(lambda x: x.symbol != "b")]
    assert seen == ["S", "A", "a", "a", "S", "A", "a", "a", "a", "S", "A", "a", "S"]
    assert tree.find("A")[0].pretty() == "A\n  a:a\n  a:a" and len(tree.find("A")) == 3
    assert [x.symbol for x in tree.walk(lambda x: x.symbol != "S")] == []
    assert tree.pretty().endswith("S\n        ε")


def test_regex_path_and_empty_input():
    c = Grammar(rules("S -> A letters; A -> ; A -> letters dot A"), {"letters": Regex("([a-zA-Z]+)"), "dot": String(".")}).compiled()
    tree = c.parse_full("this.is.a.test")
    assert [x.value for x in tree.leaves()] == [("this",), ".", ("is",), ".", ("a",), ".", ("test",)]
    assert made("S -> ").parse_full("").decisions() == [0] and made("S -> a S; S -> ", a="a").parse_partial("")


def test_sub_grammars_become_part_of_the_tree():
    inner = Grammar(rules("X -> a; X -> b"), {"a": String("a"), "b": String("b")})
    c = Grammar(rules("S -> x S; S -> "), {"x": SubGrammar(inner)}).compiled()
    tree = c.parse_full("abaab")
    assert [x.symbol for x in tree.leaves()] == ["x"] * 5
    flat = tree.expanded()
    assert [x.symbol for x in flat.leaves()] == list("abaab") and [(x.start, x.end) for x in flat.leaves()] == [(i, i + 1) for i in range(5)]
    rows = tree.flat()
    assert sum(r["is_terminal"] for r in rows) == 5 and (rows[0]["start"], rows[0]["end"]) == (0, 5) and rows[1]["symbol"] == "x"


def test_parseable():
    assert parseable(rules("S -> A A"), ["t"]) is False and parseable(rules("S -> A b; A -> a"), ["a", "b"])
    loop = rules("S -> S a; S -> a")
    assert not parseable(loop, ["a"]) and parseable(loop, ["a"], with_manipulation=True)
    assert not Grammar(loop, {"a": String("a")}).parseable() and Grammar(loop, {"a": String("a")}).parseable(True)
    assert parseable([Rule(f"h{i}", (f"h{i + 1}", f"h{i + 1}")) for i in range(3000)] + [Rule("h3000", ("t",))], ["t"])


@pytest.mark.parametrize("text", ["S -> a S; S -> a", "S -> S a; S -> a"])
def test_long_input(text):
    """As deep to the right as to the left; nothing recurses."""
    c = Grammar(rules(text), {"a": Word("A")}).compiled()
    tree = c.parse_full(["A"] * 10_000)
    assert len(tree.leaves()) == 10_000 and len(tree.decisions()) == 10_000 and tree.info == 0
    assert len(tree.flat()) == 20_000 and len(tree.pretty().split("\n")) == 20_000


ENGLISH = "S -> DP VP; DP -> Det NP; DP -> NP; NP -> Adj NP; NP -> N; VP -> V; Det -> the; Adj -> fine; N -> fine; N -> cook; V -> gave"


def test_english():
    c = Grammar(rules(ENGLISH), {w: Word(w) for w in "the fine cook gave".split()}).compiled()
    tree = next(t for t, end in c.derivations("the fine cook gave".split()) if end == 4)
    assert tree.decisions() == [6, 5, 0, 3, 1, 4] and c.to_source(tree).decisions() == [0, 1, 6, 3, 7, 4, 9, 5, 10]


#: A larger English grammar, with the parts of speech of a few words.
PHRASES = "S -> DP VP; DP -> Det NP; DP -> NP; NP -> Adj NP; NP -> N; VP -> AVP DP; VP -> AVP DP DP; VP -> AVP; AVP -> Adv V; AVP -> V"
SPEECH = {"john": "N", "car": "N", "cook": "N V", "the": "Det", "is": "V", "run": "V", "lazy": "Adj", "fine": "N Adj", "a": "Det", "gave": "V", "thankfully": "Adv", "hesitantly": "Adv", "cold": "Adj N", "sandwich": "N"}


def test_more_english():
    own = rules(PHRASES) + [Rule(part, (word,)) for word, parts in SPEECH.items() for part in parts.split()]
    c = Grammar(own, {w: Word(w) for w in SPEECH}).compiled()
    asked = "the fine cook hesitantly gave lazy john a cold sandwich".split()
    tree = c.parse_full(asked)
    assert [x.value for x in tree.leaves()] == asked and [x.symbol for x in tree.kids] == ["DP", "VP"]
    assert c.parse_full("fine the gave".split()) is None


#: Whether actors, in a list with commas, are in a film.
ACTORS = """S -> IS actor_set IN film; S -> WILL actor_set BE IN film; actor_set -> actor; actor_set -> actor_or; actor_set -> actor_and
actor_and -> AND , actor; actor_and -> AND actor; actor_and -> actor , actor_and; actor_and -> actor actor_and
actor_or -> OR , actor; actor_or -> OR actor; actor_or -> actor , actor_or; actor_or -> actor actor_or"""


def test_actors():
    own = rules(ACTORS.replace("\n", ";"))
    sets = {"actor": Inclusion(frozenset({"WILLSMITH", "TOMJONES"}), 2), "film": Inclusion(frozenset({"INDEPENDENCEDAY"}), 2)}
    c = Grammar(own, {**{w: Word(w) for w in ("IS", "IN", "WILL", "BE", "AND", "OR", ",")}, **sets}).compiled()
    found = [t for t, end in c.parse_all("IS WILL SMITH OR TOM JONES IN INDEPENDENCE DAY".split()) if end == 9]
    assert len(found) == 1 and [x.value for x in found[0].find("actor")] == [("WILL", "SMITH"), ("TOM", "JONES")] and found[0].find("actor_or")
    (one,) = [t for t, end in c.parse_all("IS WILL SMITH IN INDEPENDENCE DAY".split()) if end == 6]
    assert [x.value for x in one.leaves()][1::2] == [("WILL", "SMITH"), ("INDEPENDENCE", "DAY")]


def test_buffalo_has_exactly_two_readings():
    text = "S -> NP VP; RC -> NP V; NP -> PN N; NP -> NP RC; VP -> V NP; N -> n; V -> v; PN -> pn"
    c = Grammar(rules(text), {x: Word("BUFFALO") for x in ("n", "v", "pn")}).compiled()
    assert len({tuple(t.decisions()) for t, end in c.parse_all(["BUFFALO"] * 8) if end == 8}) == 2

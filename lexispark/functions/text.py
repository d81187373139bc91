"""Text as Column expressions: standard forms, tokens, padded n-grams, edit candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRE, POST = "\u0002", "\u0003"
#: Fixed value: what edits insert and replace with, unless the model's own alphabet is given.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def standardise(name: Column) -> Column:
    """The letters A-Z and digits of the upper-cased name."""
    return F.regexp_replace(F.upper(F.replace(name, F.lit("ß"), F.lit("ẞ"))), "[^A-Z0-9]", "")


def standardise_lower(name: Column) -> Column:
    return F.lower(F.trim(name))


def aliases(name: Column) -> Column:
    """The whole name, and its first and last part if it has two at least, in this order."""
    parts = F.filter(F.split(name, r"\s+"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array(name, F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(F.array(name))


def tokens(question: Column) -> Column:
    """Upper-case words and commas."""
    return F.regexp_extract_all(F.upper(F.replace(F.trim(question), F.lit("ß"), F.lit("ẞ"))), F.lit(r"\w+|,"), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.trim(text)), F.lit(r"\w+"), F.lit(0))


#: By the names that configurations use.
TOKENIZERS = {"SimpleTokenizer": tokens, "WordTokenizer": words}


def tokenizer(name: str):
    """The function that makes tokens of a text column."""
    if name not in TOKENIZERS:
        raise KeyError(f"no tokenizer {name!r}; there are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]


def ngrams(text: Column, n: int) -> Column:
    """All windows of n over the text with n - 1 marks before and after it: length + n - 1 of them."""
    padded = F.concat(F.lit(PRE * (n - 1)), text, F.lit(POST * (n - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(text) + n - 1), lambda i: F.substring(padded, i, F.lit(n))) if n > 1 else F.filter(F.split(text, ""), lambda c: c != "")


def edits1(word: Column, alphabet: str = ALPHABET) -> Column:
    """The distinct words one deletion, transposition, replacement or insertion away."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    n = F.length(word)
    left = lambda i: F.substring(word, F.lit(1), i)
    right = lambda i: F.substring(word, i + 1, n)
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    deletes = F.transform(places, lambda i: F.concat(left(i), right(i + 1)))
    swaps = F.transform(F.filter(places, lambda i: i < n - 1), lambda i: F.concat(left(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(deletes, swaps, replaces, inserts))


def gram_probability(count: Column, total: Column) -> Column:
    """Of a gram with this count in a model of so many grams; unseen grams have count 0."""
    return (F.coalesce(count, F.lit(0)) + 1) / (total + 2)


def info(p: Column) -> Column:
    return -F.log(p)


def lang_matches(lang: Column, wanted: str) -> Column:
    return (F.lower(lang) == wanted.lower()) | F.lower(lang).startswith(wanted.lower() + "-")


def minimise(uri: Column, prefixes: dict[str, str]) -> Column:
    """The shortest prefixed form of a URI, or the URI in angle brackets."""
    forms = [F.when(uri.startswith(full), F.concat(F.lit(short), F.substring(uri, F.lit(len(full) + 1), F.length(uri)))) for short, full in prefixes.items()]
    found = F.filter(F.array(*forms), lambda x: x.isNotNull())
    best = F.array_min(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.coalesce(best, F.concat(F.lit("<"), uri, F.lit(">")))


def maximise(name: Column, prefixes: dict[str, str]) -> Column:
    """The URI of a prefixed name; unknown prefixes raise an error."""
    out = None
    for short, full in prefixes.items():
        value = F.concat(F.lit(full), F.substring(name, F.lit(len(short) + 1), F.length(name)))
        out = F.when(name.startswith(short), value) if out is None else out.when(name.startswith(short), value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no namespace for "), name)).cast("string"))


# terminals at a cursor: the number of characters or words that match at a place, null if none do


def match_string(text: Column, at: int, wanted: str) -> Column:
    return F.when(F.substring(text, at + 1, len(wanted)) == wanted, F.lit(len(wanted)))


def match_word(words_col: Column, at: int, wanted: str) -> Column:
    return F.when(F.get(words_col, F.lit(at)) == wanted, F.lit(1))


def match_regex(text: Column, at: int, pattern: str, group: int = 0) -> Column:
    """The group's text if the pattern matches at the place; null if not."""
    rest = F.substring(text, F.lit(at + 1), F.length(text))
    return F.when(rest.rlike(f"^(?:{pattern})"), F.regexp_extract(rest, f"^(?:{pattern})", group))


def match_keyword(text: Column, at: int, keyword: str, case_sensitive: bool = False) -> Column:
    run = F.regexp_extract(F.substring(text, F.lit(at + 1), F.length(text)), r"^\w+", 0)
    same = run == keyword if case_sensitive else F.lower(run) == keyword.lower()
    return F.when(same, run)

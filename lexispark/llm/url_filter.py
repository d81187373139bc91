"""URL filtering: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks: each listed URL sets BITS bits in one block of eight 64-bit words, and blocks are
combined with bit_or in an ordinary aggregation. A page's URL probes one block by an equi-join; whether that table is
broadcast is left to Spark, which checks its size, and a filter beyond that is shuffled by block. Possible hits go on to an exact
hash join with the listed URLs, so false positives of the filter change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import checkpointed

WORDS, BITS, URLS_PER_BLOCK = 8, 6, 32

#: Host, path, verdict of each rule.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for URLs of one page: no scheme, user, default port, leading www. or m., fragment, tracking parameters, index file or last slash; empty for null or without ://."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^.*@|:(80|443)$", ""), r"^(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", "/"), r"/+$", "")
    asked = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda q: (q != "") & ~q.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(h, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))).otherwise(F.lit(""))


def rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule's name and verdict that fits a host and path: the longest wins, the first of equals; null if none does."""
    named = name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name = F.when(fits, F.lit(h + p)) if named is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if named is None else verdict.when(fits, F.lit(v))
        named = True
    return name, verdict


def _probe(url: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """The block of a URL, and the bits it has in each of the block's words."""
    h, g = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    # BITS numbers of 9 bits: 3 choose the word, 6 the bit
    picks = [F.shiftrightunsigned(g, 9 * i).bitwiseAND(F.lit(511)) for i in range(BITS)]
    words = []
    for w in range(WORDS):
        bits = None
        for p in picks:
            one = F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
            bits = one if bits is None else bits.bitwiseOR(one)
        words.append(bits)
    return F.pmod(h, blocks), words


def bloom(listed: DataFrame, url_col: str = "url") -> tuple[DataFrame, int]:
    """The filter's blocks (block, w0 to w7) for a column of canonical URLs, and how many blocks it is divided in; their number follows the URLs'."""
    n = max(1, -(-listed.count() // URLS_PER_BLOCK))
    block, words = _probe(F.col(url_col), F.lit(n))
    return listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, listed.

    listed: a column of canonical URLs to block, in any number, repeats and nulls without effect. The verdict is the longest rule's that fits, else
    block for a listed URL, else allow. A null URL, or one without ://, has an empty host and path, no rule, isn't listed and is allowed. Rows
    that repeat an id or a URL stay. Other columns are left out.
    """
    own = listed.select(F.col(listed.columns[0]).alias("_listed")).where("_listed is not null and _listed <> ''").distinct()
    blocks, n = bloom(own, "_listed")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_verdict", verdict)
    # each URL once: a URL that a third of all pages share is probed and joined as one row
    urls = rows.where("_url <> ''").select("_url").distinct()
    block, words = _probe(F.col("_url"), F.lit(n))
    masks = urls.select("_url", block.alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)])
    passed = None
    for i in range(WORDS):
        holds = F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
        passed = holds if passed is None else passed & holds
    maybe = masks.join(blocks, "block").where(passed).select("_url")
    # checkpointed, so that the join that follows reads two plain exchanges, which adaptive execution can split at a frequent URL; pages without one stay where they are
    hits = checkpointed(maybe.join(own.hint("shuffle_hash"), F.col("_url") == F.col("_listed")).select(F.col("_url").alias("_hit")))
    named = rows.where("_url <> ''").join(hits, F.col("_url") == F.col("_hit"), "left").withColumn("listed", F.col("_hit").isNotNull()).drop("_hit")
    both = named.unionByName(rows.where("_url is null or _url = ''").withColumn("listed", F.lit(False)))
    return both.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")

"""The queries of the core operators, by name, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.demo import books
from lexispark.functions import text as X
from lexispark.operators import filters, graph, membership, models, similarity
from lexispark.plans import generator, questions
from lexispark.plans.sparql import Bind, Filter, Lit, Modifiers, Pattern, Query, Ref, Triple, Union, Var, call
from lexispark.session import table, work_folder
from lexispark.sources import rdf

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s): the distinct standardised part names."""
    return table(spark, sf_dir, "part").select(X.standardise(F.col("p_name")).alias("s")).distinct()


_N = "n as (select distinct regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s from part)"
_ALL = "n as (select regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s from part)"


def _g(n: int, source: str = "n", item: str = "s") -> str:
    pre, post = "||".join(["chr(2)"] * (n - 1)), "||".join(["chr(3)"] * (n - 1))
    return f"(select {item}, unnest([substring({pre}||{item}||{post}, i::int, {n}) for i in range(1, length({item})+{n})]) as gram from {source})"


# --- scalar text


@query("select p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as stand from part")
def q_standardize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.standardise(F.col("p_name")).alias("stand"))


@query("select doc_id, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as stand from documents")
def q_standardize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.standardise(F.col("text")).alias("stand"))


@query("select c_custkey, lower(trim(c_name)) as stand from customer")
def q_standardize_lower(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.standardise_lower(F.col("c_name")).alias("stand"))


@query("""with p as (select p_partkey, p_name, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '') as w from part),
a as (select p_partkey, case when len(w) >= 2 then [p_name, w[1], w[-1]] else [p_name] end as l from p)
select p_partkey, cast(generate_subscripts(l, 1) - 1 as integer) as ord, unnest(l) as alias, regexp_replace(upper(unnest(l)), '[^A-Z0-9]', '', 'g') as stand from a""")
def q_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(X.aliases(F.col("p_name"))).alias("ord", "alias"))
    return rows.withColumn("stand", X.standardise(F.col("alias")))


@query("select doc_id, array_to_string(regexp_extract_all(upper(trim(text)), '\\w+|,'), ' ') as tokens, cast(len(regexp_extract_all(upper(trim(text)), '\\w+|,')) as integer) as n from documents")
def q_tokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query("select conv_id, turn, array_to_string(regexp_extract_all(lower(trim(text)), '\\w+'), ' ') as tokens from conversations")
def q_tokenize_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.words(F.col("text")), " ").alias("tokens"))


@query(f"with {_N} select s, gram, count(*) as cnt from {_g(3)} group by all")
def q_ngrams(spark, sf_dir):
    return similarity.grams(_names(spark, sf_dir), "s", 3)


@query(f"with {_ALL}, m as (select gram, count(*) as cnt from {_g(3)} group by 1) select gram, cnt, cast(sum(cnt) over () as bigint) as size from m")
def q_ngram_model(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(X.standardise(F.col("p_name")).alias("s"))
    model = similarity.gram_model(part, "s", 3)
    return model.join(F.broadcast(model.agg(F.sum("cnt").alias("size"))))  # one row


@query(f"with {_ALL}, m as (select gram, count(*) as cnt from {_g(3)} group by 1), t as (select sum(cnt) as n from m) select gram, round((cnt + 1) / (n + 2), 9) as p, round(-ln((cnt + 1) / (n + 2)), 6) as info from m, t")
def q_gram_info(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(X.standardise(F.col("p_name")).alias("s"))
    model = similarity.gram_model(part, "s", 3)
    p = X.gram_probability(F.col("cnt"), F.col("n"))
    return model.join(F.broadcast(model.agg(F.sum("cnt").alias("n")))).select("gram", F.round(p, 9).alias("p"), F.round(X.info(p), 6).alias("info"))  # one row


@query(f"with {_ALL} select ch, count(*) as cnt from (select unnest(string_split(s, '')) as ch from n) where ch <> '' group by 1")
def q_alphabet(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(X.standardise(F.col("p_name")).alias("s"))
    return similarity.gram_model(part, "s", 1).select(F.col("gram").alias("ch"), "cnt")


# --- similarity

_PAIRS = f"""g as (select s, gram, count(*) as c from {_g(3)} group by all),
p as (select a.s as a, b.s as b, sum(least(a.c, b.c)) as i from g a join g b on a.gram = b.gram and a.s < b.s group by 1, 2)"""


@query(f"with {_N}, {_PAIRS} select a, b, round(1 - i / (length(a) + length(b) + 4 - i), 6) as d from p")
def q_jaccard_pairs(spark, sf_dir):
    return similarity.jaccard_pairs(_names(spark, sf_dir), "s").withColumn("d", F.round("d", 6))


@query(f"""with {_N}, {_PAIRS}, m as (select gram, count(*) as cnt from {_g(3)} group by 1), t as (select sum(cnt) as n from m),
w as (select s, gram, c, -ln((cnt + 1) / (n + 2)) as w from g join m using (gram), t),
u as (select p.a, p.b, gram, sum(case when w.s = p.a then c else 0 end) as x, sum(case when w.s = p.b then c else 0 end) as y, any_value(w) as w from p join w on w.s = p.a or w.s = p.b group by 1, 2, 3)
select a, b, round(1 - sum(least(x, y) * w) / sum(greatest(x, y) * w), 6) as d from u group by 1, 2""")
def q_info_jaccard(spark, sf_dir):
    names = _names(spark, sf_dir)
    pairs = similarity.jaccard_pairs(names, "s").select("a", "b")
    return similarity.info_jaccard(pairs, similarity.gram_model(names, "s", 3)).withColumn("d", F.round("d", 6))


@query(f"with {_N}, {_PAIRS} select a, b, cast(levenshtein(a, b) as bigint) as d from p")
def q_levenshtein(spark, sf_dir):
    return similarity.jaccard_pairs(_names(spark, sf_dir), "s").select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


#: Misspelt names to resolve, for the queries on entities: over every alias of every part, with each name less its second character too.
ASKED = ("antique blu", "smal bottle", "largee ring", "red gear", "green widgt", "steel bolt", "polishd pipe", "blue", "zzqx")
_ASKED = ", ".join(f"('{q}')" for q in ASKED)


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in ASKED], "asked string").select("asked", X.standardise(F.col("asked")).alias("q"))


_TOPK = f"""e as (select distinct regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') as s, uri from (select p_partkey as uri, unnest(case when len(w) >= 2 then [p_name, w[1], w[-1]] else [p_name] end) as a
      from (select p_partkey, p_name, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '') as w from part))),
u as (select a as asked, regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') as q from (select a from (values {_ASKED}) t(a) union select substring(p_name, 1, 1) || substring(p_name, 3) from part)),
v as (select distinct q from u), es as (select distinct s from e),
eg as (select s, gram, count(*) as y from {_g(3, "es")} group by all), qg as (select q, gram, count(*) as x from {_g(3, "v", "q")} group by all),
i as (select q, s, sum(least(x, y)) as i from qg join eg using (gram) group by 1, 2),
r as (select q, s, uri, 1 - i / (length(q) + length(s) + 4 - i) as d, row_number() over (partition by q order by 1 - i / (length(q) + length(s) + 4 - i), uri, s) as rank from i join e using (s)),
k as (select * from r where rank <= 5)"""


def _asked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    misspelt = table(spark, sf_dir, "part").select(F.concat(F.substring(name, 1, 1), F.substring(name, F.lit(3), F.length(name))).alias("asked"))
    return _asked(spark).select("asked").union(misspelt).distinct().select("asked", X.standardise(F.col("asked")).alias("q"))


def _aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uri"), F.explode(X.aliases(F.col("p_name"))).alias("alias"))
    return aliases.select(X.standardise(F.col("alias")).alias("s"), "uri").distinct()


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.identify(_asked_rows(spark, sf_dir).select("q").distinct(), "q", _aliased(spark, sf_dir), "s", "uri")


@query(f"with {_TOPK} select q, uri, s, round(d, 6) as d, cast(rank as integer) as rank from k")
def q_ident_topk(spark, sf_dir):
    return _identified(spark, sf_dir).withColumn("d", F.round("d", 6))


@query(f"with {_TOPK}, b as (select *, min(d) over (partition by q) as best from k), t as (select *, case when d + best = 0 then 0 else 2 * (d - best) / (d + best) end as gap from b) select q, uri, s, round(d, 6) as d, round(gap, 6) as gap from t where gap < 0.1")
def q_ident_ambiguous(spark, sf_dir):
    return similarity.near_ties(_identified(spark, sf_dir), "q").select("q", "uri", "s", F.round("d", 6).alias("d"), F.round("gap", 6).alias("gap"))


@query(f"with {_TOPK} select asked, uri, s from u join k using (q) where rank = 1")
def q_resolve_nodes(spark, sf_dir):
    return _asked_rows(spark, sf_dir).join(_identified(spark, sf_dir).where("rank = 1"), "q").select("asked", "uri", "s")


# --- edits and sets

_EDITS = """list_distinct([left(s, i::int) || substring(s, i::int + 2) for i in range(0, length(s))]
 || [left(s, i::int) || substring(s, i::int + 2, 1) || substring(s, i::int + 1, 1) || substring(s, i::int + 3) for i in range(0, length(s) - 1)]
 || flatten([[left(s, i::int) || c || substring(s, i::int + 2) for c in cs] for i in range(0, length(s))])
 || flatten([[left(s, i::int) || c || substring(s, i::int + 1) for c in cs] for i in range(0, length(s) + 1)]))"""


_ALPHABET = "z as (select list(distinct c) as cs from (select unnest(string_split(s, '')) as c from n) where c <> '')"


def _alphabet(words: DataFrame, item: str) -> str:
    """The characters of the words; there are as many at most as the character set has."""
    return "".join(sorted(r["gram"] for r in similarity.gram_model(words, item, 1).select("gram").collect()))


@query(f"with {_N}, {_ALPHABET} select s, unnest({_EDITS}) as edit from n, z")
def q_edits1(spark, sf_dir):
    """Over the alphabet of the names."""
    names = _names(spark, sf_dir)
    return names.select("s", F.explode(X.edits1(F.col("s"), _alphabet(names, "s"))).alias("edit"))


@query(f"with n as (select distinct upper(p_brand) as s from part), {_ALPHABET}, a as (select s as word, unnest({_EDITS}) as s from n, z) select distinct word, unnest({_EDITS}) as edit from a, z")
def q_edits2(spark, sf_dir):
    """Of the brands, over their alphabet."""
    words = table(spark, sf_dir, "part").select(F.upper("p_brand").alias("word")).distinct()
    letters = _alphabet(words, "word")
    one = words.select("word", F.explode(X.edits1(F.col("word"), letters)).alias("s"))
    return one.select("word", F.explode(X.edits1(F.col("s"), letters)).alias("edit")).distinct()


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"with {_N}, v as (select distinct regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') as q from (values {_ASKED}) t(a)) select q, exists(select 1 from n where levenshtein(n.s, v.q) <= 1) as found from v")
def q_fuzzy_member(spark, sf_dir):
    """Edit distance of at most 1 is what deletions, replacements and insertions over the members' alphabet reach; transpositions are left to tests."""
    return membership.within_edits(_asked(spark).select("q").distinct(), "q", _names(spark, sf_dir), "s", 1, _LETTERS)


@query("with w as (select distinct p_name as name from part), a as (select distinct p_name from part where p_size < 10), b as (select distinct p_name from part where p_type like '%ECO%') select name, name in (from a) as small, name in (from b) as eco, name in (from a) or name in (from b) as in_any from w")
def q_or_set(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return membership.flags(part.select(F.col("p_name").alias("name")).distinct(), "name", {"small": (part.where("p_size < 10"), "p_name"), "eco": (part.where(F.col("p_type").contains("ECO")), "p_name")})


@query("select distinct p_name as name from part where p_size < 25 and p_name not in (select p_name from part where p_retailprice < 950)")
def q_semi_anti(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_size < 25").select(F.col("p_name").alias("name")).distinct().join(part.where("p_retailprice < 950").select(F.col("p_name").alias("name")), "name", "left_anti")


# --- models

_RATED = f"""{_ALL}, m as (select gram, count(*) as cnt from {_g(3)} group by 1), z as (select sum(cnt) as size from m),
o as (select distinct s from n), og as {_g(3, "o")}, r as (select s, (sum(coalesce(cnt, 0)) + 1) / (length(s) + 5) / any_value(size) as rating from og left join m using (gram), z group by s)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(X.standardise(F.col("p_name")).alias("s"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return models.rate(parts, "s", similarity.gram_model(parts, "s", 3), 3)


@query(f"with {_RATED} select s, round(rating, 9) as rating from r")
def q_ngram_rate(spark, sf_dir):
    return _rated(spark, sf_dir).withColumn("rating", F.round("rating", 9))


@query(f"with {_RATED} select round(stddev_pop(rating), 9) as deviation, count(*) as n from n join r using (s)")
def q_rating_stddev(spark, sf_dir):
    return models.train_filter(_parts(spark, sf_dir), "s", 3)[1].select(F.round("deviation", 9).alias("deviation"), "n")


@query(f"with {_RATED}, b as (select min(rating) as lo, max(rating) as hi from r) select cast(least(floor((rating - lo) / (hi - lo) * 20), 19) as bigint) as bucket, count(*) as n from r, b group by 1")
def q_rating_histogram(spark, sf_dir):
    rated = _rated(spark, sf_dir)
    ends = rated.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    bucket = F.least(F.floor((F.col("rating") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("long")
    return rated.join(F.broadcast(ends)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # one row


_BOUND = f"{_RATED}, k as (select rating, row_number() over (order by rating, s) as k, count(*) over () as c from n join r using (s)), b as (select min(rating) as bound from k where k = cast(floor(0.01 * c) as bigint) + 1)"


@query(f"with {_BOUND} select s, rating >= bound as member from r, b")
def q_ngpol_filter(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    model, bounds = models.train_filter(parts, "s", 3, 0.01)
    return models.rate(parts, "s", model, 3).join(F.broadcast(bounds)).select("s", (F.col("rating") >= F.col("min_rating")).alias("member"))  # one row


@query(f"with {_BOUND} select round(bound * 0.9, 9) as min_rating from b")
def q_ngpol_allowance(spark, sf_dir):
    return models.allow(models.train_filter(_parts(spark, sf_dir), "s", 3, 0.01)[1], 0.1).select(F.round("min_rating", 9).alias("min_rating"))


@query(f"with {_RATED}, b as (select quantile_disc(rating, 0.5) as bound from r) select s, cast(case when rating >= bound then 0 else ceil(ln(rating / bound) / ln(0.95) - 1e-12) end as bigint) as steps from r, b")
def q_stretch(spark, sf_dir):
    rated = _rated(spark, sf_dir)
    bound = rated.agg(F.expr("percentile_disc(0.5) within group (order by rating)").alias("bound"))
    return rated.join(F.broadcast(bound)).select("s", models.steps_to_include("rating", "bound", 0.05).alias("steps"))  # one row


_LENGTHS = f"{_ALL}, l as (select s, cast(length(s) as double) as v from n), d as (select distinct v from l), gp as (select v - lag(v) over (order by v) as gap from d), mt as (select min(v) as lo, max(v) as hi, (select min(gap) from gp) as gr from l), bk as (select cast(least(floor((v - lo) / gr), floor((hi - lo) / gr) - 1) as bigint) as bucket, count(*) as c from l, mt group by 1), ds as (select bucket, sum(c) over (order by bucket) / sum(c) over () as cum from bk)"


@query(f"with {_LENGTHS} select bucket, round(cum, 6) as cum, lo as min_val, hi as max_val, cast(floor((hi - lo) / gr) as bigint) as buckets from ds, mt")
def q_length_dist(spark, sf_dir):
    lengths = _parts(spark, sf_dir).select(F.length("s").alias("v"))
    return models.distribution(lengths, "v").select("bucket", F.round("cum", 6).alias("cum"), "min_val", "max_val", "buckets")


@query("""with l as (select cast(n_chars as double) as v from documents), d as (select distinct v from l), gp as (select v - lag(v) over (order by v) as gap from d), mt as (select min(v) as lo, max(v) as hi, (select min(gap) from gp) as g from l),
m2 as (select *, case when floor((hi - lo) / g) > 5000 then 5000 else floor((hi - lo) / g) end as nb, case when floor((hi - lo) / g) > 5000 then (hi - lo) / 5000 else g end as gr from mt),
bk as (select cast(least(floor((v - lo) / gr), nb - 1) as bigint) as bucket, count(*) as c from l, m2 group by 1) select bucket, round(sum(c) over (order by bucket) / sum(c) over (), 6) as cum from bk""")
def q_document_length_dist(spark, sf_dir):
    return models.distribution(table(spark, sf_dir, "documents"), "n_chars").select("bucket", F.round("cum", 6).alias("cum"))


_RDIST = "rs as (select n.s, rating as v from n join r using (s)), d as (select distinct v from rs), gp as (select v - lag(v) over (order by v) as gap from d), mt as (select min(v) as lo, max(v) as hi, (select min(gap) from gp) as g from rs), m2 as (select *, case when floor((hi - lo) / g) > 5000 then 5000 else floor((hi - lo) / g) end as nb, case when floor((hi - lo) / g) > 5000 then (hi - lo) / 5000 else g end as gr from mt), bk as (select cast(least(floor((v - lo) / gr), nb - 1) as bigint) as bucket, count(*) as c from rs, m2 group by 1), ds as (select bucket, sum(c) over (order by bucket) / sum(c) over () as cum from bk)"


def _rating_dist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rated = _rated(spark, sf_dir)
    return rated, models.distribution(_parts(spark, sf_dir).join(rated, "s"), "rating")


@query(f"""with {_RATED}, {_RDIST}, x as (select s, rating, (rating - lo) / gr as b, floor((rating - lo) / gr) as l, lo, hi, nb from r, m2),
y as (select x.*, coalesce((select max(cum) from ds where bucket <= x.l), 0) as c0, coalesce((select max(cum) from ds where bucket <= x.l + 1), 0) as c1 from x)
select s, round(case when rating < lo then 0 when rating >= hi or l >= nb - 1 then 1 else c0 + (c1 - c0) * (b - l) end, 5) as p from y""")
def q_ngram_dist(spark, sf_dir):
    rated, dist = _rating_dist(spark, sf_dir)
    return models.cdf(rated, "rating", dist, "p").select("s", F.round("p", 5).alias("p"))


@query(f"""with {_LENGTHS}, x as (select distinct s, v, floor((v - lo) / gr) as l, floor((hi - lo) / gr) as nb, lo, hi from l, mt), y as (select x.*, coalesce((select max(cum) from ds where bucket <= x.l), 0) as c0 from x), p as (select s, case when v < lo then 0 when v >= hi or l >= nb - 1 then 1 else c0 end as p from y)
select s, round(p, 6) as p, case when p > 0 then round(0 - ln(p), 6) end as info from p""")
def q_info_content(spark, sf_dir):
    names = _names(spark, sf_dir).withColumn("v", F.length("s"))
    p = models.cdf(names, "v", models.distribution(_parts(spark, sf_dir).select(F.length("s").alias("v")), "v"), "p", whole=True)
    return p.select("s", F.round("p", 6).alias("p"), F.when(F.col("p") > 0, F.round(X.info(F.col("p")), 6)).alias("info"))


@query(f"""with {_LENGTHS}, x as (select distinct s, v, floor((v - lo) / gr) as l, floor((hi - lo) / gr) as nb, lo, hi from l, mt), y as (select x.*, coalesce((select max(cum) from ds where bucket <= x.l), 0) as c0 from x), p as (select s, v, case when v < lo then 0 when v >= hi or l >= nb - 1 then 1 else c0 end as p from y)
select s, round(case when p <= 0 then 0 else power(p, 0.5) * power(v / 100, 2) end, 6) as p, p > 0 as member from p""")
def q_joined_prob(spark, sf_dir):
    names = _names(spark, sf_dir).withColumn("v", F.length("s"))
    p = models.cdf(names, "v", models.distribution(_parts(spark, sf_dir).select(F.length("s").alias("v")), "v"), "p1", whole=True).withColumn("p2", F.col("v") / 100)
    both = models.joined_probability([("p1", 0.5), ("p2", 2.0)])
    return p.select("s", F.round(both, 6).alias("p"), (both > 0).alias("member"))


_BRANDS = f"""{_ALL}, c as (select distinct p_brand as cl, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s, p_partkey from part), cg as {_g(3, "(select cl, s, p_partkey from c)", "cl, s").replace("length(cl, s)", "length(s)").replace("chr(2)||chr(2)||cl, s||", "chr(2)||chr(2)||s||")}, cm as (select cl, gram, count(*) as cnt from cg group by 1, 2), cz as (select cl, sum(cnt) as size from cm group by 1), o as (select distinct s from n), og as {_g(3, "o")},
cr as (select s, cl, (sum(cnt) + 1) / (length(s) + 5) / any_value(size) as rating from og join cm using (gram) join cz using (cl) group by s, cl)"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cl"), X.standardise(F.col("p_name")).alias("s"))
    return members, models.rate_by_cluster(_parts(spark, sf_dir), "s", members, "cl", 3)


@query(f"with {_BRANDS}, k as (select *, row_number() over (partition by s order by round(rating, 12) desc, cl) as k from cr) select s, cl, round(rating, 9) as rating from k where k = 1")
def q_cluster_best(spark, sf_dir):
    rated = _clusters(spark, sf_dir)[1].withColumn("rating", F.round("rating", 12))
    return models.best_cluster(rated, "s", "cl").withColumn("rating", F.round("rating", 9))


@query(f"with {_BRANDS}, own as (select c.cl, min(rating) as bound from c join cr using (s, cl) group by 1) select s, bool_or(rating >= bound) as member, cast(count(*) filter (rating >= bound) as bigint) as n from cr join own using (cl) group by 1")
def q_cluster_filter(spark, sf_dir):
    members, rated = _clusters(spark, sf_dir)
    bounds = members.distinct().join(rated, ["s", "cl"]).groupBy("cl").agg(F.min("rating").alias("bound"))
    hit = F.col("rating") >= F.col("bound")
    return rated.join(bounds, "cl").groupBy("s").agg(F.bool_or(hit).alias("member"), F.count_if(hit).alias("n"))


@query(f"with recursive {_N}, {_PAIRS}, e as (select a, b from p where 1 - i / (length(a) + length(b) + 4 - i) <= 0.5 union all select b, a from p where 1 - i / (length(a) + length(b) + 4 - i) <= 0.5), w as (select s as node, s as other from n union select w.node, e.b from w join e on w.other = e.a) select node, min(other) as label from w group by 1")
def q_clusters(spark, sf_dir):
    names = _names(spark, sf_dir)
    return graph.components(similarity.similar_pairs(names, "s", 0.5), names.withColumnRenamed("s", "node"))


@query(f"with {_N}, {_PAIRS}, d as (select a, b, 1 - i / (length(a) + length(b) + 4 - i) as d from p) select a, b, round(d, 6) as d from d where d <= 0.7")
def q_similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(_names(spark, sf_dir), "s", 0.7).withColumn("d", F.round("d", 6))


_WORDS = "n as (select distinct unnest(regexp_extract_all(lower(trim(text)), '\\w+')) as s from benchmark)"


@query(f"with {_WORDS}, {_PAIRS}, d as (select a, b, 1 - i / (length(a) + length(b) + 4 - i) as d from p) select a, b, round(d, 6) as d from d where d <= 0.4")
def q_similar_words(spark, sf_dir):
    """Of all words of the benchmark's texts."""
    found = table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"))).alias("s")).distinct()
    return similarity.similar_pairs(found, "s", 0.4).withColumn("d", F.round("d", 6))


_HALVES = f"{_ALL}, h as (select p_partkey % 2 = 0 as old, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s from part)"


@query(f"with {_HALVES}, m as (select gram, count(*) as cnt from {_g(3)} group by 1), z as (select sum(cnt) as size from m), o as (select distinct s from n), og as {_g(3, 'o')}, r as (select s, (sum(coalesce(cnt, 0)) + 1) / (length(s) + 5) / any_value(size) as rating from og left join m using (gram), z group by s), k as (select rating, row_number() over (order by rating, s) as k, count(*) over () as c from h join r using (s) where old) select round(min(rating), 9) as min_rating, (select cast(size as bigint) from z) as size from k where k = cast(floor(0.02 * c) as bigint) + 1")
def q_filter_add(spark, sf_dir):
    """Trained on the parts of even keys, the others added, the bound brought up to date."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2 == 0).alias("old"), X.standardise(F.col("p_name")).alias("s"))
    own = filters.GramFilter.train(part.where("old"), "s", 3, 0.02).add(part.where("not old"), "s").updated()
    return own.bounds.join(F.broadcast(own.model.agg(F.sum("cnt").alias("size")))).select(F.round("min_rating", 9).alias("min_rating"), "size")  # one row each


_SPLIT = "select p_brand as cl, p_size < 25 as old, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s from part"


@query(f"with c as ({_SPLIT}), ct as (select cl, s from c where old), cg as (select cl, unnest([substring(chr(2)||chr(2)||s||chr(3)||chr(3), i::int, 3) for i in range(1, length(s)+3)]) as gram from ct), cm as (select cl, gram, count(*) as cnt from cg group by 1, 2), cz as (select cl, sum(cnt) as size from cm group by 1), o as (select distinct s from c), og as {_g(3, 'o')}, cr as (select s, cl, (sum(cnt) + 1) / (length(s) + 5) / any_value(size) as rating from og join cm using (gram) join cz using (cl) group by s, cl), best as (select s, cl from (select *, row_number() over (partition by s order by rating desc, cl) as k from cr) where k = 1), more as (select best.cl, sum(length(s) + 2) as n from c join best using (s) where not old group by 1), low as (select ct.cl, min(rating) as min_rating, count(*) as n from ct join cr using (s, cl) group by 1) select low.cl as cluster, round(min_rating, 9) as min_rating, low.n, cast(size + coalesce(more.n, 0) as bigint) as grams from low join cz on cz.cl = low.cl left join more on more.cl = low.cl")
def q_cluster_add(spark, sf_dir):
    """Trained on small parts by brand; each larger one is added to the brand that rates its name best, and the bounds stay."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cl"), (F.col("p_size") < 25).alias("old"), X.standardise(F.col("p_name")).alias("s"))
    own = filters.ClusterFilter.train(part.where("old"), "cl", "s", 3).add(part.where("not old").select("s"), "s")
    grams = own.model.groupBy("cluster").agg(F.sum("cnt").alias("grams"))
    return own.bounds.join(grams, "cluster").select("cluster", F.round("min_rating", 9).alias("min_rating"), "n", "grams")


@query("select distinct s from (select regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') as s from customer) order by md5(s), s limit 300")
def q_training_sample(spark, sf_dir):
    return membership.training_sample(table(spark, sf_dir, "customer").select(X.standardise(F.col("c_name")).alias("s")), "s", 300)


@query("select cl, s from (select *, row_number() over (partition by cl order by md5(s), s) as k from (select distinct p_brand as cl, p_name as s from part)) where k <= 4")
def q_cluster_sample(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cl"), F.col("p_name").alias("s")).distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("cl").orderBy(F.md5("s"), "s"))).where("k <= 4").select("cl", "s")


# --- terminals at a cursor, and spans


@query("select conv_id, turn, case when substring(text, 1, 3) = 'The' then 3 else -1 end as n from conversations")
def q_term_string(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(X.match_string(F.col("text"), 0, "The"), F.lit(-1)).alias("n"))


@query("select doc_id, case when list_extract(regexp_extract_all(lower(trim(text)), '\\w+'), 2) = 'the' then 1 else -1 end as n from documents")
def q_term_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.match_word(X.words(F.col("text")), 1, "the"), F.lit(-1)).alias("n"))


@query("select doc_id, case when regexp_matches(text, '^(?:([A-Z][a-z]+) ([a-z]+))') then regexp_extract(text, '^(?:([A-Z][a-z]+) ([a-z]+))', 2) end as word from documents")
def q_term_regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.match_regex(F.col("text"), 0, "([A-Z][a-z]+) ([a-z]+)", 2).alias("word"))


@query("select conv_id, turn, case when lower(regexp_extract(text, '^\\w+', 0)) = 'the' then regexp_extract(text, '^\\w+', 0) end as word from conversations")
def q_term_keyword(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.match_keyword(F.col("text"), 0, "THE").alias("word"))


_SPANS = """t as (select conv_id * 1000 + turn as id, regexp_extract_all(upper(trim(text)), '\\w+|,') as w from conversations),
sp as (select id, st as start, st + k as stop, k as n, array_to_string(w[st + 1 : st + k], '') as span from t, range(0, 100000) a(st), range(1, 4) b(k) where st + k <= len(w))"""
_SPAN_SET = "f as (select w, count(*) as c from (select unnest(regexp_extract_all(upper(trim(text)), '\\w+|,')) as w from documents) where w <> ',' group by 1 having count(*) >= 50)"


def _conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), X.tokens(F.col("text")).alias("t"))
    return membership.spans(rows, "id", "t")


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("w")).where("w <> ','")
    return words.groupBy("w").agg(F.count("*").alias("c")).where("c >= 50")


@query(f"with {_SPANS}, {_SPAN_SET} select id, cast(start as integer) as start, cast(n as integer) as n, span from sp where span in (select w from f)")
def q_span_inclusion(spark, sf_dir):
    return membership.span_members(_conversation_spans(spark, sf_dir), _frequent(spark, sf_dir), "w")


@query(f"with {_SPANS}, {_SPAN_SET}, z as (select sum(c) as z from f), h as (select id, start, n, span, -ln(c / z) as info from sp join f on span = w, z) select id, cast(start as integer) as start, cast(n as integer) as n, span, round(info, 6) as info, cast(row_number() over (partition by id, start order by round(info, 9), n) as integer) as rank from h")
def q_span_prob(spark, sf_dir):
    from pyspark.sql import Window

    f = _frequent(spark, sf_dir)
    p = f.join(F.broadcast(f.agg(F.sum("c").alias("z")))).select(F.col("w").alias("span"), X.info(F.col("c") / F.col("z")).alias("info"))  # one row
    # the planner takes the spans for as small as the file of the texts they come from, and would broadcast all of them
    hit = _conversation_spans(spark, sf_dir).join(p.hint("merge"), "span")
    best = Window.partitionBy("id", "start").orderBy(F.round("info", 9), "n")
    return hit.select("id", "start", "n", "span", F.round("info", 6).alias("info"), F.row_number().over(best).alias("rank"))


#: Questions over the part and supplier tables, for the queries on parsing and on entities.
QUESTIONS = (
    (1, "What parts has Supplier#000000001 supplied?"),
    (2, "What ECONOMY parts has Supplier#000000002 supplied?"),
    (3, "What ECONOMY and PROMO parts has Supplier#000000003 supplied?"),
    (4, "Who supplied blue bolt?"),
    (5, "Which suppliers have supplied both ECONOMY and PROMO parts?"),
    (6, "What parts has Supplier#000000004 supplied that are the same type as blue bolt?"),
    (7, "How heavy is the moon?"),
)
_QUESTIONS = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)


@query(f"with q as (select * from (values {_QUESTIONS}) v(id, q)), t as (select id, regexp_extract_all(upper(trim(q)), '\\w+|,') as w from q), sp as (select id, st as start, k as n, array_to_string(w[st + 1 : st + k], '') as span from t, range(0, 100) a(st), range(1, 4) b(k) where st + k <= len(w)), e as (select distinct regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as s from part) select id, cast(start as integer) as start, cast(n as integer) as n, span from sp where span in (select s from e)")
def q_span_entity(spark, sf_dir):
    rows = spark.createDataFrame(list(QUESTIONS), "id int, q string").select("id", X.tokens(F.col("q")).alias("t"))
    return membership.span_members(membership.spans(rows, "id", "t"), _names(spark, sf_dir), "s")


#: A small lexicon of our own: hyponyms (parent, child) and lemmas (synset, lemma).
HYPONYMS = (("dog", "terrier"), ("dog", "great dane"), ("dog", "puppy"), ("animal", "dog"), ("animal", "cat"), ("bark", "yip"), ("sound", "bark"), ("sound", "meow"))
LEMMAS = tuple((s, s.upper()) for s in ("dog", "terrier", "great dane", "puppy", "cat", "bark", "yip", "meow")) + (("dog", "HOUND"), ("great dane", "DANE"))
_HYPO = ", ".join(f"('{a}', '{b}')" for a, b in HYPONYMS)
_LEMMA = ", ".join(f"('{a}', '{b}')" for a, b in LEMMAS)


@query(f"with recursive h(parent, child) as (values {_HYPO}), l(synset, lemma) as (values {_LEMMA}), r(v) as (select 'dog' union select child from h join r on parent = v) select distinct lemma from l where synset in (select v from r)")
def q_shtl(spark, sf_dir):
    h = spark.createDataFrame(list(HYPONYMS), "parent string, child string")
    return membership.hyponym_lemmas(h, spark.createDataFrame(list(LEMMAS), "synset string, lemma string"), "dog")


# --- graph patterns over the triples

_V = {v: Var(v) for v in "part name type brand supplier sname nation nname region rname n other customer segment label".split()}
IS, LABEL = Ref(rdf.TYPE), Ref(rdf.LABEL)
_S = "'http://ex/supplier/' || s_suppkey"
_P = "'http://ex/part/' || p_partkey"


def _df(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    return q.to_df(rdf.star_triples(spark, sf_dir))


def _q(*patterns, out: str, **modifiers) -> Query:
    q = Query().namespace("ex:", "ex:").add(*patterns).output(*[Var(v) for v in out.split()])
    q.modifiers = Modifiers(**modifiers)
    return q


@query(f"select {_P} as part, p_name as name, p_type as type, p_brand as brand from part")
def q_bgp_star(spark, sf_dir):
    v = _V
    return _df(spark, sf_dir, _q(Triple(v["part"], IS, Ref("ex:Part")), Triple(v["part"], LABEL, v["name"]), Triple(v["part"], Ref("ex:type"), v["type"]), Triple(v["part"], Ref("ex:brand"), v["brand"]), out="part name type brand"))


@query(f"select {_S} as supplier, n_name as nname, r_name as rname from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_bgp_chain(spark, sf_dir):
    v = _V
    return _df(spark, sf_dir, _q(Triple(v["supplier"], Ref("ex:nation"), v["nation"]), Triple(v["supplier"], IS, Ref("ex:Supplier")), Triple(v["nation"], LABEL, v["nname"]), Triple(v["nation"], Ref("ex:region"), v["region"]), Triple(v["region"], LABEL, v["rname"]), out="supplier nname rname"))


@query(f"select {_P} as part from part where p_type in (select p_type from part where p_partkey = 1)")
def q_same_attribute(spark, sf_dir):
    return _df(spark, sf_dir, _q(Triple(Ref("http://ex/part/1"), Ref("ex:type"), _V["type"]), Triple(_V["part"], Ref("ex:type"), _V["type"]), out="part"))


@query("select distinct 'http://ex/supplier/' || l_suppkey as supplier from lineitem join part on l_partkey = p_partkey where p_type = 'ECONOMY' and l_suppkey in (select l_suppkey from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO')")
def q_and_constraints(spark, sf_dir):
    v = _V
    return _df(spark, sf_dir, _q(Triple(v["part"], Ref("ex:suppliedBy"), v["supplier"]), Triple(v["part"], Ref("ex:type"), Lit("ECONOMY")), Triple(v["other"], Ref("ex:suppliedBy"), v["supplier"]), Triple(v["other"], Ref("ex:type"), Lit("PROMO")), out="supplier", distinct=True))


@query("select doc_id from documents where lower(lang) = 'en' or lower(lang) like 'en-%'")
def q_lang_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    triples = docs.select(F.col("doc_id").cast("string").alias("s"), F.lit("rdfs:label").alias("p"), F.col("source").alias("o"), F.col("lang").alias("o_lang"))
    q = _q(Triple(Var("d"), LABEL, Var("x")), Filter(call("langMatches", call("lang", Var("x")), Lit("EN"))), out="d")
    return q.to_df(triples).select(F.col("d").cast("long").alias("doc_id"))


@query(f"select {_S} as supplier, s_name as sname, n_name as nname from supplier left join (select * from nation where n_nationkey < 12) on s_nationkey = n_nationkey")
def q_sparql_optional(spark, sf_dir):
    v = _V
    few = Pattern().add(Triple(v["supplier"], Ref("ex:nation"), v["nation"])).add(Triple(v["nation"], LABEL, v["nname"])).add(Triple(v["nation"], Ref("ex:region"), v["region"]))
    few.add(Filter(call("||", *[call("=", v["nation"], Ref(f"http://ex/nation/{i}")) for i in range(12)])))
    return _df(spark, sf_dir, _q(Triple(v["supplier"], IS, Ref("ex:Supplier")), Triple(v["supplier"], LABEL, v["sname"]), few, out="supplier sname nname"))


@query(f"select {_S} as n, s_name as label, null::varchar as segment from supplier union all select 'http://ex/customer/' || c_custkey, null, c_mktsegment from customer")
def q_sparql_union(spark, sf_dir):
    v = _V
    a = Pattern().add(Triple(v["n"], IS, Ref("ex:Supplier"))).add(Triple(v["n"], LABEL, v["label"]))
    b = Pattern().add(Triple(v["n"], Ref("ex:segment"), v["segment"]))
    return _df(spark, sf_dir, _q(Union([a, b]), out="n label segment"))


@query(f"select {_P} as part, upper(p_name) || '!' as label from part where length(p_name) > 9")
def q_sparql_bind(spark, sf_dir):
    v = _V
    return _df(spark, sf_dir, _q(Triple(v["part"], IS, Ref("ex:Part")), Triple(v["part"], LABEL, v["name"]), Bind(call("concat", call("ucase", v["name"]), Lit("!")), v["label"]), Filter(call(">", call("strlen", v["name"]), 9)), out="part label"))


@query("select 'http://ex/supplier/' || l_suppkey as supplier, count(*) as n from (select distinct l_suppkey, l_partkey from lineitem) group by 1 having count(*) > 20")
def q_sparql_group_having(spark, sf_dir):
    q = _q(Triple(_V["part"], Ref("ex:suppliedBy"), _V["supplier"]), out="supplier").group(_V["supplier"]).aggregate("COUNT", _V["part"], _V["n"])
    q.having = call(">", _V["n"], 20)
    return _df(spark, sf_dir, q)


@query(f"select {_P} as part, p_name as name from part order by p_name desc, {_P} limit 20 offset 5")
def q_sparql_order_limit(spark, sf_dir):
    return _df(spark, sf_dir, _q(Triple(_V["part"], IS, Ref("ex:Part")), Triple(_V["part"], LABEL, _V["name"]), out="part name", order=[(_V["name"], True)], limit=20, offset=5))


@query("select distinct p_type as type, p_brand as brand from part")
def q_sparql_distinct(spark, sf_dir):
    return _df(spark, sf_dir, _q(Triple(_V["part"], Ref("ex:type"), _V["type"]), Triple(_V["part"], Ref("ex:brand"), _V["brand"]), out="type brand", distinct=True))


PREFIXES = {"ex:": "http://ex/", "exp:": "http://ex/part/"}


@query("select p_partkey, 'exp:' || p_partkey as short from part")
def q_ns_minimize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.minimise(rdf.uri("part", "p_partkey"), PREFIXES).alias("short"))


@query("select p_partkey, 'http://ex/part/' || p_partkey as uri from part")
def q_ns_maximize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.maximise(F.concat(F.lit("exp:"), F.col("p_partkey").cast("string")), PREFIXES).alias("uri"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'literal' as kind from events")
def q_json_bindings(spark, sf_dir):
    """The events as SPARQL results in JSON, read back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    found = rdf.bindings(rdf.result_json(rows), "result", ["event_id", "k"])
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("k").cast("long").alias("k"), F.col("k_type").alias("kind"))


# --- graphs

_EDGE = "e as (select distinct conv_id * 100 + turn as src, conv_id * 100 + turn + 1 as dst from conversations where turn > 0 union select distinct conv_id * 100 + turn + 1, conv_id * 100 + turn from conversations where conv_id % 7 = 0 and turn = 1)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 100 + F.col("turn")
    on = c.where("turn > 0").select(at.alias("src"), (at + 1).alias("dst"))
    back = c.where("conv_id % 7 = 0 and turn = 1").select((at + 1).alias("src"), at.alias("dst"))
    return on.union(back).distinct()


@query(f"with recursive {_EDGE}, r(v) as (select distinct conv_id * 100 + 1 from conversations where conv_id % 3 = 0 union select dst from e join r on src = v) select v from r")
def q_graph_reachable(spark, sf_dir):
    start = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select((F.col("conv_id") * 100 + 1).alias("v")).distinct()
    return graph.reachable(_edges(spark, sf_dir), start)


@query(f"with recursive {_EDGE}, r(v) as (select distinct conv_id * 100 + 1 from conversations where conv_id % 3 = 0 union select dst from e join r on src = v) select v from (select src as v from e union select dst from e) where v not in (select v from r)")
def q_graph_unreachable(spark, sf_dir):
    start = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select((F.col("conv_id") * 100 + 1).alias("v")).distinct()
    return graph.unreachable(_edges(spark, sf_dir), start)


@query(f"with {_EDGE} select distinct src as v from e where src not in (select dst from e)")
def q_graph_roots(spark, sf_dir):
    return graph.roots(_edges(spark, sf_dir))


@query(f"with {_EDGE} select distinct dst as v from e where dst not in (select src from e)")
def q_graph_leaves(spark, sf_dir):
    return graph.leaves(_edges(spark, sf_dir))


@query(f"with recursive {_EDGE}, c(a, b) as (select src, dst from e union select a, dst from c join e on b = src) select distinct a as v from c where a = b")
def q_graph_cyclic(spark, sf_dir):
    return graph.cyclic_vertices(_edges(spark, sf_dir))


@query(f"with recursive {_EDGE}, p(path) as (select ['1401'] union all select list_append(path, cast(dst as varchar)) from p join e on cast(src as varchar) = path[-1] where path[-1] <> '1404' and not list_contains(path, cast(dst as varchar))) select path from p where path[-1] = '1404'")
def q_graph_path(spark, sf_dir):
    """Through a conversation that leads back at its second turn."""
    return graph.paths(_edges(spark, sf_dir), "1401", "1404")


@query(f"with recursive {_EDGE}, c(a, b) as (select src, dst from e union select a, dst from c join e on b = src) select x.a as v, max(greatest(x.b, y.a)) as cycle from c x join c y on x.b = y.a and y.b = x.a group by 1")
def q_graph_cycles(spark, sf_dir):
    return graph.cycles(_edges(spark, sf_dir))


# --- parsing questions, and what they mean


def _parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(QUESTIONS), "id long, text string")
    return questions.parse(questions.scored_spans(asked, questions.entities(spark, sf_dir)))


#: The questions' shapes as a regular expression over tokens; the last question has none.
_SHAPE = "^(WHAT (PARTS|ECONOMY PARTS|ECONOMY AND PROMO PARTS) HAS SUPPLIER [0-9]+ SUPPLIED( THAT ARE THE SAME TYPE AS BLUE BOLT)?|WHO SUPPLIED BLUE BOLT|WHICH SUPPLIERS HAVE SUPPLIED BOTH ECONOMY AND PROMO PARTS)"
_TOKENS = f"t as (select cast(id as bigint) as id, array_to_string(regexp_extract_all(upper(trim(q)), '\\w+|,'), ' ') as w from (values {_QUESTIONS}) v(id, q))"


@query(f"with {_TOKENS} select id, regexp_matches(w, '{_SHAPE}$') as accepted from t")
def q_parse_full(spark, sf_dir):
    asked = spark.createDataFrame(list(QUESTIONS), "id long, text string").select("id")
    whole = _parses(spark, sf_dir).where("consumed = n_tokens").select("id").distinct().withColumn("hit", F.lit(True))
    return asked.join(whole, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("accepted"))


@query(f"with {_TOKENS} select id, regexp_matches(w, '{_SHAPE}') as accepted from t")
def q_parse_partial(spark, sf_dir):
    asked = spark.createDataFrame(list(QUESTIONS), "id long, text string").select("id")
    some = _parses(spark, sf_dir).select("id").distinct().withColumn("hit", F.lit(True))
    return asked.join(some, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("accepted"))


_TYPES = "[A-Z]+( AND [A-Z]+)*"
#: Every reading, from the text alone: with types there is a rule for each AND and one for the first.
_READ = f"""{_TOKENS}, r as (select id, w, regexp_extract(w, '^WHAT ({_TYPES} )?PARTS HAS SUPPLIER [0-9]+ SUPPLIED') as what, regexp_extract(w, '^WHAT ({_TYPES} )PARTS', 1) as kinds, regexp_extract(w, '^WHICH SUPPLIERS HAVE SUPPLIED BOTH ({_TYPES}) PARTS$', 1) as both_ from t),
k as (select *, case when kinds = '' then [5] else [6] || [8 for x in range(len(string_split(kinds, ' AND ')) - 1)] || [7] end as kind from r),
x as (select id, 0 as interp, what as used, [0, 3] || kind as decisions, w from k where what <> '' union all select id, 1, w, [0, 4] || kind, w from k where what <> '' and w = what || ' THAT ARE THE SAME TYPE AS BLUE BOLT'
      union all select id, 0, w, [1], w from k where w = 'WHO SUPPLIED BLUE BOLT' union all select id, 0, w, [2] || [8 for x in range(len(string_split(both_, ' AND ')) - 1)] || [7], w from k where both_ <> ''),
reads as (select id, cast(interp as integer) as interp, cast(len(string_split(used, ' ')) as integer) as consumed, cast(decisions as integer[]) as decisions, 0.0::double as info, used = w as whole from x)"""


@query(f"with {_READ} select id, interp, consumed, decisions, info from reads")
def q_parse_all(spark, sf_dir):
    return _parses(spark, sf_dir).select("id", "interp", "consumed", "decisions", F.round("info", 6).alias("info"))


#: The trees of the questions, worked out by hand: question, then node, parent, depth, symbol, start, end, text.
_TREES = """1 0 -1 0 Question 0 6|1 1 0 1 WHAT 0 1 WHAT|1 2 0 1 PartsOf 1 6|1 3 2 2 Kind 1 2|1 4 3 3 PARTS 1 2 PARTS|1 5 2 2 HAS 2 3 HAS|1 6 2 2 supplier 3 5 SUPPLIER 000000001|1 7 2 2 SUPPLIED 5 6 SUPPLIED
2 0 -1 0 Question 0 7|2 1 0 1 WHAT 0 1 WHAT|2 2 0 1 PartsOf 1 7|2 3 2 2 Kind 1 3|2 4 3 3 Types 1 2|2 5 4 4 type 1 2 ECONOMY|2 6 3 3 PARTS 2 3 PARTS|2 7 2 2 HAS 3 4 HAS|2 8 2 2 supplier 4 6 SUPPLIER 000000002|2 9 2 2 SUPPLIED 6 7 SUPPLIED
3 0 -1 0 Question 0 9|3 1 0 1 WHAT 0 1 WHAT|3 2 0 1 PartsOf 1 9|3 3 2 2 Kind 1 5|3 4 3 3 Types 1 4|3 5 4 4 Types 1 2|3 6 5 5 type 1 2 ECONOMY|3 7 4 4 AND 2 3 AND|3 8 4 4 type 3 4 PROMO|3 9 3 3 PARTS 4 5 PARTS|3 10 2 2 HAS 5 6 HAS|3 11 2 2 supplier 6 8 SUPPLIER 000000003|3 12 2 2 SUPPLIED 8 9 SUPPLIED
4 0 -1 0 Question 0 4|4 1 0 1 WHO 0 1 WHO|4 2 0 1 SUPPLIED 1 2 SUPPLIED|4 3 0 1 part 2 4 BLUE BOLT
5 0 -1 0 Question 0 9|5 1 0 1 WHICH 0 1 WHICH|5 2 0 1 SUPPLIERS 1 2 SUPPLIERS|5 3 0 1 HAVE 2 3 HAVE|5 4 0 1 SUPPLIED 3 4 SUPPLIED|5 5 0 1 BOTH 4 5 BOTH|5 6 0 1 Types 5 8|5 7 6 2 Types 5 6|5 8 7 3 type 5 6 ECONOMY|5 9 6 2 AND 6 7 AND|5 10 6 2 type 7 8 PROMO|5 11 0 1 PARTS 8 9 PARTS
6 0 -1 0 Question 0 14|6 1 0 1 WHAT 0 1 WHAT|6 2 0 1 PartsOf 1 14|6 3 2 2 Kind 1 2|6 4 3 3 PARTS 1 2 PARTS|6 5 2 2 HAS 2 3 HAS|6 6 2 2 supplier 3 5 SUPPLIER 000000004|6 7 2 2 SUPPLIED 5 6 SUPPLIED|6 8 2 2 THAT 6 7 THAT|6 9 2 2 ARE 7 8 ARE|6 10 2 2 THE 8 9 THE|6 11 2 2 SAME 9 10 SAME|6 12 2 2 TYPE 10 11 TYPE|6 13 2 2 AS 11 12 AS|6 14 2 2 part 12 14 BLUE BOLT""".replace("\n", "|")


@query(f"with x as (select string_split(x, ' ') as c from (select unnest(string_split('{_TREES}', '|')) as x)) select c[1]::bigint as id, c[2]::integer as node_id, c[3]::integer as parent_id, c[4]::integer as depth, c[5] as symbol, c[6]::integer as start, c[7]::integer as \"end\", nullif(array_to_string(c[8:], ' '), '') as text from x")
def q_parse_tree(spark, sf_dir):
    nodes = questions.best(_parses(spark, sf_dir)).select("id", F.explode("tree").alias("x"))
    return nodes.select("id", "x.node_id", "x.parent_id", "x.depth", "x.symbol", "x.start", "x.end", "x.text")


@query(f"with {_TOKENS}, s as (select id, w, unnest(['ECONOMY', 'PROMO']) as k from t) select id, 'type' as symbol, k as text from s where regexp_matches(w, '{_SHAPE}$') and contains(w, k)")
def q_find_nodes(spark, sf_dir):
    nodes = questions.best(_parses(spark, sf_dir)).select("id", F.explode("tree").alias("x"))
    return nodes.where("x.symbol = 'type'").select("id", "x.symbol", "x.text")


@query(f"with {_READ} select id, cast(1 as integer) as rank, interp, decisions, info from reads where whole")
def q_best_parse(spark, sf_dir):
    return questions.best(_parses(spark, sf_dir), 3).select("id", "rank", "interp", "decisions", F.round("info", 6).alias("info"))


_SOLD = "(select distinct l_partkey, l_suppkey from lineitem) l join part on l_partkey = p_partkey"


@query(f"select {_P} as part from {_SOLD} where l_suppkey = 1 order by part limit 100")
def q_nl_books_by(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[0][1])


@query(f"select {_P} as part from {_SOLD} where l_suppkey = 2 and p_type = 'ECONOMY' order by part limit 100")
def q_nl_books_by_genre(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[1][1])


@query(f"select {_P} as part from {_SOLD} where l_suppkey = 3 and p_type in ('ECONOMY', 'PROMO') order by part limit 100")
def q_nl_or_genres(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[2][1])


@query("select 'http://ex/supplier/' || l_suppkey as supplier from (select distinct l_suppkey from lineitem where l_partkey = (select min(p_partkey) from part where p_name = 'blue bolt')) order by supplier limit 100")
def q_nl_who_wrote(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[3][1])


@query(f"select 'http://ex/supplier/' || l_suppkey as supplier from (select l_suppkey from {_SOLD} where p_type = 'ECONOMY' intersect select l_suppkey from {_SOLD} where p_type = 'PROMO') order by supplier limit 100")
def q_nl_and_genres(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[4][1])


@query(f"select {_P} as part from {_SOLD} where l_suppkey = 4 and p_type = (select p_type from part where p_partkey = (select min(p_partkey) from part where p_name = 'blue bolt')) order by part limit 100")
def q_nl_same_genre(spark, sf_dir):
    return questions.answer(spark, sf_dir, QUESTIONS[5][1])


# --- questions by plug-ins: names are told by models, so readings have information

#: Questions on books, authors and genres, see demo.books.
BOOK_QUESTIONS = (
    (1, "What books has Supplier#000000001 written?"),
    (2, "What ECONOMY books has Supplier#000000002 written?"),
    (3, "Which ECONOMY and PROMO books has Supplier#000000003 written?"),
    (4, "Who wrote blue bolt?"),
    (5, "Which authors have written ECONOMY and PROMO books?"),
    (6, "What books has Supplier#000000004 written that are the same genre as blue bolt?"),
    (7, "How heavy is the moon?"),
)


def _books(spark: SparkSession, sf_dir: str) -> generator.Pipeline:
    """The models are built once in a session and for a folder, and read from then on."""
    graph_of = {"star": books.triples(spark, sf_dir)}
    return generator.Pipeline(spark, books.config(work_folder(spark, sf_dir)), graph_of).build()


def _chance(k: str, names: str, asked: str) -> str:
    """CTEs up to {k}p (s, p): where the rating and the length of each asked string lie among those of the names."""
    return f"""{k}n as ({names}), {k}m as (select gram, count(*) as cnt from {_g(3, f"{k}n")} group by 1), {k}z as (select sum(cnt) as size from {k}m), {k}o as (select distinct s from (select s from {k}n union all {asked})),
{k}r as (select s, (sum(coalesce(cnt, 0)) + 1) / (length(s) + 5) / any_value(size) as v from {_g(3, f"{k}o")} left join {k}m using (gram), {k}z group by s),
{k}x as (select 'r' as f, v from {k}n join {k}r using (s) union all select 'l', cast(length(s) as double) from {k}n),
{k}g as (select f, min(gap) as g from (select f, v - lag(v) over (partition by f order by v) as gap from (select distinct f, v from {k}x)) group by f),
{k}t as (select f, min(v) as lo, max(v) as hi, any_value(g) as g from {k}x join {k}g using (f) group by f),
{k}u as (select f, lo, hi, case when g is null then 1 when floor((hi - lo) / g) > 5000 then 5000 else floor((hi - lo) / g) end as nb, case when g is null then 1 when floor((hi - lo) / g) > 5000 then (hi - lo) / 5000 else g end as gr from {k}t),
{k}b as (select f, least(floor((v - lo) / gr), nb - 1) as bucket, count(*) as c from {k}x join {k}u using (f) group by 1, 2), {k}d as (select f, bucket, sum(c) over (partition by f order by bucket) / sum(c) over (partition by f) as cum from {k}b),
{k}w as (select s, 'r' as f, v from {k}r union all select s, 'l', length(s) from {k}o), {k}y as (select s, f, v, (v - lo) / gr as b, floor((v - lo) / gr) as l, lo, hi, nb from {k}w join {k}u using (f)),
{k}c as (select *, coalesce((select max(cum) from {k}d where {k}d.f = {k}y.f and bucket <= {k}y.l), 0) as c0, coalesce((select max(cum) from {k}d where {k}d.f = {k}y.f and bucket <= {k}y.l + 1), 0) as c1 from {k}y),
{k}q as (select s, f, case when v < lo then 0 when v >= hi or l >= nb - 1 then 1 when f = 'l' then c0 else c0 + (c1 - c0) * (b - l) end as p from {k}c), {k}p as (select s, product(p) as p from {k}q group by s)"""


_BOOK_SPANS = "a(id, kind, s) as (values (1, 'author', 'SUPPLIER000000001'), (2, 'author', 'SUPPLIER000000002'), (2, 'genre', 'ECONOMY'), (3, 'author', 'SUPPLIER000000003'), (3, 'genre', 'ECONOMY'), (3, 'genre', 'PROMO'), (4, 'book', 'BLUEBOLT'), (5, 'genre', 'ECONOMY'), (5, 'genre', 'PROMO'), (6, 'author', 'SUPPLIER000000004'), (6, 'book', 'BLUEBOLT'))"
_BOOK_NAMES = "select regexp_replace(upper(unnest(case when len(w) >= 2 then [p_name, w[1], w[-1]] else [p_name] end)), '[^A-Z0-9]', '', 'g') as s from (select p_name, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '') as w from part)"
_SELLERS = "select regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') as s from supplier where s_suppkey in (select l_suppkey from lineitem group by 1 having count(distinct l_partkey) > 1)"
_PER_KIND = ", ".join(_chance(k, names, f"select s from a where kind = '{kind}'") for k, kind, names in (("k1", "author", _SELLERS), ("k2", "book", _BOOK_NAMES), ("k3", "genre", "select distinct regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') as s from part")))


@query(f"with {_BOOK_SPANS}, {_PER_KIND}, h as (select a.id, p from a join (select 'author' as kind, * from k1p union all select 'book', * from k2p union all select 'genre', * from k3p) x on x.kind = a.kind and x.s = a.s) select cast(id as bigint) as id, round(sum(-ln(p)), 5) as info from h group by 1")
def q_tree_info(spark, sf_dir):
    """The least information of a question's readings: of the names in it, by their kinds' models."""
    pipe = _books(spark, sf_dir)
    asked = spark.createDataFrame(list(BOOK_QUESTIONS), "id long, text string")
    return pipe.interpreted(pipe.scored(asked)).select("id", F.round("info", 5).alias("info"))


def _answer(number: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _books(spark, sf_dir).answer(BOOK_QUESTIONS[number - 1][1], books.triples(spark, sf_dir))

    return run


_BOOK_ROW = f"{_P} as book, p_name as title, 'http://ex/type/' || p_type as genre"
_BLUE = "(select min('http://ex/part/' || p_partkey) from part where p_name = 'blue bolt')"
for _number, _name, _sql in (
    (3, "q_books_of_either_genre", f"select distinct {_BOOK_ROW} from {_SOLD} where l_suppkey = 3 and p_type in ('ECONOMY', 'PROMO') order by 1, 2, 3 limit 100"),
    (4, "q_books_author", f"select distinct {_S} as author, s_name as name from lineitem join supplier on l_suppkey = s_suppkey where 'http://ex/part/' || l_partkey = {_BLUE} order by 1, 2 limit 100"),
    (5, "q_books_authors_of_both", f"select {_S} as author, s_name as name from supplier where s_suppkey in (select l_suppkey from {_SOLD} where p_type = 'ECONOMY') and s_suppkey in (select l_suppkey from {_SOLD} where p_type = 'PROMO') order by 1, 2 limit 100"),
    (6, "q_books_same_genre", f"select distinct {_BOOK_ROW} from {_SOLD} where l_suppkey = 4 and p_type = (select p_type from part where 'http://ex/part/' || p_partkey = {_BLUE}) order by 1, 2, 3 limit 100"),
):
    QUERIES[_name], ORACLE[_name] = _answer(_number), _sql

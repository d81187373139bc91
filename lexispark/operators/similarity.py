"""Similarity of strings by shared n-grams, as an inverted index: pairs meet at their grams and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import gram_probability, info, ngrams


def grams(items: DataFrame, item: str, n: int) -> DataFrame:
    """(item, gram, cnt): each distinct item's grams with their counts in it."""
    return items.select(item).distinct().select(item, F.explode(ngrams(F.col(item), n)).alias("gram")).groupBy(item, "gram").agg(F.count("*").alias("cnt"))


def gram_model(items: DataFrame, item: str, n: int) -> DataFrame:
    """(gram, cnt) over all rows, repeats counted."""
    return items.select(F.explode(ngrams(F.col(item), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


def jaccard_pairs(items: DataFrame, item: str, n: int = 3) -> DataFrame:
    """(a, b, d) with a < b for pairs that share a gram: 1 - sum of minima / sum of maxima of their gram counts. Pairs left out have d = 1."""
    g = grams(items, item, n)
    x, y = g.withColumnsRenamed({item: "a", "cnt": "x"}), g.withColumnsRenamed({item: "b", "cnt": "y"})
    met = x.join(y, "gram").where("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("i"))
    return met.select("a", "b", (1 - F.col("i") / (F.length("a") + F.length("b") + 2 * (n - 1) - F.col("i"))).alias("d"))


def elements(items: DataFrame, item: str, n: int) -> DataFrame:
    """(item, _all, _size): each distinct item's grams as a set, a gram that comes k times being k elements, so that the multiset distance is the set's."""
    each = grams(items.where(F.col(item).isNotNull()), item, n).select(item, F.explode(F.transform(F.sequence(F.lit(1), F.col("cnt").cast("int")), lambda k: F.concat_ws("\u0001", "gram", k.cast("string")))).alias("_e"))
    return each.groupBy(item).agg(F.collect_list("_e").alias("_all"), F.count("*").cast("int").alias("_size"))


def _distance(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 1 - common / (F.size(a) + F.size(b) - common)


def _rarest_first(sets: DataFrame, item: str, frequency: DataFrame) -> DataFrame:
    """(item, _size, _e, _at): the elements of each set, from 1 on the rarest first by frequency (_e, _f); those without one come first."""
    each = sets.select(item, "_size", F.explode("_all").alias("_e")).join(frequency, "_e", "left")
    # a set is as large as a name is long
    return each.withColumn("_at", F.row_number().over(Window.partitionBy(item).orderBy(F.col("_f").asc_nulls_first(), "_e")))


def _prefix(size: Column, share) -> Column:
    """How many of the rarest elements two sets of a similarity of `share` at least can't both miss."""
    return size - F.ceil(size * share - 1e-9).cast("int") + 1


def similar_pairs(items: DataFrame, item: str, most: float, n: int = 3) -> DataFrame:
    """(a, b, d) with a < b for all pairs of a distance of at most `most` (below 1).

    Pairs meet where both have one of their rarest grams, as many of them as a pair that close can't do without, so a common gram brings few pairs up.
    """
    if not 0 <= most < 1:
        raise ValueError("the distance must be from 0 to below 1")
    sets = elements(items, item, n)
    frequency = sets.select(F.explode("_all").alias("_e")).groupBy("_e").agg(F.count("*").alias("_f"))
    few = _rarest_first(sets, item, frequency).where(F.col("_at") <= _prefix(F.col("_size"), 1 - most)).select(item, "_size", "_e")
    x, y = (few.select(F.col(item).alias(v), F.col("_size").alias(f"_n{v}"), "_e") for v in "ab")
    close = (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * (1 - most) - 1e-9) & (F.col("a") < F.col("b"))
    met = x.join(y, "_e").where(close).select("a", "b").distinct()
    both = met.join(sets.select(F.col(item).alias("a"), F.col("_all").alias("_x")), "a").join(sets.select(F.col(item).alias("b"), F.col("_all").alias("_y")), "b")
    return both.select("a", "b", _distance("_x", "_y").alias("d")).where(F.col("d") <= most)


def info_jaccard(pairs: DataFrame, model: DataFrame, n: int = 3) -> DataFrame:
    """pairs (a, b) with d: grams weigh -ln of their probability in the model (gram, cnt); grams that it lacks count as seen never."""
    total = model.agg(F.sum("cnt").alias("total"))
    weigh = lambda side: pairs.select(side).distinct().select(side, F.explode(ngrams(F.col(side), n)).alias("gram")).groupBy(side, "gram").agg(F.count("*").alias(f"n_{side}"))
    a, b = weigh("a"), weigh("b")
    both = pairs.select("a", "b").distinct()
    left = both.join(a, "a").select("a", "b", "gram", "n_a", F.lit(0).alias("n_b"))
    right = both.join(b, "b").select("a", "b", "gram", F.lit(0).alias("n_a"), "n_b")
    per = left.union(right).groupBy("a", "b", "gram").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    weighed = per.join(model, "gram", "left").join(F.broadcast(total)).withColumn("w", info(gram_probability(F.col("cnt"), F.col("total"))))  # one row
    return weighed.groupBy("a", "b").agg((1 - F.sum(F.least("n_a", "n_b") * F.col("w")) / F.sum(F.greatest("n_a", "n_b") * F.col("w"))).alias("d"))


#: Grams of a query, the rarest, by which its first candidates are found.
_FIRST = 4


def closest_names(queries: DataFrame, query: str, names: DataFrame, name: str, n: int = 3, keep: int = 5) -> DataFrame:
    """(query, name, d) of all names that are at least as close to the query as its `keep`-th closest, and share a gram with it.

    A query's rarest grams find first candidates; the distance of the `keep`-th of them bounds what can still be among the closest, and so how many of the
    query's grams, from the rarest on, every such name must meet. Common grams are looked up only where the bound leaves them in.
    """
    q = elements(queries, query, n).select(query, F.col("_all").alias("_x"), "_size", F.col("_all"))
    e = elements(names, name, n).select(F.col(name).alias("_name"), F.col("_all").alias("_y"))
    posts = e.select("_name", F.explode("_y").alias("_e"))
    frequency = posts.groupBy("_e").agg(F.count("*").alias("_f"))
    ranked = _rarest_first(q, query, frequency)
    known = ranked.where("_f is not null").withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy("_at")))

    def measured(some: DataFrame) -> DataFrame:
        met = some.select(query, "_e").join(posts, "_e").select(query, "_name").distinct()
        return met.join(q.select(query, "_x"), query).join(e, "_name").select(query, F.col("_name").alias(name), _distance("_x", "_y").alias("d"))

    first = measured(known.where(F.col("_k") <= _FIRST))
    best = first.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy("d"))).where(F.col("_k") == keep).select(query, F.col("d").alias("_bound"))
    rest = known.join(best, query, "left").where(F.col("_at") <= _prefix(F.col("_size"), 1 - F.coalesce("_bound", F.lit(1.0))))
    return measured(rest)


def identify(queries: DataFrame, query: str, entities: DataFrame, name: str, uri: str, n: int = 3, keep: int = 5) -> DataFrame:
    """The `keep` entities closest to each standardised query: (query, uri, name, d, rank), ties by uri and name.

    Candidates share a gram with the query; where fewer than `keep` do, no others are returned.
    """
    d = closest_names(queries, query, entities.select(name).distinct(), name, n, keep)
    # a name's entities are equally far, so those after its first `keep` by uri are never among the closest
    own = entities.select(name, uri).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(uri)))
    named = d.join(own.where(F.col("_k") <= keep).drop("_k"), name)
    best = Window.partitionBy(query).orderBy("d", uri, name)
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select(query, uri, name, "d", "rank")


def near_ties(ranked: DataFrame, query: str, cutoff: float = 0.1) -> DataFrame:
    """Candidates whose distance is within the cutoff, relative to the mean, of the query's best; two zeros tie."""
    best = F.min("d").over(Window.partitionBy(query))
    gap = F.when((F.col("d") + best) == 0, F.lit(0.0)).otherwise(2 * (F.col("d") - best) / (F.col("d") + best))
    return ranked.withColumn("gap", gap).where(F.col("gap") < cutoff)

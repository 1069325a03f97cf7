"""Feature extractors over states: rates, visitors' histories, text matches, diversity, positions, normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import pit, state


def number(probes: DataFrame, writes: DataFrame, keys: list[str], override: str | None = None, out: str = "value") -> DataFrame:
    """The last number as of the request; a rank item's own field, if given, comes first."""
    found = pit.as_of_last(probes, writes, keys, "value", out)
    return found if override is None else found.withColumn(out, F.coalesce(F.col(override), F.col(out)))


def rate(writes: DataFrame, keys: list[str], top: str, bottom: str, period_ms: int, periods: list[int]) -> DataFrame:
    """For each key, top over bottom events in each trailing period; NULL where the key lacks either kind or the bottom is 0.

    Each kind is anchored at its own last bucket. One aggregate serves both kinds.
    """
    kinds = writes.where(F.col("type").isin(top, bottom))
    counts = state.periodic_counter(kinds, [*keys, "type"], period_ms, periods)
    both = counts.groupBy(*keys).agg(F.max(F.when(F.col("type") == top, F.col("counts"))).alias("_top"), F.max(F.when(F.col("type") == bottom, F.col("counts"))).alias("_bottom"))
    values = F.zip_with("_top", "_bottom", lambda t, b: F.try_divide(t.cast("double"), b.cast("double")))
    return both.where(F.col("_top").isNotNull() & F.col("_bottom").isNotNull()).select(*keys, values.alias("rates"))


def normalised_rate(writes: DataFrame, keys: list[str], top: str, bottom: str, period_ms: int, periods: list[int], weight: float) -> DataFrame:
    """Rates drawn to the global one: (weight + top) / (weight * (global bottom div global top) + bottom), with whole-number division."""
    kinds = writes.where(F.col("type").isin(top, bottom))
    counts = state.periodic_counter(kinds, [*keys, "type"], period_ms, periods)
    both = counts.groupBy(*keys).agg(F.max(F.when(F.col("type") == top, F.col("counts"))).alias("_top"), F.max(F.when(F.col("type") == bottom, F.col("counts"))).alias("_bottom"))
    every = state.periodic_counter(kinds, ["type"], period_ms, periods).agg(F.max(F.when(F.col("type") == top, F.col("counts"))).alias("_all_top"), F.max(F.when(F.col("type") == bottom, F.col("counts"))).alias("_all_bottom"))
    rows = both.where(F.col("_top").isNotNull() & F.col("_bottom").isNotNull()).crossJoin(F.broadcast(every))  # one row
    parts = [
        F.try_divide(weight + F.col("_top")[i], weight * F.when(F.col("_all_top")[i] != 0, F.floor(F.col("_all_bottom")[i] / F.col("_all_top")[i])) + F.col("_bottom")[i]) for i in range(len(periods))
    ]
    return rows.select(*keys, F.array(*parts).alias("rates"))


def interacted_with(candidates: DataFrame, history: DataFrame, fields: DataFrame, visitor: str, item: str, count: int = 100, duration_ms: int = 86_400_000) -> DataFrame:
    """For candidates (visitor, item), how often the values of the item's field occur among those of the visitor's last items.

    fields: item, values (array of string). Bags are counted per (visitor, value); nothing is gathered per visitor but the bounded list.
    """
    recent = state.bounded_list(history, [visitor], count, duration_ms, value=item).select(visitor, F.explode("values").alias("x")).select(visitor, F.col("x.value").alias(item))
    bag = recent.join(fields, item).select(visitor, F.explode("values").alias("value")).groupBy(visitor, "value").agg(F.count("*").alias("n"))
    asked = candidates.select(visitor, item).distinct().join(fields, item).select(visitor, item, F.explode("values").alias("value"))
    sums = asked.join(bag, [visitor, "value"]).groupBy(visitor, item).agg(F.sum("n").cast("double").alias("score"))
    return candidates.join(sums, [visitor, item], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def field_match(pairs: DataFrame, left: str, right: str, method: str, n: int = 3) -> DataFrame:
    """Jaccard of terms or n-grams of two text columns, as score."""
    a, b = T.terms(F.col(left)), T.terms(F.col(right))
    if method == "ngram":
        return pairs.withColumn("score", T.jaccard(T.ngrams(a, n), T.ngrams(b, n)))
    return pairs.withColumn("score", T.jaccard(T.unique(a), T.unique(b)))


def bm25_scores(pairs: DataFrame, query: str, doc: str, ids: list[str], stats: DataFrame, df: DataFrame) -> DataFrame:
    """BM25 of two text columns: query terms meet document frequencies by an equi-join on the term, so the dictionary may be of any size."""
    sized = pairs.select(*ids, T.unique(T.terms(F.col(query))).alias("_q"), T.unique(T.terms(F.col(doc))).alias("_d"))
    shared = sized.select(*ids, F.size("_d").alias("_n"), F.explode(F.array_intersect("_q", "_d")).alias("term"))
    one = stats.select(F.col("docs").alias("_docs"), F.col("avgdl").alias("_avgdl"))
    # Of the dictionary, only the terms that meet take part in the join.
    df = df.join(shared.select("term").distinct(), "term", "left_semi")
    part = T.bm25_term(F.col("_docs").cast("double"), F.col("_avgdl"), F.coalesce("df", F.lit(0)).cast("double"), F.col("_n").cast("double"))
    scores = shared.join(df, "term", "left").crossJoin(F.broadcast(one)).groupBy(*ids).agg(F.sum(part).alias("score"))  # one row
    return sized.select(*ids).join(scores, ids, "left").select(*ids, F.coalesce("score", F.lit(0.0)).alias("score"))


def diversity_number(rows: DataFrame, ranking: str, pos: str, value: str, top: int = 20) -> DataFrame:
    """The value less the median of the first top valued items of the ranking; NULL for items without a value; 0.0 if no item has one."""
    group = Window.partitionBy(ranking)
    nth = F.sum(F.col(value).isNotNull().cast("int")).over(group.orderBy(pos))
    ranked = rows.withColumn("_nth", F.when(F.col(value).isNotNull(), nth))
    median = F.percentile(F.when(F.col("_nth") <= top, F.col(value)), F.lit(0.5)).over(group)
    return ranked.withColumn("_median", median).withColumn("diversity", F.when(F.col("_median").isNull(), F.lit(0.0)).otherwise(F.col(value) - F.col("_median"))).drop("_nth", "_median")


def diversity_string(rows: DataFrame, ranking: str, pos: str, item: str, values: str, top: int = 20) -> DataFrame:
    """The share that the item's strings have among all strings of the first top valued items of the ranking."""
    has = F.col(values).isNotNull() & (F.size(values) > 0)
    group = Window.partitionBy(ranking)
    nth = F.sum(has.cast("int")).over(group.orderBy(pos))
    ranked = rows.withColumn("_first", F.when(has & (nth <= top), F.col(values)))
    # A ranking is a bounded list, so all strings of its first items fit a row; one shuffle, no join.
    ranked = ranked.withColumn("_all", F.flatten(F.collect_list("_first").over(group)))
    own = F.aggregate(values, F.lit(0).cast("long"), lambda acc, s: acc + F.size(F.filter("_all", lambda x: x == s)))
    return ranked.withColumn("diversity", F.when(F.size("_all") == 0, F.lit(0.0)).when(has, own / F.size("_all"))).drop("_first", "_all")


def minmax(value: Column, ranking: str) -> Column:
    """Linear normalisation within a ranking; NULL where all are equal."""
    group = Window.partitionBy(ranking)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.try_divide(value - low, high - low)


def rank_share(value: Column, ranking: str, *ties: str) -> Column:
    """Position normalisation: the number of items before it, in ascending order, over the ranking's size."""
    return (F.row_number().over(Window.partitionBy(ranking).orderBy(value, *ties)) - 1) / F.count(F.lit(1)).over(Window.partitionBy(ranking))

"""Dataset profiling: field statistics and the features and models they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suggested periods in days of rates and counts.
PERIODS = (3, 7, 14, 30)


def event_counts(events: DataFrame, event: str = "event") -> DataFrame:
    return events.groupBy(event).agg(F.count("*").alias("n"))


def interaction_types(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("type").agg(F.count("*").alias("n"))


def numeric_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, min, max, n of numeric columns, in one pass."""
    stats = rows.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max), ("n", F.count))))
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"), F.col(f"n_{c}").alias("n")) for c in fields]
    return stats.select(F.inline(F.array(*parts)))


def numeric_rule(stats: DataFrame) -> DataFrame:
    """Fields that vary become number features."""
    return stats.where("min < max")


def string_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n of string columns, in one pass and one shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields))
    return rows.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))


def string_rule(values: DataFrame, least_count: int = 3, share: float = 0.9, least_values: int = 10, threshold: float = 0.001, most_values: int = 100) -> DataFrame:
    """field, value, n, nth, encode: values that string features of a field would list.

    Values with enough rows, by falling count, while those up to there make up at most the share of all (or are among the first
    least_values), without rare ones, at most most_values. Two to nine values: onehot; more: index; fewer: no feature.
    """
    often = values.where(F.col("n") >= least_count)
    by = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    total = F.sum("n").over(Window.partitionBy("field"))
    ranked = often.withColumn("nth", F.row_number().over(by)).withColumn("total", total).withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where(((F.col("upto") <= share * F.col("total")) | (F.col("nth") <= least_values)) & (F.col("n") >= threshold * F.col("total")) & (F.col("nth") <= most_values))
    size = F.count(F.lit(1)).over(Window.partitionBy("field"))
    return kept.withColumn("size", size).where("size >= 2").select("field", "value", "n", "nth", F.when(F.col("size") < 10, "onehot").otherwise("index").alias("encode"))


def vector_rule(rows: DataFrame, field: str) -> DataFrame:
    """field, reduce: vectorN if all vectors have one size, else the default reducers."""
    sizes = rows.where(F.col(field).isNotNull()).agg(F.min(F.size(field)).alias("low"), F.max(F.size(field)).alias("high"))
    return sizes.where("high > 0").select(F.lit(field).alias("field"), F.when(F.col("low") == F.col("high"), F.concat(F.lit("vector"), F.col("high").cast("string"))).otherwise("min,max,size,avg").alias("reduce"))


def interaction_rules(clicks: DataFrame) -> DataFrame:
    """name, type, source of the features that each interaction type suggests: counts, windowed counts, rates, visitors' histories."""
    kinds = clicks.select("type").distinct()
    suggested = [("interaction_count", "count_"), ("window_count", "window_"), ("rate", "rate_"), ("interacted_with", "interacted_")]
    parts = [F.struct(F.concat(F.lit(prefix), F.col("type")).alias("name"), F.lit(kind).alias("feature"), F.col("type").alias("source")) for kind, prefix in suggested]
    return kinds.select(F.inline(F.array(*parts)))


def model_rules(rankings: Column, clickthroughs: Column, interactions: Column) -> Column:
    """The models that the counts allow."""
    return F.filter(F.array(F.when((rankings >= 100) & (clickthroughs >= 100), "lambdamart"), F.when(interactions >= 10, "trending"), F.when(interactions >= 10, "similar")), lambda m: m.isNotNull())

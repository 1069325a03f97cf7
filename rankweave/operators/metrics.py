"""Ranking metrics. Rows are (ranking, pos from 0 in the order to judge, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reranked(rows: DataFrame, score: Column, *ties: str) -> DataFrame:
    """rows with pos by descending score; equal scores keep their order."""
    return rows.withColumn("_score", score).withColumn("pos", F.row_number().over(Window.partitionBy("ranking").orderBy(F.col("_score").desc(), *(ties or ("pos",)))) - 1).drop("_score")


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def ndcg(rows: DataFrame, k: int = 10) -> DataFrame:
    """ndcg a ranking, with gain 2^label - 1; rankings without labels have 1.0."""
    ideal = F.row_number().over(Window.partitionBy("ranking").orderBy(F.col("label").desc(), "pos"))
    parts = rows.withColumn("_ideal", ideal).groupBy("ranking").agg(
        F.sum(F.when(F.col("pos") < k, _gain(F.col("label")) / F.log2(F.col("pos") + 2.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_ideal") <= k, _gain(F.col("label")) / F.log2(F.col("_ideal") + 1.0)).otherwise(0.0)).alias("ideal"),
    )
    return parts.select("ranking", F.when(F.col("ideal") > 0, F.try_divide("dcg", "ideal")).otherwise(1.0).alias("ndcg"))


def average_precision(rows: DataFrame, k: int = 10) -> DataFrame:
    """map a ranking: the mean precision at its relevant positions among the first k; 0.0 without any."""
    hits = F.sum((F.col("label") > 0).cast("int")).over(Window.partitionBy("ranking").orderBy("pos"))
    precise = rows.withColumn("_hits", hits).where((F.col("pos") < k) & (F.col("label") > 0)).groupBy("ranking").agg(F.avg(F.col("_hits") / (F.col("pos") + 1)).alias("map"))
    return rows.select("ranking").distinct().join(precise, "ranking", "left").select("ranking", F.coalesce("map", F.lit(0.0)).alias("map"))


def reciprocal_rank(rows: DataFrame) -> DataFrame:
    """mrr a ranking: one over the first relevant position; 0.0 without any."""
    return rows.groupBy("ranking").agg(F.coalesce(1.0 / (F.min(F.when(F.col("label") > 0, F.col("pos"))) + 1), F.lit(0.0)).alias("mrr"))


def kendall(rows: DataFrame, a: str = "pos", b: str = "other") -> DataFrame:
    """kendall a ranking: concordant less discordant pairs of two orders, over all pairs. Rankings are bounded lists, compared within their own array."""
    listed = rows.groupBy("ranking").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(a), F.col(b)))), lambda x: x[b]).alias("_b"))
    pairs = F.aggregate(
        F.sequence(F.lit(1), F.size("_b")),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.aggregate(F.slice("_b", i, F.size("_b")), F.lit(0).cast("long"), lambda s, y: s + F.signum(y - F.get(F.col("_b"), i - 1)).cast("long")),
    )
    n = F.size("_b")
    return listed.select("ranking", F.coalesce(F.try_divide(pairs.cast("double"), (n * (n - 1) / 2)), F.lit(1.0)).alias("kendall"))


def mean(metric: DataFrame, column: str) -> DataFrame:
    return metric.agg(F.avg(column).alias(column))

"""Point-in-time joins: what a state said just before an event, by a union and a running window, never by a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_last(probes: DataFrame, writes: DataFrame, keys: list[str], value: str = "value", out: str = "value") -> DataFrame:
    """probes with the value last written to their keys strictly before them in (ts, seq); NULL if none.

    Both sides are shuffled once on the keys; a key's writes and probes pass by in order, so memory doesn't grow with its history.
    """
    left = probes.select(F.struct(*probes.columns).alias("_probe"), *keys, "ts", "seq", F.lit(None).cast(writes.schema[value].dataType).alias("_value"), F.lit(0).alias("_kind"))
    right = writes.select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), *keys, "ts", "seq", F.col(value).alias("_value"), F.lit(1).alias("_kind"))
    # At equal (ts, seq) the probe comes first: an event doesn't see its own writes.
    over = Window.partitionBy(*keys).orderBy("ts", "seq", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = left.unionByName(right).withColumn("_seen", F.last("_value", ignorenulls=True).over(over))
    return seen.where("_kind = 0").select("_probe.*", F.col("_seen").alias(out))


def as_of_count(probes: DataFrame, writes: DataFrame, keys: list[str], out: str = "count") -> DataFrame:
    """probes with the number of writes to their keys strictly before them; 0 if none."""
    left = probes.select(F.struct(*probes.columns).alias("_probe"), *keys, "ts", "seq", F.lit(0).alias("_one"))
    right = writes.select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), *keys, "ts", "seq", F.lit(1).alias("_one"))
    over = Window.partitionBy(*keys).orderBy("ts", "seq", "_one").rowsBetween(Window.unboundedPreceding, -1)
    seen = left.unionByName(right).withColumn("_seen", F.sum("_one").over(over))
    return seen.where(F.col("_probe").isNotNull()).select("_probe.*", F.coalesce("_seen", F.lit(0)).cast("long").alias(out))


def as_of_periodic(probes: DataFrame, writes: DataFrame, keys: list[str], period_ms: int, periods: list[int]) -> DataFrame:
    """probes with the periodic counter of their keys as it stood strictly before them: count_p for each p, anchored at the last bucket then; NULL if none.

    Running sums over the events of a key by bucket (a range frame up to the current row) keep open buckets growing within the day.
    """
    bucketed = writes.withColumn("_bucket", F.col("ts") - F.pmod(F.col("ts"), F.lit(period_ms)))
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    running = F.row_number().over(order)
    rows = bucketed.withColumn("_all", running)
    # The count over the last p periods is all so far, less all before the first bucket of the range.
    before = rows.groupBy(*keys, "_bucket").agg((F.min("_all") - 1).alias("_before"))
    for p in periods:
        low = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(-p * period_ms, 0)
        before = before.withColumn(f"_low_{p}", F.min("_before").over(low))
    state = rows.join(before, [*keys, "_bucket"]).select(*keys, "ts", "seq", F.struct(*((F.col("_all") - F.col(f"_low_{p}")).alias(f"count_{p}") for p in periods)).alias("value"))
    joined = as_of_last(probes, state, keys, out="_counts")
    return joined.select(*probes.columns, *(F.col(f"_counts.count_{p}").alias(f"count_{p}") for p in periods))


def two_hop(probes: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], via: str, value: str, out: str) -> DataFrame:
    """Two lookups in turn: first maps the probe's keys to via as of then, second has via's value as of then."""
    hop = as_of_last(probes, first, keys, via, via)
    return as_of_last(hop, second.withColumnRenamed(value, "_v"), [via], "_v", out)

"""Checks of an event data set; each gives rows that tell what is wrong (none: nothing is)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_order(events: DataFrame, slots: str | None = None) -> DataFrame:
    """One row: n_late, events earlier than some event before them in the stream.

    The latest time before each event is a running maximum. With slots (a column whose order goes with seq, such as a day or file number), it
    runs within each slot and takes the maximum of all earlier slots from a small table, so no task sees the whole stream.
    """
    if slots is None:
        lag = F.max("ts").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        return events.withColumn("_m", lag).agg(F.coalesce(F.sum((F.col("ts") < F.col("_m")).cast("long")), F.lit(0)).alias("n_late"))
    own = F.max("ts").over(Window.partitionBy(slots).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    tops = events.groupBy(slots).agg(F.max("ts").alias("_top"))
    earlier = tops.withColumn("_before", F.max("_top").over(Window.orderBy(slots).rowsBetween(Window.unboundedPreceding, -1))).drop("_top")  # a row a slot
    seen = events.withColumn("_own", own).join(earlier, slots).withColumn("_m", F.greatest("_own", "_before"))
    return seen.agg(F.coalesce(F.sum((F.col("ts") < F.col("_m")).cast("long")), F.lit(0)).alias("n_late"))


def event_types(events: DataFrame, needed: tuple[str, ...] = ("item", "ranking", "interaction")) -> DataFrame:
    """Kinds of event that are missing."""
    kinds = events.select(F.col("event").alias("kind")).distinct()
    want = events.sparkSession.createDataFrame([(k,) for k in needed], "kind string")
    return want.join(kinds, "kind", "left_anti")


def missing_fields(referenced: DataFrame, seen: DataFrame) -> DataFrame:
    """Fields that features refer to and no event has."""
    return referenced.join(seen, referenced.columns, "left_anti").distinct()


def unknown_rankings(clicks: DataFrame, rankings: DataFrame) -> DataFrame:
    """Interactions whose ranking isn't there."""
    return clicks.where(F.col("ranking").isNotNull()).join(rankings.select("ranking").distinct(), "ranking", "left_anti")


def unknown_items(clicks: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with items never described, or described only at that time or later: item, ts, why."""
    first = items.groupBy("item").agg(F.min("ts").alias("_first"))
    joined = clicks.join(first, "item", "left")
    why = F.when(F.col("_first").isNull(), "never").when(F.col("ts") <= F.col("_first"), "later")
    return joined.withColumn("why", why).where(F.col("why").isNotNull()).drop("_first")


def click_positions(clicks: DataFrame, rows: DataFrame) -> DataFrame:
    """pos, n: how often each position was clicked; pos is -1 for items that the ranking didn't show."""
    last = rows.groupBy("ranking", "item").agg(F.max("pos").alias("pos"))
    return clicks.select("ranking", "item").join(last, ["ranking", "item"], "left").groupBy(F.coalesce("pos", F.lit(-1)).alias("pos")).agg(F.count("*").alias("n"))


def single_position(histogram: DataFrame) -> DataFrame:
    """The one position, if all clicks are on it."""
    return histogram.agg(F.count("*").alias("positions"), F.max("pos").alias("pos")).where("positions = 1")


def unused_types(clicks: DataFrame, weights: list[str]) -> DataFrame:
    """Types of interaction that no model weighs."""
    return clicks.where(~F.col("type").isin(*weights)).groupBy("type").agg(F.count("*").alias("n"))


def string_usage(values: DataFrame, configured: DataFrame, least: float = 0.5) -> DataFrame:
    """Fields of which less than this share of the configured values occurs: field, used, configured. Both sides: field, value."""
    used = configured.join(values.select("field", "value").distinct().withColumn("_u", F.lit(1)), ["field", "value"], "left")
    return used.groupBy("field").agg(F.coalesce(F.sum("_u"), F.lit(0)).alias("used"), F.count("*").alias("configured")).where(F.col("used") < least * F.col("configured"))

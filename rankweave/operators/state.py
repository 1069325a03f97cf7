"""The seven kinds of keyed state, as folds of a table of writes, and their readings as of earlier moments.

Writes have key columns, ts (milliseconds), seq (order of the stream; breaks ties) and a payload. A fold is one aggregate by key, so
partial sums leave the map side; order is by (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]
ORDER = ("ts", "seq")


def last_value(writes: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Scalar state: the value written last."""
    return writes.groupBy(*keys).agg(F.max_by(value, F.struct(*ORDER)).alias(value))


def map_state(writes: DataFrame, keys: Keys, entry: str = "entry", value: str = "value") -> DataFrame:
    """Map state: the last value of each entry; NULL deletes the entry; a map without entries has no row."""
    # A struct around the value: max_by would pass over NULL itself.
    last = writes.groupBy(*keys, entry).agg(F.max_by(F.struct(value), F.struct(*ORDER)).alias("last")).where(F.col(f"last.{value}").isNotNull())
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(entry), F.col(f"last.{value}"))))).alias("entries"))


def counter(writes: DataFrame, keys: Keys, increment: Column | None = None) -> DataFrame:
    """Counter state: the sum of increments (1 each by default)."""
    return writes.groupBy(*keys).agg(F.sum(F.lit(1) if increment is None else increment).cast("long").alias("count"))


def bounded_list(writes: DataFrame, keys: Keys, count: int, duration_ms: int | None = None, ref_ms: Column | None = None, value: str = "value") -> DataFrame:
    """Bounded-list state: the newest count values, newest first, not older than duration before ref_ms (the key's last write by default).

    row_number <= count lets Spark keep count rows a key in each task before the shuffle, so a hot key isn't gathered whole.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc())
    rows = writes.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= count)
    if duration_ms is not None:
        ref = F.max("ts").over(Window.partitionBy(*keys)) if ref_ms is None else ref_ms
        rows = rows.withColumn("_ref", ref).where(F.col("ts") >= F.col("_ref") - duration_ms)
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "ts", F.col(value).alias("value")))), lambda x: F.struct(x["ts"].alias("ts"), x["value"].alias("value"))).alias("values"))


def frequencies(writes: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Frequency state, exact: a row a key and value with its share."""
    counts = writes.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def top_frequencies(writes: DataFrame, keys: Keys, k: int, value: str = "value") -> DataFrame:
    """Frequency state by a bounded sketch, for keys with very many values: approximate counts of the k most frequent."""
    return writes.groupBy(*keys).agg(F.expr(f"approx_top_k(`{value}`, {k})").alias("top"))


def statistics(writes: DataFrame, keys: Keys, percentiles: tuple[float, ...] = (0.5, 0.9), value: str = "value", exact: bool = True) -> DataFrame:
    """Statistics state: min, max, percentiles (array). exact False uses a sketch of bounded size a key."""
    which = F.array(*(F.lit(p) for p in percentiles))
    found = F.percentile(value, which) if exact else F.percentile_approx(value, which, 10_000)
    return writes.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), found.alias("percentiles"))


def buckets(writes: DataFrame, keys: Keys, period_ms: int, increment: Column | None = None) -> DataFrame:
    """Counts by epoch-aligned period: key, bucket (its start), count."""
    start = F.col("ts") - F.pmod(F.col("ts"), F.lit(period_ms))
    return writes.groupBy(*keys, start.alias("bucket")).agg(F.sum(F.lit(1) if increment is None else increment).cast("long").alias("count"))


def periodic_counter(writes: DataFrame, keys: Keys, period_ms: int, periods: list[int], increment: Column | None = None, anchor_ms: Column | None = None) -> DataFrame:
    """Periodic-counter state: for each p of periods, the sum of the buckets from p periods before the anchor to it, both included (p + 1 buckets).

    The anchor is the key's last bucket that isn't empty; anchor_ms gives another.
    """
    filled = buckets(writes, keys, period_ms, increment)
    # The anchor comes from a second aggregate of the small bucket table, not from a window over raw events.
    last = filled.groupBy(*keys).agg(F.max("bucket").alias("_last"))
    rows = filled.join(last, keys) if keys else filled.crossJoin(F.broadcast(last))  # without keys, last is one row
    at = F.col("_last") if anchor_ms is None else anchor_ms - F.pmod(anchor_ms, F.lit(period_ms))
    sums = [F.coalesce(F.sum(F.when((F.col("bucket") >= at - p * period_ms) & (F.col("bucket") <= at), F.col("count"))), F.lit(0)).cast("long") for p in periods]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("counts"))


def trailing_counts(writes: DataFrame, keys: Keys, period_ms: int, periods: list[int]) -> DataFrame:
    """The periodic counter as it stood after each bucket: key, bucket, counts by a range frame over buckets."""
    filled = buckets(writes, keys, period_ms)
    over = Window.partitionBy(*keys).orderBy("bucket")
    return filled.select(*keys, "bucket", *(F.sum("count").over(over.rangeBetween(-p * period_ms, 0)).alias(f"count_{p}") for p in periods))


def expired(state: DataFrame, now_ms: Column, ttl_ms: int, ts: str = "ts") -> DataFrame:
    """The rows of a state that are still alive."""
    return state.where(F.col(ts) >= now_ms - ttl_ms)


def ordering_errors(events: DataFrame, by: Keys = (), span: int = 1_000_000, slot: Column | None = None) -> DataFrame:
    """Events earlier than the one before them in the stream of their keys (equal ones are in order), with previous, that one's ts.

    The stream is cut into slots of span numbers of seq, or, where seq isn't a number, by slot, whose order goes with seq; a slot's last event
    is handed to the next slot that has any, by a small table of slots. Events without seq come last; one without ts, and the one after it, are in order.
    """
    cut = events.withColumn("_slot", F.floor(F.col("seq") / span) if slot is None else slot)
    # Structs around ts, so that only a slot's first event has no event before it.
    own = F.lag(F.struct("ts")).over(Window.partitionBy(*by, "_slot").orderBy(F.col("seq").asc_nulls_last()))
    tops = cut.groupBy(*by, "_slot").agg(F.max_by(F.struct("ts"), F.struct(F.col("seq").isNull(), "seq")).alias("_last"))
    handed = tops.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy(F.col("_slot").asc_nulls_last()))).drop("_last")  # a row a slot
    same = [cut[c].eqNullSafe(handed[c]) for c in (*by, "_slot")]
    seen = cut.withColumn("_own", own).join(handed, same[0] if len(same) == 1 else same).select(*(cut[c] for c in events.columns), F.coalesce("_own", "_before")["ts"].alias("previous"))
    return seen.where(F.col("ts") < F.col("previous"))

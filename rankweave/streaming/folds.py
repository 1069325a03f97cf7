"""States over streams: the batch folds as Structured Streaming aggregates with a watermark, and the session join as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, ts: str = "ts", late: str = "30 minutes") -> DataFrame:
    """events with event_time and a watermark; later ones than that are left out of windows that are closed."""
    return events.withColumn("event_time", F.timestamp_millis(F.col(ts))).withWatermark("event_time", late)


def counters(events: DataFrame, keys: list[str], increment: Column | None = None) -> DataFrame:
    """Running counters (update or complete mode)."""
    return events.groupBy(*keys).agg(F.sum(F.lit(1) if increment is None else increment).cast("long").alias("count"))


def last_values(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The last value of each key by event time (update or complete mode)."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "seq")).alias(value))


def bucket_counts(events: DataFrame, keys: list[str], period: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window; append mode gives a window once it is closed."""
    window = F.window("event_time", period, slide) if slide else F.window("event_time", period)
    return events.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("count")).select(*keys, F.unix_millis("w.start").alias("bucket"), "count")


def distinct_events(events: DataFrame, id_col: str = "id") -> DataFrame:
    """Each event once within the watermark."""
    return events.dropDuplicatesWithinWatermark([id_col])


SESSION = "ranking string, ts long, items array<string>, clicked array<string>, types array<string>, late boolean"
_STATE = "ts long, last long, items string, clicked string, types string"
_SEP = "\x1f"


def session_join(events: DataFrame, gap_ms: int = 30 * 60_000) -> DataFrame:
    """Click-throughs of a stream of rankings and interactions (append mode): ranking, ts, items, clicked and types (newest first), late.

    events: kind (ranking or interaction), ranking, ts, seq, item, type, items, event_time with a watermark. A ranking's state lives until gap_ms of
    event time without interactions; interactions without a live ranking come out as click-throughs of their own, late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def flush() -> None:
            ts, _, items, clicked, types = state.get
            if clicked:
                out.append((key[0], ts, items.split(_SEP), clicked.split(_SEP)[::-1], types.split(_SEP)[::-1], False))
            state.remove()

        if state.hasTimedOut:
            flush()
        else:
            for pdf in batches:
                for r in pdf.sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
                    if state.exists and r.ts - state.get[1] >= gap_ms:
                        flush()
                    if r.kind == "ranking":
                        state.update((int(r.ts), int(r.ts), _SEP.join(r.items), "", ""))
                    elif state.exists:
                        ts, _, items, clicked, types = state.get
                        state.update((ts, int(r.ts), items, f"{clicked}{_SEP}{r.item}" if clicked else r.item, f"{types}{_SEP}{r.type}" if types else r.type))
                    else:
                        out.append((key[0], int(r.ts), [r.item], [r.item], [r.type], True))
            if state.exists:
                state.setTimeoutTimestamp(max(state.get[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ranking", "ts", "items", "clicked", "types", "late"])

    return events.groupBy("ranking").applyInPandasWithState(run, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def to_latest(keys: list[str], path: str):
    """A foreachBatch writer that keeps a folder a batch of changed values; readers take the last batch of each key. Running a batch again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return write


def latest(spark, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("part")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")

"""Scalar, array and date functions of feature extractors, as Spark columns (no Python in the plan).

Missing values are NULL inside frames; they become NaN only where a matrix is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_age(request_ms: Column, updated_ms: Column) -> Column:
    """Whole seconds between the request and the update, whichever comes first."""
    return F.floor(F.abs(request_ms - updated_ms) / 1000).cast("double")


def word_count(text: Column) -> Column:
    """Parts between runs of whitespace; an empty text is one part, whitespace alone none; a leading space makes an empty first part, trailing ones none."""
    parts = F.size(F.split(F.regexp_replace(text, r"\s+$", ""), r"\s+"))
    return F.when(text == "", F.lit(1)).when(text.rlike(r"^\s+$"), F.lit(0)).otherwise(parts).cast("double")


def onehot(values: Column, vocabulary: list[str]) -> Column:
    """1.0 for each vocabulary entry among the values (an array); values outside it are ignored; NULL gives zeros."""
    return F.array(*(F.coalesce(F.array_contains(values, v), F.lit(False)).cast("double") for v in vocabulary))


def category_index(values: Column, vocabulary: list[str]) -> Column:
    """Position from 1 of the first value in the vocabulary; 0 for others and for missing."""
    words = F.array(*(F.lit(v) for v in vocabulary))
    return F.coalesce(F.array_position(words, F.get(values, F.lit(0))), F.lit(0)).cast("int")


def _or_zero(x: Column, value: Column) -> Column:
    return F.when(F.size(x) > 0, value).otherwise(F.lit(0.0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


#: Reductions of a vector (array of double) to numbers; an empty vector gives 0.0.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "first": lambda x: _or_zero(x, F.get(x, F.lit(0))),
    "last": lambda x: _or_zero(x, F.try_element_at(x, F.lit(-1))),
    "min": lambda x: _or_zero(x, F.array_min(x)),
    "max": lambda x: _or_zero(x, F.array_max(x)),
    "avg": lambda x: _or_zero(x, _total(x) / F.greatest(F.size(x), F.lit(1))),
    "sum": _total,
    "size": lambda x: F.size(x).cast("double"),
    "euclidean_distance": lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)),
    "random": lambda x: _or_zero(x, F.get(x, F.floor(F.rand(42) * F.size(x)).cast("int"))),
}

DEFAULT_REDUCERS = ("min", "max", "size", "avg")


def first_n(x: Column, n: int) -> Column:
    """The first n values, filled up with 0.0."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def reduced(x: Column, reducers: tuple[str, ...] = DEFAULT_REDUCERS) -> Column:
    """The reductions of a vector side by side; vectorN takes the first N values."""
    parts = [first_n(x, int(r.removeprefix("vector"))) if r.startswith("vector") else F.array(REDUCERS[r](x)) for r in reducers]
    return F.concat(*parts)


#: Numbers from a wall-clock time (timestamp without zone).
TIME_MAPPERS: dict[str, Callable[[Column], Column]] = {
    "time_of_day": lambda t: (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double") / 3600,
    "day_of_week": lambda t: (F.weekday(t) + 1).cast("double"),
    "month_of_year": lambda t: F.month(t).cast("double"),
    "year": lambda t: F.year(t).cast("double"),
    "second": lambda t: F.unix_seconds(t.cast("timestamp")).cast("double"),
}


def wall_clock(iso: Column) -> Column:
    """The local part of an ISO date-time with an offset, as a timestamp without zone."""
    return F.try_to_timestamp(F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def event_millis(value: Column) -> Column:
    """The timestamp of an event: an ISO date-time with zone, or milliseconds as digits; else NULL."""
    digits = value.rlike(r"^-?\d+$")
    return F.coalesce(F.when(digits, value.try_cast("bigint")), F.unix_millis(F.try_to_timestamp(F.when(~digits, value))))


def state_millis(value: Column) -> Column:
    """The timestamp of a stored value: 9 or 10 digits are seconds, 12 or 13 milliseconds, else yyyy-MM-dd HH:mm:ss in UTC; anything else NULL."""
    n = F.when(value.rlike(r"^\d+$"), F.length(value))
    return F.when(n.isin(9, 10), value.try_cast("bigint") * 1000).when(n.isin(12, 13), value.try_cast("bigint")).when(n.isNull(), F.unix_millis(F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss"))))


def period_start(ts_ms: Column, period_ms: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(period_ms))


def duration_ms(text: str) -> int:
    """Milliseconds of a number with s, m, h or d."""
    return int(text[:-1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[text[-1]]


def noise(*keys: str, seed: int = 42) -> Column:
    """A number from 0 up to 1 by a hash of the keys: the same in every run, however rows are dealt. NULL keys count as empty."""
    name = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))

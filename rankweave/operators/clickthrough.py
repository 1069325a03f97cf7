"""Click-throughs: rankings joined with their interactions by sessions, impressions, labels, matrices, selectors, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_MS = 30 * 60_000


def sessions(clicks: DataFrame, gap_ms: int = SESSION_MS) -> DataFrame:
    """clicks (ranking, ts, seq, shown: when the ranking was) with in_session: no gap of gap_ms or more since the ranking, from click to click.

    Every click renews the session; after the first gap all later ones are out. Clicks without a ranking, or of an unknown one (shown is NULL), are out;
    they get a key of their own each, as a common one would put them all in one task.
    """
    lone = F.when(F.col("shown").isNull(), F.xxhash64("ts", "seq"))
    order = Window.partitionBy("ranking", lone).orderBy("ts", "seq")
    before = F.coalesce(F.lag("ts").over(order), F.col("shown"))
    broken = (F.col("ts") - before >= gap_ms) | F.col("shown").isNull() | (F.col("ts") < F.col("shown"))
    return clicks.withColumn("_broken", broken.cast("int")).withColumn("in_session", F.col("ranking").isNotNull() & (F.max("_broken").over(order) == 0)).drop("_broken")


def clickthroughs(rankings: DataFrame, clicks: DataFrame, gap_ms: int = SESSION_MS) -> DataFrame:
    """One row a ranking with interactions in session (id, ts, items, interactions newest first), and one a late or single interaction.

    rankings: ranking, ts, items (array in order). clicks: ranking, item, type, ts, seq.
    """
    # The ranking's row goes along with its clicks, so one shuffle serves the join, the sessions and the lists.
    known = clicks.select("ranking", "item", "type", "ts", "seq").join(rankings.select("ranking", F.col("ts").alias("shown"), "items"), "ranking", "left")
    marked = sessions(known, gap_ms)
    newest = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "item", "type")), asc=False), lambda x: F.struct(x["item"].alias("item"), x["type"].alias("type")))
    inside = marked.where("in_session").groupBy("ranking").agg(F.first("shown").alias("ts"), F.first("items").alias("items"), newest.alias("interactions"))
    joined = inside.select(F.col("ranking").cast("string").alias("id"), "ts", "items", "interactions")
    single = marked.where(~F.col("in_session")).select(F.concat_ws(":", "ranking", "item", "ts", "seq").alias("id"), "ts", F.array("item").alias("items"), F.array(F.struct("item", "type")).alias("interactions"))
    return joined.unionByName(single)


def impressions(rows: DataFrame, clicks: DataFrame) -> DataFrame:
    """Items of a ranking up to its last clicked position, as interactions of type impression; clicks on items not shown don't count."""
    # A repeated item counts at its last position.
    last = clicks.select("ranking", "item").distinct().join(rows.groupBy("ranking", "item").agg(F.max("pos").alias("pos")), ["ranking", "item"]).groupBy("ranking").agg(F.max("pos").alias("_last"))
    return rows.join(last, "ranking").where(F.col("pos") <= F.col("_last")).select("ranking", "ts", "pos", "item", F.lit("impression").alias("type"))


def labels(rows: DataFrame, clicks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with label: the weight of the newest interaction's type with the item (0 for other types and without interactions); explicit ones are types rel0, rel1 and so on."""
    weight = F.lit(0.0)
    for kind, w in weights.items():
        weight = F.when(F.col("_type") == kind, F.lit(float(w))).otherwise(weight)
    weight = F.when(F.col("_type").rlike("^rel[0-9]+$"), F.substring("_type", 4, 10).cast("double")).otherwise(weight)
    newest = clicks.groupBy("ranking", "item").agg(F.max_by("type", F.struct("ts", "seq")).alias("_type"))
    return rows.drop("label").join(newest, ["ranking", "item"], "left").withColumn("label", F.coalesce(weight, F.lit(0.0))).drop("_type")


def explicit_labels(rows: DataFrame) -> DataFrame:
    """Interactions rel<N> of the rankings that have any labelled item."""
    some = F.max(F.col("label").isNotNull().cast("int")).over(Window.partitionBy("ranking"))
    return rows.withColumn("_some", some).where((F.col("_some") == 1) & F.col("label").isNotNull()).select("ranking", "item", F.concat(F.lit("rel"), F.col("label").cast("string")).alias("type"), "ts", F.col("pos").alias("seq"))


def vectorize(rows: DataFrame, features: list[Column], out: str = "features") -> DataFrame:
    """rows with one dense array, in the order of features (double or array of double); missing numbers become NaN here and only here."""
    parts = []
    for f in features:
        is_array = rows.select(f.alias("x")).schema["x"].dataType.typeName() == "array"
        parts.append(F.transform(f, lambda v: F.coalesce(v, F.lit(float("nan")))) if is_array else F.array(F.coalesce(f.cast("double"), F.lit(float("nan")))))
    return rows.withColumn(out, F.concat(*parts))


# Selectors: predicates on click-throughs with items, interactions (array of struct item, type) and ranking fields.


def accept() -> Column:
    return F.lit(True)


def field_is(field: Column, value: str) -> Column:
    return F.coalesce(field == value, F.lit(False))


def field_has(field: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(field, value), F.lit(False))


def ranking_length(low: int = 0, high: int = 2**31 - 1, items: str = "items") -> Column:
    return F.size(items).between(low, high)


def positions_within(low: int = 0, high: int = 2**31 - 1, items: str = "items", interactions: str = "interactions") -> Column:
    """All interactions with known items are at positions (from 0) within the bounds."""
    return F.forall(F.transform(F.filter(interactions, lambda x: F.array_contains(items, x["item"])), lambda x: F.array_position(F.col(items), x["item"]) - 1), lambda p: (p >= low) & (p <= high))


def sampled(ratio: float, *keys: str, seed: int = 42) -> Column:
    """About this share of rows, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(ratio * 1_000_000)


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def none_of(part: Column) -> Column:
    return ~part


def usable(selector: Column, interactions: str = "interactions", values: str = "items") -> Column:
    """What a training set takes: selected, with interactions and values."""
    return selector & (F.size(interactions) > 0) & (F.size(values) > 0)


# Splits into train and test.


def _nth_value(rows: DataFrame, value: Column, n: int, few: int = 20_000) -> tuple[Column, int, int]:
    """Of the rows' values (numbers): the n-th smallest (from 1) as a condition-ready literal, the number of rows below it, and of those that equal it.

    Histograms of 1,024 bins narrow the range around it, so the driver sees counts and then at most few values.
    """
    inside, below = rows.select(value.cast("double").alias("_v")), 0
    while True:
        low, high, count = inside.agg(F.min("_v"), F.max("_v"), F.count("*")).first()
        if low == high or count <= few:
            break
        bin_of = F.floor((F.col("_v") - low) / (high - low) * 1024)
        counts = sorted(inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect())
        for b, size in counts:
            if n <= below + size:
                inside = inside.where(bin_of == b)
                break
            below += size
    if low == high:
        return F.lit(low), below, count
    every = sorted(r[0] for r in inside.collect())
    found = every[n - below - 1]
    return F.lit(found), below + every.index(found), every.count(found)


def split_time(rows: DataFrame, order: list[str], ratio: float = 0.8) -> DataFrame:
    """rows with part: the first round(n * ratio) in order are train. One row is both (two rows come back); of two, one each.

    order: columns of numbers or times, without NULLs. The cut is found as a value, column by column, so rows are neither sorted nor shuffled. Rows with
    the cut's own values in all of order are told apart by a hash of all columns; only those that repeat each other in full are counted off in one task.
    """
    n = rows.count()
    if n == 0:
        raise ValueError("nothing to split")
    if n == 1:
        return rows.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))
    left = 1 if n == 2 else max(int(n * ratio + 0.5), 1)

    def number(c: str) -> Column:
        kind = rows.schema[c].dataType.typeName()
        return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(c)

    before, equal, same = F.lit(False), F.lit(True), n
    for value in (*(number(c) for c in order), F.shiftrightunsigned(F.xxhash64(*rows.columns), 12)):
        value = value.cast("double")
        cut, below, same = _nth_value(rows.where(equal), value, left)
        before, equal, left = before | (equal & (value < cut)), equal & (value == cut), left - below
        if same == left:
            return rows.withColumn("part", F.when(before | equal, "train").otherwise("test"))
    ties = rows.where(equal).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    apart = rows.where(~equal).withColumn("part", F.when(before, "train").otherwise("test"))
    return apart.unionByName(ties.withColumn("part", F.when(F.col("_n") <= left, "train").otherwise("test")).drop("_n"))


def split_random(rows: DataFrame, keys: list[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    return rows.withColumn("part", F.when(sampled(ratio, *keys, seed=seed), "train").otherwise("test"))


def split_hold_last(rows: DataFrame, user: str, order: list[str], ratio: float = 0.8) -> DataFrame:
    """Of each user, the first round(n * ratio) are train."""
    nth = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    return rows.withColumn("part", F.when(nth <= F.floor(n * ratio + 0.5), "train").otherwise("test"))


def split_field(rows: DataFrame, field: str, train: str, test: str) -> DataFrame:
    """Rows of other values of the field are in neither part."""
    return rows.withColumn("part", F.when(F.col(field) == train, "train").when(F.col(field) == test, "test")).where(F.col("part").isNotNull())

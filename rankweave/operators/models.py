"""Recommenders and rankers: trending, similar items (exact kNN, ALS), no-op and shuffle, and a boosted-tree LambdaMART baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DAY = 86_400_000


def trending(clicks: DataFrame, weights: dict[str, float], decay: float, window_days: int, now_ms: Column | None = None) -> DataFrame:
    """item, score: for each type, the sum over days of count * decay^age, times its weight, of events newer than the window before now (the last event)."""
    now = clicks.agg(F.max("ts").alias("_now")) if now_ms is None else clicks.select(now_ms.alias("_now")).limit(1)
    weight = F.lit(0.0)
    for kind, w in weights.items():
        weight = F.when(F.col("type") == kind, F.lit(float(w))).otherwise(weight)
    aged = clicks.where(F.col("type").isin(*weights)).crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("_now") - window_days * DAY)  # now is one row
    days = aged.groupBy("item", "type", F.floor((F.col("_now") - F.col("ts")) / DAY).alias("age")).agg(F.count("*").alias("n"))
    return days.groupBy("item").agg(F.sum(F.col("n") * F.pow(F.lit(decay), "age") * weight).alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """For each query (query, vector, exclude: array of ids), the k most cosine-similar vectors (id, vector): query, id, score, rank.

    Queries are a stated, bounded set (they are collected in blocks and sent to all vectors, which stay where they are). Each
    task keeps k per query, so k * tasks rows a query are shuffled, however many vectors there are. Equal scores: smaller id first.
    """
    rows = queries.select("query", "vector", "exclude").toLocalIterator()
    parts: list[DataFrame] = []
    kind = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"

    def search(block: list) -> DataFrame:
        names = [r["query"] for r in block]
        matrix = np.array([r["vector"] for r in block], np.float64)
        norms = np.sqrt((matrix**2).sum(axis=1))
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix, norms, [set(r["exclude"] or []) for r in block]))

        def run(batches):
            names, matrix, norms, exclude = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            for pdf in batches:
                x = np.array(pdf["vector"].tolist(), np.float64)
                own = np.sqrt((x**2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = (matrix @ x.T) / (norms[:, None] * own[None, :])
                ids = pdf["id"].to_numpy()
                scores[np.isnan(scores)] = -np.inf
                for q in range(len(names)):
                    # All that may be among the k, ties with the last included, however many are excluded.
                    most = k + len(exclude[q])
                    near = np.flatnonzero(scores[q] >= np.partition(scores[q], -most)[-most]) if len(ids) > most else np.arange(len(ids))
                    found = [(-s, i) for s, i in zip(scores[q][near].tolist(), ids[near].tolist(), strict=True) if s != -np.inf and i not in exclude[q]]
                    best[q] = sorted(best[q] + found)[:k]
            yield pd.DataFrame([(names[q], i, -s) for q in range(len(names)) for s, i in best[q]], columns=["query", "id", "score"])

        return vectors.select("id", "vector").mapInPandas(run, kind)

    block: list = []
    for r in rows:
        block.append(r)
        if len(block) >= 1000:
            parts.append(search(block))
            block = []
    parts.append(search(block)) if block or not parts else None
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def centroid(vectors: DataFrame, groups: list[str]) -> DataFrame:
    """The mean vector of each group, by dimension."""
    each = vectors.select(*groups, F.posexplode("vector").alias("_i", "_v")).groupBy(*groups, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return each.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("vector"))


def numbered(values: DataFrame, column: str, out: str, slots: int = 4096) -> DataFrame:
    """Distinct values with a whole number each from 0: values fall in slots by hash, a slot's first number comes from the small table of slots."""
    dealt = values.withColumn("_slot", F.pmod(F.xxhash64(column), F.lit(slots)))
    sizes = dealt.groupBy("_slot").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select("_slot", F.coalesce("_first", F.lit(0)).alias("_first"))  # a row a slot
    nth = F.row_number().over(Window.partitionBy("_slot").orderBy(column)) - 1
    return dealt.withColumn("_nth", nth).join(F.broadcast(first), "_slot").select(column, (F.col("_first") + F.col("_nth")).cast("int").alias(out))  # slots rows at most


def als_vectors(clicks: DataFrame, types: list[str], rank: int = 16, seed: int = 42, iterations: int = 8) -> DataFrame:
    """Item vectors (id, vector) of implicit-feedback ALS over (user, item) counts of these types. Ids are numbered in their order, without passing through the driver."""
    from pyspark.ml.recommendation import ALS

    typed = clicks.where(F.col("type").isin(*types) & F.col("user").isNotNull() & F.col("item").isNotNull()).groupBy("user", "item").agg(F.count("*").cast("double").alias("rating"))
    for c in ("user", "item"):
        typed = typed.join(numbered(typed.select(c).distinct(), c, f"_{c}"), c)
    model = ALS(userCol="_user", itemCol="_item", ratingCol="rating", implicitPrefs=True, rank=rank, seed=seed, maxIter=iterations).fit(typed)
    return model.itemFactors.withColumnRenamed("id", "_item").join(typed.select("_item", F.col("item").alias("id")).distinct(), "_item").select("id", F.col("features").cast("array<double>").alias("vector"))


def similar_items(vectors: DataFrame, ids: list, k: int) -> DataFrame:
    """Items most like the centroid of the given ones, which are left out; unknown ids are passed over."""
    given = vectors.where(F.col("id").isin(*ids)).withColumn("query", F.lit("all"))
    query = centroid(given.select("query", "vector"), ["query"]).withColumn("exclude", F.array(*(F.lit(i) for i in ids)))
    return nearest(query, vectors, k)


def co_clicked(clicks: DataFrame, types: list[str], least: int = 1, block: int = 1000) -> DataFrame:
    """a, b, n: pairs of items that the same user interacted with, of all of a user's distinct items. Lists of more than about block items are dealt out in blocks."""
    own = clicks.where(F.col("type").isin(*types)).select("user", "item").distinct()
    blocks = own.groupBy("user").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    own = own.join(blocks, "user")
    left = own.select("user", F.col("item").alias("a"), F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int").alias("_block"))
    right = own.select("user", F.col("item").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    pairs = left.join(right, ["user", "_block"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def noop_scores() -> Column:
    return F.lit(0.0)


def shuffle_scores(pos: Column, m: int, *keys: str, seed: int = 42) -> Column:
    """The position plus noise of up to m either way, the same in every run."""
    return pos + (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / 1_000_003.0 * 2 - 1) * m


def random_items(clicks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample of n distinct items that were seen, the same in every run."""
    return clicks.select("item").distinct().orderBy(F.xxhash64(F.lit(seed), "item"), "item").limit(n)


def _gradients(label: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """LambdaMART's gradients and weights of one ranking."""
    place = np.empty(len(label), int)
    place[np.argsort(-score, kind="stable")] = np.arange(len(label))
    discount = np.where(place < k, 1 / np.log2(place + 2), 0.0)
    gain = 2.0**label - 1
    ideal = (np.sort(gain)[::-1][:k] / np.log2(np.arange(min(k, len(gain))) + 2)).sum() or 1.0
    delta = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    p = 1 / (1 + np.exp(np.clip(score[:, None] - score[None, :], -35, 35)))
    better = label[:, None] > label[None, :]
    push, curve = np.where(better, p * delta, 0.0), np.where(better, p * (1 - p) * delta, 0.0)
    return push.sum(axis=1) - push.sum(axis=0), curve.sum(axis=1) + curve.sum(axis=0)


def pair_gradients(rows: DataFrame, k: int = 10) -> DataFrame:
    """rows (ranking, label, score, ...) with target (lambda) and weight at the present scores, ranking by ranking.

    A ranking is a bounded list: its pairs are made in one task. Rows stream through tasks in order of ranking, so no task holds more than a batch and a ranking.
    """
    names = [c for c in rows.columns if c not in ("target", "weight")]
    schema = rows.select(*names).schema.add("target", "double").add("weight", "double")

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        label, score = pdf["label"].to_numpy(float), pdf["score"].to_numpy(float)
        starts = np.flatnonzero(np.append(True, (pdf["ranking"].to_numpy()[1:] != pdf["ranking"].to_numpy()[:-1])))
        target, weight = np.zeros(len(pdf)), np.zeros(len(pdf))
        for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            target[a:b], weight[a:b] = _gradients(label[a:b], score[a:b], k)
        return pdf.assign(target=target, weight=weight)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["ranking"] == pdf["ranking"].iloc[-1] if len(pdf) else pdf.index < 0
            rest = pdf[last]
            if not last.all():
                yield done(pdf[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield done(rest.reset_index(drop=True))

    return rows.select(*names).repartition("ranking").sortWithinPartitions("ranking").mapInPandas(run, schema)


class LambdaMART:
    """Boosting of regression trees on LambdaMART gradients: MLlib grows each tree distributed over all rows; leaves take Newton steps by weights."""

    def __init__(self, rounds: int = 10, depth: int = 4, rate: float = 0.1, k: int = 10, seed: int = 42):
        self.rounds, self.depth, self.rate, self.k, self.seed = rounds, depth, rate, k, seed
        self.trees: list = []

    def _assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("_x", array_to_vector(F.transform("features", lambda v: F.nanvl(v, F.lit(-1e9)))))

    def fit(self, rows: DataFrame) -> LambdaMART:
        """rows: ranking, label, features (array of double)."""
        from pyspark.ml.regression import DecisionTreeRegressor

        base = self._assembled(rows.select("ranking", "label", "features", F.monotonically_increasing_id().alias("_row"))).cache()
        scored = base.select("ranking", "label", "_row", "features").withColumn("score", F.lit(0.0))
        try:
            for _ in range(self.rounds):
                steps = pair_gradients(scored.select("ranking", "label", "_row", "features", "score"), self.k)
                ready = self._assembled(steps).withColumn("_y", F.when(F.col("weight") > 1e-9, F.col("target") / F.col("weight")).otherwise(0.0)).withColumn("_w", F.greatest("weight", F.lit(1e-9)))
                tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=self.depth, seed=self.seed).fit(ready)
                self.trees.append(tree)
                scored = self.score(base.select("ranking", "label", "_row", "features"))
        finally:
            base.unpersist()
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        found = self._assembled(rows).withColumn(out, F.lit(0.0))
        for i, tree in enumerate(self.trees):
            found = tree.copy({tree.predictionCol: f"_p{i}"}).transform(found)
        total = F.lit(0.0)
        for i in range(len(self.trees)):
            total = total + self.rate * F.col(f"_p{i}")
        return found.withColumn(out, total).select(*rows.columns, out)

    def importances(self) -> list[float]:
        """Mean importance of each feature."""
        return list(np.mean([t.featureImportances.toArray() for t in self.trees], axis=0)) if self.trees else []



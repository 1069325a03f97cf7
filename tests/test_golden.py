"""Known values on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from rankweave.functions import scalar as S
from rankweave.functions import text as T
from rankweave.operators import clickthrough as C
from rankweave.operators import features, pit, state
from rankweave.operators import metrics as M
from rankweave.operators import models
from rankweave.plans import config

DAY = 86_400_000


def one(df):
    return df.first()[0]


def writes(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "item string, type string, ts long, seq long")


def test_rate(spark):
    rows = writes(spark, [("p1", "impression", 1)] * 4 + [("p1", "click", 2)])
    assert features.rate(rows, ["item"], "click", "impression", DAY, [7, 14]).collect()[0]["rates"] == [0.25, 0.25]


def test_rate_without_tops_is_missing(spark):
    rows = writes(spark, [("p1", "impression", 1), ("p2", "impression", 1), ("p2", "click", 1)])
    assert [r["item"] for r in features.rate(rows, ["item"], "click", "impression", DAY, [7]).collect()] == ["p2"]


def test_normalised_rate(spark):
    rows = writes(spark, [("p1", "i", 1)] * 3 + [("p1", "c", 1)] + [("p2", "i", 1)] * 90 + [("p2", "c", 1)] * 9)
    found = {r["item"]: r["rates"][0] for r in features.normalised_rate(rows, ["item"], "c", "i", DAY, [7], 10.0).collect()}
    assert found["p1"] == pytest.approx(0.11827956989247312)


def test_periodic_counter_has_both_ends(spark):
    rows = writes(spark, [("a", "x", d * DAY) for d in range(10)])
    assert state.periodic_counter(rows, ["item"], DAY, [0, 7]).collect()[0]["counts"] == [1, 8]
    weekly = writes(spark, [("a", "x", d * 7 * DAY) for d in range(10)])
    assert state.periodic_counter(weekly, ["item"], DAY, [0, 7]).collect()[0]["counts"] == [1, 2]


@pytest.mark.parametrize(("prices", "top", "want"), [([10, 20, 40, 15, 5], 20, [-5, 5, 25, 0, -10]), ([10, 20, 30, 5, 1], 3, [-10, 0, 10, -15, -19])])
def test_diversity_number(spark, prices, top, want):
    rows = spark.createDataFrame([("r", i, float(p)) for i, p in enumerate(prices)], "ranking string, pos int, price double")
    assert [r["diversity"] for r in features.diversity_number(rows, "ranking", "pos", "price", top).orderBy("pos").collect()] == want


@pytest.mark.parametrize(("values", "want"), [([["a"], ["b"], ["c"], ["a"], ["b"]], [0.4, 0.4, 0.2, 0.4, 0.4]), ([["a"], ["b", "c"], ["a", "b", "c"], ["a", "b", "c", "d"]], [0.3, 0.6, 0.9, 1.0])])
def test_diversity_string(spark, values, want):
    rows = spark.createDataFrame([("r", i, str(i), v) for i, v in enumerate(values)], "ranking string, pos int, item string, v array<string>")
    found = [r["diversity"] for r in features.diversity_string(rows, "ranking", "pos", "item", "v").orderBy("pos").collect()]
    assert found == pytest.approx(want)


def test_interacted_with(spark):
    history = spark.createDataFrame([("u", "p1", 1, 1), ("u", "p2", 2, 2)], "user string, item string, ts long, seq long")
    fields = spark.createDataFrame([("p1", ["red"]), ("p2", ["green"]), ("p3", ["blue"])], "item string, values array<string>")
    asked = spark.createDataFrame([("u", "p1"), ("u", "p2"), ("u", "p3")], "user string, item string")
    assert [r["score"] for r in features.interacted_with(asked, history, fields, "user", "item").orderBy("item").collect()] == [1, 1, 0]


def test_reducers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(S.reduced(F.col("x"))).collect()] == [[1, 3, 3, 2], [0, 0, 0, 0]]
    assert df.select(S.reduced(F.col("x"), ("vector5", "first", "last", "sum"))).first()[0] == [1, 2, 3, 0, 0, 1, 3, 6]


def test_words(spark):
    df = spark.createDataFrame([("",), (" a b ",), ("one",), ("  ",)], "t string")
    assert [r[0] for r in df.select(S.word_count(F.col("t"))).collect()] == [1, 3, 1, 0]


def test_text(spark):
    df = spark.createDataFrame([("fooba foo", ["a"], ["a", "b"])], "t string, a array<string>, b array<string>")
    assert one(df.select(T.ngrams(T.terms(F.col("t")), 3))) == ["foo", "oba", "oob"]
    assert one(df.select(T.jaccard(F.col("a"), F.col("b")))) == 0.5
    dfs = F.create_map(*(F.lit(x) for kv in {"foo": 1, "bar": 2, "baz": 3}.items() for x in kv))
    score = lambda q, d: one(df.select(T.bm25(F.array(*map(F.lit, q)), F.array(*map(F.lit, d)), F.lit(3), F.lit(3.0), dfs)))
    assert score(["baz"], ["bar", "baz"]) == pytest.approx(0.15, abs=0.01)
    assert score(["foo"], ["foo"]) == pytest.approx(1.34, abs=0.01)
    assert df.select(T.english_terms(F.lit("The runners were running quickly to nations"))).first()[0][1] == "were"


def test_term_frequencies(spark):
    docs = spark.createDataFrame([("hello hello world foo", "hello world bar")], "a string, b string")
    stats, df = T.term_frequencies(docs, ["a", "b"])
    assert tuple(stats.first()) == (1, 3.0)
    assert {r["term"]: r["df"] for r in df.collect()} == {"hello": 1, "world": 1, "foo": 1, "bar": 1}


def test_normalisers(spark):
    df = spark.createDataFrame([("r", float(v)) for v in (1, 4, 3, 2, 5)], "ranking string, v double")
    assert sorted((r["v"], r["n"]) for r in df.withColumn("n", features.rank_share(F.col("v"), "ranking")).collect()) == [(1, 0), (2, 0.2), (3, 0.4), (4, 0.6), (5, 0.8)]
    assert [r[0] for r in df.where("v < 4").orderBy("v").select(features.minmax(F.col("v"), "ranking")).collect()] == [0, 0.5, 1]


def test_kendall(spark):
    rows = [("a", i, o) for i, o in enumerate([0, 2, 1, 3])] + [("b", i, 3 - i) for i in range(4)]
    found = {r["ranking"]: r["kendall"] for r in M.kendall(spark.createDataFrame(rows, "ranking string, pos int, other int")).collect()}
    assert found["a"] == pytest.approx(0.666, abs=0.01) and found["b"] == -1


def test_impressions(spark):
    rows = spark.createDataFrame([("r", 0, i, f"p{i + 1}") for i in range(4)], "ranking string, ts long, pos int, item string")
    for clicks, want in (["p2"], 2), (["p3", "p1"], 3), (["p5"], 0):
        asked = spark.createDataFrame([("r", c) for c in clicks], "ranking string, item string")
        assert C.impressions(rows, asked).count() == want


@pytest.mark.parametrize(("days", "want"), [([0, 0, 0], 3), ([0, 1], 1.5)])
def test_trending(spark, days, want):
    clicks = spark.createDataFrame([("p2", "click", 10 * DAY - d * DAY) for d in days], "item string, type string, ts long")
    assert one(models.trending(clicks, {"click": 1.0}, 0.5, 5).select("score")) == want


def test_time_split(spark):
    rows = lambda n: spark.createDataFrame([(i,) for i in range(n)], "ts long")
    count = lambda n: {r["part"]: r["count"] for r in C.split_time(rows(n), ["ts"]).groupBy("part").count().collect()}
    assert count(1) == {"train": 1, "test": 1} and count(2) == {"train": 1, "test": 1} and count(3) == {"train": 2, "test": 1} and count(100) == {"train": 80, "test": 20}
    with pytest.raises(ValueError):
        C.split_time(rows(0), ["ts"])


def test_timestamps(spark):
    df = spark.createDataFrame([("1671200049",), ("1671200049000",), ("2022-12-16 14:14:09",), ("foo",), ("16712000490",)], "t string")
    assert [r[0] for r in df.select(S.state_millis(F.col("t"))).collect()] == [1671200049000, 1671200049000, 1671200049000, None, None]
    events = spark.createDataFrame([("1671200049000",), ("2022-12-16T14:14:09Z",), ("x",)], "t string")
    assert [r[0] for r in events.select(S.event_millis(F.col("t"))).collect()] == [1671200049000, 1671200049000, None]


def test_point_in_time_is_strictly_before(spark):
    w = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 5, 2, 20.0)], "item string, ts long, seq long, value double")
    p = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 6, 3), ("b", 9, 9)], "item string, ts long, seq long")
    assert [r["value"] for r in pit.as_of_last(p, w, ["item"]).orderBy("ts").collect()] == [None, 10, 20, None]


def test_map_state_deletes(spark):
    w = spark.createDataFrame([("u", "a", "1", 1, 1), ("u", "a", None, 2, 2), ("u", "b", "2", 1, 3), ("v", "a", None, 1, 4)], "user string, entry string, value string, ts long, seq long")
    assert [tuple(r) for r in state.map_state(w, ["user"]).collect()] == [("u", {"b": "2"})]


def test_session_doesnt_reopen(spark):
    m = 60_000
    clicks = spark.createDataFrame([("r", 10 * m, 0, 0), ("r", 35 * m, 1, 0), ("r", 65 * m, 2, 0), ("r", 66 * m, 3, 0)], "ranking string, ts long, seq long, shown long")
    assert [r["in_session"] for r in C.sessions(clicks).orderBy("ts").collect()] == [True, True, False, False]


def test_label_of_newest(spark):
    rows = spark.createDataFrame([("r", "a"), ("r", "b")], "ranking string, item string")
    clicks = spark.createDataFrame([("r", "a", "purchase", 1, 1), ("r", "a", "click", 2, 2)], "ranking string, item string, type string, ts long, seq long")
    assert [r["label"] for r in C.labels(rows, clicks, {"click": 1, "purchase": 5}).orderBy("item").collect()] == [1, 0]


def test_ndcg(spark):
    rows = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 0.0)], "ranking string, pos int, label double")
    assert {r["ranking"]: round(r["ndcg"], 6) for r in M.ndcg(rows).collect()} == {"a": round(1 / math.log2(3), 6), "b": 1.0}


def test_lambdamart_learns(spark):
    rows = spark.createDataFrame([(f"r{i}", float(j % 2), [float(j % 2), float(i)]) for i in range(30) for j in range(4)], "ranking string, label double, features array<double>")
    model = models.LambdaMART(rounds=2, depth=2).fit(rows)
    low, high = (one(model.score(rows).where(F.col("label") == v).agg(F.avg("score"))) for v in (0, 1))
    assert high > low and model.importances()[0] > 0.9


def test_config():
    plan = config.load({"features": [{"name": "p", "type": "number", "source": "metadata.price", "scope": "item"}, {"name": "c", "type": "rate", "periods": [7, 30], "bucket": "24h"}, {"name": "v", "type": "vector", "reduce": ["vector3", "min"]}], "models": {"m": {"features": ["c", "v", "p"]}}})
    assert plan.width("m") == {"c": (0, 2), "v": (2, 4), "p": (6, 1)}
    assert plan.features["p"].source == config.FieldRef("item", "price") and plan.features["c"].refresh_ms == 3_600_000
    assert config.field_ref("interaction:click.x") == config.FieldRef("interaction", "x", "click")
    for bad in ({"features": [{"name": "a", "type": "nothing"}]}, {"models": {"m": {"features": ["x"]}}}, {"features": [{"name": "a", "type": "number", "scope": "planet"}]}):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_split_time_of_many_rows(spark):
    """The exact number of train rows, none after the cut, at a size that a range partitioning only samples; with few times, ties and whole copies."""
    n = 400_000
    rows = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("ts"), "id")
    found = C.split_time(rows, ["ts"]).groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    found = {r["part"]: r for r in found.collect()}
    assert found["train"]["n"] == n * 8 // 10 and found["test"]["n"] == n - n * 8 // 10 and found["train"]["high"] <= found["test"]["low"]
    same = C.split_time(spark.range(1000).select(F.lit(5).alias("ts")), ["ts"])
    assert same.where("part = 'train'").count() == 800
    assert C.split_time(spark.range(5001).select((F.col("id") - 2500).alias("ts")), ["ts"]).where("part = 'train'").agg(F.max("ts")).first()[0] == 1500


def test_ordering_errors_across_slots(spark):
    from rankweave.operators import state

    ts = [5, 6, 4, 4, 9, 8, 8, 10, 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "seq long, ts long")
    for span in (1, 2, 3, 1000):
        assert sorted((r["seq"], r["previous"]) for r in state.ordering_errors(rows, span=span).collect()) == [(2, 6), (5, 9), (8, 10)]


def test_ordering_errors_without_ts_or_seq(spark):
    from rankweave.operators import state

    rows = spark.createDataFrame([(0, 9), (1, None), (2, 3), (3, 2), (None, 1)], "seq long, ts long")
    for span in (1, 2, 3, 1000):
        assert sorted((r["ts"], r["previous"]) for r in state.ordering_errors(rows, span=span).collect()) == [(1, 2), (2, 3)]


def test_ordering_guard_of_large_ids(spark, tmp_path):
    """Ids of a million and more, below 0 and NULL are in the order of the SQL."""
    import duckdb

    from rankweave.plans import catalogue

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    id, one = F.col("event_id"), pow(7919, -1, 1_000_003)  # ids further by one are further by 1 in the order
    spread = F.floor(id / 3) * one % 1_000_003 + id * 7 % 10 * 1_000_003 - F.when(id % 5 == 0, 30_000_090).otherwise(0)
    more = events.withColumn("ts", F.when(id % 9 != 0, F.col("ts"))).withColumn("event_id", F.when(id != 50, spread))
    more.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalogue.queries()["ordering_guard"](spark, str(tmp_path)).select("seq", "ts").collect()
    assert len(found) > 20 and sorted(map(tuple, found), key=str) == sorted(db.sql(catalogue.oracle_sql()["ordering_guard"]).fetchall(), key=str)


def test_numbered(spark):
    from rankweave.operators.models import numbered

    found = [r["n"] for r in numbered(spark.range(1000).select(F.col("id").cast("string").alias("x")), "x", "n", slots=16).collect()]
    assert sorted(found) == list(range(1000))


def test_clicks_without_ranking(spark):
    """Each is a click-through of its own."""
    clicks = spark.createDataFrame([(None, "a", "click", 1, 1), (None, "b", "click", 2, 2), ("r", "a", "click", 5, 3), ("x", "a", "click", 6, 4)], "ranking string, item string, type string, ts long, seq long")
    rankings = spark.createDataFrame([("r", 4, ["a"])], "ranking string, ts long, items array<string>")
    assert sorted(r["id"] for r in C.clickthroughs(rankings, clicks).collect()) == ["a:1:1", "b:2:2", "r", "x:a:6:4"]

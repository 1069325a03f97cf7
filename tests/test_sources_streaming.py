"""Files in and out, and streams."""

import json

import pytest


from rankweave.sources import events as E
from rankweave.streaming import folds


def event(**k):
    return {"id": "1", "timestamp": "1000", **k}


def test_json(spark, tmp_path):
    rows = [
        event(event="metadata", item="p1", fields=[{"name": "price", "value": 10}, {"name": "tags", "value": ["a", "b"]}, {"name": "sizes", "value": [1, 2]}, {"name": "on", "value": True}, {"name": "name", "value": "x"}, {"name": "price", "value": 99}]),
        event(event="ranking", user="u", items=[{"id": "p1", "relevancy": 1.0}]),
        event(event="ranking", items=[]),
        event(event="interaction", item="p1", type="click", ranking="1", timestamp="2022-12-16T14:14:09Z"),
        {"event": "user", "timestamp": "1", "user": "u"},
    ]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    (tmp_path / "b.txt").write_text(json.dumps(rows[0]))
    found = {r["event"]: r for r in E.read_json(spark, str(tmp_path)).collect()}
    assert set(found) == {"item", "ranking", "interaction"}
    f = found["item"]["fields"]
    assert (f["price"]["n"], f["tags"]["sl"], f["sizes"]["nl"], f["on"]["b"], f["name"]["s"]) == (10, ["a", "b"], [1, 2], True, "x")
    assert found["interaction"]["ts"] == 1671200049000


def test_json_types(spark, tmp_path):
    """Values have the type that JSON gives them, whatever they look like; rows that can't be taken are set aside with what is wrong."""
    values = {"code": "00123", "truth": "true", "open": "[x", "brace": "{y", "none": "", "n": 1.5, "big": 12345678901, "exp": 1e3, "b": False, "texts": ["1", "true"], "empty": [], "numbers": [1, 2.5], "same": "null"}
    bad = {"mixed": [1, "a"], "null": None, "object": {"a": 1}, "nulls": ["a", None]}
    rows = [event(event="item", item="p", fields=[{"name": n, "value": v} for n, v in values.items()])]
    rows += [event(event="item", id=n, item="p", fields=[{"name": n, "value": v}]) for n, v in bad.items()] + [event(event="spam"), event(event="item", item="p", timestamp="foo")]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    found = E.read_json(spark, str(tmp_path / "a.json"), bad=str(tmp_path / "bad")).collect()
    assert len(found) == 1
    got = {k: next(x for x in v if x is not None) for k, v in found[0]["fields"].items()}
    assert got == {**values, "n": 1.5, "numbers": [1.0, 2.5]} and got["truth"] == "true" and got["b"] is False
    errors = sorted(r["error"] for r in spark.read.json(str(tmp_path / "bad")).collect())
    assert errors == ["field of no known type"] * 4 + ["no event", "no timestamp", "unknown kind of event"]


def test_caches(spark, tmp_path):
    (tmp_path / "e.csv").write_text('text,a,b\n"red, ""fox""",1,0.5\nblue,0,2\n')
    assert sorted(map(tuple, E.read_cache(spark, str(tmp_path / "e.csv"), skip=1).collect())) == [("blue", [0.0, 2.0]), ('red, "fox"', [1.0, 0.5])]
    (tmp_path / "s.csv").write_text("q,p,0.25\n")
    assert [tuple(r) for r in E.read_cache(spark, str(tmp_path / "s.csv"), scores=True).collect()] == [("q", "p", 0.25)]


def test_state_versions(spark, tmp_path):
    """A job that fails leaves the state that was there."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        E.read_state(spark, path)
    E.write_state(spark.range(3), path)
    with pytest.raises(Exception, match="no good"):
        E.write_state(spark.range(5).withColumn("x", F.raise_error(F.lit("no good"))), path)
    assert E.read_state(spark, path).count() == 3
    E.write_state(spark.range(4), path)
    assert E.read_state(spark, path).count() == 4


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([event(event="item", item="a"), event(event="item", item="b")]))
    assert E.read_json(spark, str(tmp_path / "a.json"), array=True).count() == 2


def test_offsets(spark):
    df = spark.createDataFrame([(0,), (100_000,)], "ts long")
    assert [E.from_offset(df, o, 100_000).count() for o in ("earliest", "latest", "ts=1", "last=50s", "last=2m")] == [2, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        E.from_offset(df, "last=1d")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1.0, [0.0, 2.5, float("nan")])], "ranking string, label double, features array<double>")
    E.write_libsvm(rows, str(tmp_path / "svm"))
    assert spark.read.text(str(tmp_path / "svm")).first()[0] == "1.0 2:2.5"
    E.write_csv(rows, str(tmp_path / "csv"), ["a", "b", "c"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["label", "group", "a", "b", "c"]
    E.write_training(rows, str(tmp_path / "t"))
    E.write_training(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    stats, df = spark.createDataFrame([(1, 2.0)], "docs long, avgdl double"), spark.createDataFrame([("a", 1)], "term string, df long")
    E.write_term_frequencies(stats, df, str(tmp_path / "tf"))
    with pytest.raises(Exception, match="(?i)exist"):
        E.write_term_frequencies(stats, df, str(tmp_path / "tf"))
    E.discard(rows)


def run(stream, mode, tmp_path, name="out"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


def test_folds(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1, 5.0), ("a", 86_400_001, 2, 7.0), ("b", 2, 3, 1.0)], "item string, ts long, seq long, value double").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("item string, ts long, seq long, value double").parquet(str(tmp_path / "in"))
    assert {r["item"]: r["count"] for r in run(folds.counters(read(), ["item"]), "complete", tmp_path, "counts")} == {"a": 2, "b": 1}
    assert {r["item"]: r["value"] for r in run(folds.last_values(read(), ["item"]), "complete", tmp_path, "lasts")} == {"a": 7, "b": 1}
    buckets = run(folds.bucket_counts(folds.event_time(read()), ["item"]), "complete", tmp_path, "buckets")
    assert sorted((r["item"], r["bucket"], r["count"]) for r in buckets) == [("a", 0, 1), ("a", 86_400_000, 1), ("b", 0, 1)]


def test_session_join(spark, tmp_path):
    schema = "kind string, ranking string, ts long, seq long, item string, type string, items array<string>"
    m = 60_000
    parts = [
        [("ranking", "r1", m, 0, None, None, ["p1", "p2"]), ("interaction", "r1", 5 * m, 1, "p2", "click", None), ("interaction", "r1", 20 * m, 2, "p1", "buy", None), ("interaction", "r9", 6 * m, 3, "p7", "click", None)],
        [("ranking", "r3", 500 * m, 4, None, None, ["p3"])],
        [("interaction", "r1", 501 * m, 5, "p1", "click", None), ("ranking", "r4", 900 * m, 6, None, None, ["p3"])],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run(folds.session_join(folds.event_time(stream, late="10000 minutes")), "append", tmp_path, "sessions")
    late = [r for r in found if r["late"]]
    assert {(r["ranking"], tuple(r["clicked"])) for r in late} >= {("r9", ("p7",))}
    live = [r for r in found if not r["late"] and r["ranking"] == "r1"]
    assert [(list(r["items"]), list(r["clicked"]), list(r["types"])) for r in live] == [(["p1", "p2"], ["p1", "p2"], ["buy", "click"])]


def test_latest_table(spark, tmp_path):
    write = folds.to_latest(["k"], str(tmp_path / "t"))
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long"), 0)
    write(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    assert {r["k"]: r["v"] for r in folds.latest(spark, str(tmp_path / "t"), ["k"]).collect()} == {"a": 2, "b": 1}

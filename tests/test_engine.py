"""A configuration and a few events to a training set."""

import json
import math

from rankweave.plans import config, engine
from rankweave.sources import events as E

DAY = 86_400_000


def test_training_set(spark, tmp_path):
    field = lambda n, v: {"name": n, "value": v}
    rows = [
        {"event": "item", "id": "1", "timestamp": "1000", "item": "p1", "fields": [field("pop", 10), field("genre", ["drama"]), field("title", "red fox")]},
        {"event": "item", "id": "2", "timestamp": "1000", "item": "p2", "fields": [field("pop", 5), field("genre", ["comedy", "drama"]), field("title", "blue fox")]},
        {"event": "interaction", "id": "3", "timestamp": "2000", "item": "p1", "type": "click", "user": "u"},
        {"event": "ranking", "id": "r1", "timestamp": "3000", "user": "u", "session": "s", "fields": [field("query", "red")], "items": [{"id": "p1", "relevancy": 2.0}, {"id": "p2"}, {"id": "p3"}]},
        {"event": "interaction", "id": "5", "timestamp": "4000", "item": "p2", "type": "click", "user": "u", "ranking": "r1"},
        {"event": "ranking", "id": "r2", "timestamp": str(DAY), "user": "u", "items": [{"id": "p1"}]},
        {"event": "item", "id": "7", "timestamp": str(2 * DAY), "item": "p1", "fields": [field("pop", 99)]},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    plan = config.load(
        {
            "features": [
                {"name": "pop", "type": "number", "source": "item.pop"},
                {"name": "genre", "type": "string", "source": "item.genre", "encode": "onehot", "values": ["drama", "comedy"]},
                {"name": "clicks", "type": "interaction_count", "interaction": "click"},
                {"name": "recent", "type": "window_count", "interaction": "click", "periods": [1, 7]},
                {"name": "match", "type": "field_match", "source": "item.title", "ranking_field": "query"},
                {"name": "where", "type": "position"},
                {"name": "rel", "type": "relevancy"},
                {"name": "spread", "type": "diversity", "source": "item.pop"},
            ],
            "models": {"m": {"features": ["pop", "genre", "clicks", "recent", "match", "where", "rel", "spread"], "weights": {"click": 1.0}}},
        }
    )
    found = engine.training_set(plan, "m", E.read_json(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["ranking"], r["item"], r["label"]) for r in found] == [("r1", "p1", 0), ("r1", "p2", 1), ("r1", "p3", 0)]
    plain = [[None if math.isnan(v) else v for v in r["features"]] for r in found]
    assert plain[0] == [10, 1, 0, 1, 1, 1, 0.5, 0, 2, 2.5]
    assert plain[1] == [5, 1, 1, 0, None, None, 0, 1, None, -2.5]
    assert plain[2] == [None, 0, 0, 0, None, None, 0, 2, None, None]


def test_normalised_rate_from_config(spark, tmp_path):
    """Three impressions and a click of p1, 90 and 9 of p2, weight 10."""
    kinds = [("p1", "impression", 3), ("p1", "click", 1), ("p2", "impression", 90), ("p2", "click", 9)]
    rows = [{"event": "interaction", "id": f"{i}{k}{n}", "timestamp": str(1000 + n), "item": i, "type": k, "user": "u"} for i, k, many in kinds for n in range(many)]
    rows.append({"event": "ranking", "id": "r", "timestamp": "5000", "user": "u", "items": [{"id": "p1"}]})
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spec = {"name": "ctr", "type": "rate", "scope": "item", "top": "click", "bottom": "impression", "bucket": "24h", "periods": [7, 14], "normalize": {"weight": 10}}
    plan = config.load({"features": [spec], "models": {"m": {"features": ["ctr"]}}})
    found = engine.feature_rows(plan, "m", E.read_json(spark, str(tmp_path))).first()["ctr"]
    assert found == [0.11827956989247312] * 2


def test_co_clicks_of_heavy_users(spark):
    """All pairs of all of a user's items, however many, in whatever blocks."""
    from rankweave.operators.models import co_clicked

    rows = [("hot", str(i), "click", i, i) for i in range(150)] + [("u", "1", "click", 1, 1), ("u", "2", "click", 2, 2), ("u", "2", "click", 3, 3), ("u", "3", "view", 4, 4)]
    clicks = spark.createDataFrame(rows, "user string, item string, type string, ts long, seq long")
    for more in ({}, {"block": 20}):
        found = {(r["a"], r["b"]): r["n"] for r in co_clicked(clicks, ["click"], **more).collect()}
        assert len(found) == 150 * 149 // 2 and found.pop(("1", "2")) == 2 and set(found.values()) == {1}

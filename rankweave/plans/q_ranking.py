"""Queries of click-throughs, labels, selectors, splits, metrics, models, profiling and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import clickthrough as C
from rankweave.operators import metrics as M
from rankweave.operators import models, profile, validate
from rankweave.plans.registry import DAY, EV, RC, RI, query
from rankweave.sources.adapters import interactions, items, ranking_clicks, ranking_items, table

_WEIGHTS = {"click": 1.0, "purchase": 5.0}


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """A row a ranking: ranking, user, ts, priority, items in order."""
    rows = ranking_items(spark, d)
    return rows.groupBy("ranking", "user", "ts", "priority").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))


def _clickthroughs(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return C.clickthroughs(lists, ranking_clicks(spark, d).drop("shown", "user")).join(lists.select(F.col("ranking").cast("string").alias("id"), "user", "priority"), "id", "left")


_SESSIONS = f"""{RC}, g AS (SELECT *, CASE WHEN ts - coalesce(lag(ts) OVER w, shown) >= 1800000 THEN 1 ELSE 0 END AS b FROM rc WINDOW w AS (PARTITION BY ranking ORDER BY ts, seq)),
s AS (SELECT *, max(b) OVER (PARTITION BY ranking ORDER BY ts, seq) = 0 AS live FROM g),
lists AS (SELECT ranking, usr, ts, priority, list(item ORDER BY pos) AS items FROM ri GROUP BY ALL),
ct AS (SELECT CAST(ranking AS VARCHAR) AS id, usr, priority, ts, items, its FROM lists JOIN (SELECT ranking, list(item || ':' || type ORDER BY s.ts DESC, seq DESC) AS its FROM s WHERE live GROUP BY ranking) USING (ranking)
    UNION ALL SELECT ranking || ':' || item || ':' || ts || ':' || seq, NULL, NULL, ts, [item], [item || ':' || type] FROM s WHERE NOT live)"""


@query("clickthrough_session", f"WITH {_SESSIONS} SELECT id, ts, array_to_string(items, ',') AS items, array_to_string(its, ',') AS interactions FROM ct")
def clickthrough_session(spark: SparkSession, d: str) -> DataFrame:
    found = _clickthroughs(spark, d)
    return found.select("id", "ts", F.array_join("items", ",").alias("items"), F.array_join(F.transform("interactions", lambda x: F.concat_ws(":", x["item"], x["type"])), ",").alias("interactions"))


@query("session_flags", f"WITH {_SESSIONS} SELECT ranking, item, seq, live AS in_session FROM s")
def session_flags(spark: SparkSession, d: str) -> DataFrame:
    return C.sessions(ranking_clicks(spark, d)).select("ranking", "item", "seq", "in_session")


@query("impression_inject", f"WITH {RC}, l AS (SELECT ranking, max(pos) AS last FROM (SELECT rc.ranking, rc.item, max(ri.pos) AS pos FROM rc JOIN ri ON rc.ranking = ri.ranking AND rc.item = ri.item GROUP BY ALL) GROUP BY ranking) SELECT ri.ranking, ts, pos, item, 'impression' AS type FROM ri JOIN l ON ri.ranking = l.ranking AND pos <= last")
def impression_inject(spark: SparkSession, d: str) -> DataFrame:
    return C.impressions(ranking_items(spark, d), ranking_clicks(spark, d)).select("ranking", "ts", "pos", "item", "type")


@query("label_assign", f"WITH {RC}, n AS (SELECT ranking, item, max_by(type, ROW(ts, seq)) AS t FROM rc GROUP BY ALL) SELECT ri.ranking, pos, CASE t WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM ri LEFT JOIN n ON ri.ranking = n.ranking AND ri.item = n.item")
def label_assign(spark: SparkSession, d: str) -> DataFrame:
    return C.labels(ranking_items(spark, d), ranking_clicks(spark, d), _WEIGHTS).select("ranking", "pos", "label")


@query("explicit_labels", f"WITH {RI}, x AS (SELECT *, CASE WHEN quantity > 30 THEN label END AS given FROM ri) SELECT ranking, item, 'rel' || given AS type, pos AS seq FROM x WHERE given IS NOT NULL")
def explicit_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d).withColumn("label", F.when(F.col("quantity") > 30, F.col("label")))
    return C.explicit_labels(rows).select("ranking", "item", "type", "seq")


@query("vectorize", f"""WITH {RI} SELECT ranking, pos, round(price, 6) AS f0, CASE WHEN label = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f1, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f2,
    coalesce(CASE WHEN relevancy > 0.05 THEN relevancy END, 'nan'::DOUBLE) AS f3 FROM ri""")
def vectorize(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d)
    found = C.vectorize(rows, [F.col("price"), F.array((F.col("label") == 2).cast("double"), (F.col("label") == 0).cast("double")), F.when(F.col("relevancy") > 0.05, F.col("relevancy"))])
    return found.select("ranking", "pos", F.round(F.col("features")[0], 6).alias("f0"), *(F.col("features")[i].alias(f"f{i}") for i in (1, 2, 3)))


_SELECT = {
    "accept": ("true", lambda: C.accept()),
    "field": ("coalesce(priority = '1-URGENT', false)", lambda: C.field_is(F.col("priority"), "1-URGENT")),
    "field_list": ("list_contains(items, '7')", lambda: C.field_has(F.col("items"), "7")),
    "length": ("len(items) BETWEEN 3 AND 5", lambda: C.ranking_length(3, 5)),
    "position": ("list_bool_and(list_transform(list_filter(its, lambda x: list_contains(items, string_split(x, ':')[1])), lambda x: list_position(items, string_split(x, ':')[1]) - 1 BETWEEN 1 AND 3))", lambda: C.positions_within(1, 3)),
    "and": ("len(items) >= 3 AND coalesce(priority = '1-URGENT', false)", lambda: C.all_of(C.ranking_length(3), C.field_is(F.col("priority"), "1-URGENT"))),
    "or": ("len(items) >= 3 OR coalesce(priority = '1-URGENT', false)", lambda: C.any_of(C.ranking_length(3), C.field_is(F.col("priority"), "1-URGENT"))),
    "not": ("NOT (len(items) >= 3)", lambda: C.none_of(C.ranking_length(3))),
}
for kind, (sql, predicate) in _SELECT.items():

    def selector(spark: SparkSession, d: str, predicate=predicate) -> DataFrame:
        return _clickthroughs(spark, d).where(C.usable(predicate())).select("id")

    query(f"selector_{kind}", f"WITH {_SESSIONS} SELECT id FROM ct WHERE {sql}")(selector)


@query("selector_sample")
def selector_sample(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).where(C.sampled(0.3, "ranking")).select("ranking")


_N = "CAST(floor((SELECT count(*) FROM lists) * 0.8 + 0.5) AS BIGINT)"


@query("split_time", f"WITH {_SESSIONS} SELECT ranking, CASE WHEN row_number() OVER (ORDER BY ts, ranking) <= {_N} THEN 'train' ELSE 'test' END AS part FROM lists")
def split_time(spark: SparkSession, d: str) -> DataFrame:
    return C.split_time(_lists(spark, d).select("ranking", "ts"), ["ts", "ranking"]).select("ranking", "part")


@query("split_hold_last", f"WITH {_SESSIONS} SELECT ranking, CASE WHEN row_number() OVER (PARTITION BY usr ORDER BY ts, ranking) <= floor(count(*) OVER (PARTITION BY usr) * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS part FROM lists")
def split_hold_last(spark: SparkSession, d: str) -> DataFrame:
    return C.split_hold_last(_lists(spark, d), "user", ["ts", "ranking"]).select("ranking", "part")


@query("split_field", f"WITH {_SESSIONS} SELECT ranking, CASE priority WHEN '1-URGENT' THEN 'train' ELSE 'test' END AS part FROM lists WHERE priority IN ('1-URGENT', '5-LOW')")
def split_field(spark: SparkSession, d: str) -> DataFrame:
    return C.split_field(_lists(spark, d), "priority", "1-URGENT", "5-LOW").select("ranking", "part")


@query("split_random")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return C.split_random(_lists(spark, d), ["ranking"]).select("ranking", "part")


_TREND = f"SELECT item, round(sum(n * pow(0.5, age) * CASE type WHEN 'click' THEN 1.0 ELSE 5.0 END), 6) AS score FROM (SELECT item, type, (m - ts) // {DAY} AS age, count(*) AS n FROM (SELECT *, max(ts) OVER () AS m FROM ev) WHERE type IN ('click', 'purchase') AND ts > m - 10 * {DAY} GROUP BY ALL) GROUP BY item"


@query("trending", f"WITH {EV} {_TREND}")
def trending(spark: SparkSession, d: str) -> DataFrame:
    return models.trending(interactions(spark, d), _WEIGHTS, 0.5, 10).select("item", F.round("score", 6).alias("score"))


@query("trending_top", f"WITH {EV}, t AS ({_TREND}) SELECT item, score FROM t ORDER BY score DESC, item LIMIT 10")
def trending_top(spark: SparkSession, d: str) -> DataFrame:
    return trending(spark, d).orderBy(F.col("score").desc(), "item").limit(10)


_KNN = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM e)"""


@query("similar_items_knn", f"""WITH {_KNN}, s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.e, v.e) / (q.norm * v.norm) AS score FROM n q JOIN n v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def similar_items_knn(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, every id divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query"), "vector", F.array("id").alias("exclude"))
    return models.nearest(asked, v, 5).select("query", "id", F.round("score", 6).alias("score"))


@query("centroid_knn", f"""WITH {_KNN}, c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e) GROUP BY ALL), k AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label),
s AS (SELECT k.label, v.vec_id AS id, list_dot_product(c, v.e) / (sqrt(list_dot_product(c, c)) * v.norm) AS score FROM k, n v)
SELECT label, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3""")
def centroid_knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = models.centroid(e.select("label", F.col("embedding").alias("vector")), ["label"]).select(F.col("label").alias("query"), "vector", F.lit(None).cast("array<bigint>").alias("exclude"))
    found = models.nearest(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 3)
    return found.select(F.col("query").alias("label"), "id", F.round("score", 6).alias("score"))


@query("als_similar")
def als_similar(spark: SparkSession, d: str) -> DataFrame:
    vectors = models.als_vectors(interactions(spark, d), ["click", "purchase"])
    return models.similar_items(vectors, ["7", "42"], 10).select("id", "score", "rank")


@query("co_clicked", f"""WITH {EV}, o AS (SELECT usr, item, max(seq) AS l FROM ev WHERE type IN ('click', 'purchase') GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY l DESC, item) AS n FROM o) WHERE n <= 100)
SELECT x.item AS a, y.item AS b, count(*) AS n FROM k x JOIN k y ON x.usr = y.usr AND x.item < y.item GROUP BY ALL HAVING count(*) >= 3""")
def co_clicked(spark: SparkSession, d: str) -> DataFrame:
    return models.co_clicked(interactions(spark, d), ["click", "purchase"], 3)


@query("noop_rank", f"WITH {RI} SELECT ranking, item, pos FROM ri")
def noop_rank(spark: SparkSession, d: str) -> DataFrame:
    return M.reranked(ranking_items(spark, d), models.noop_scores()).select("ranking", "item", F.col("pos").cast("long").alias("pos"))


@query("shuffle")
def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return M.reranked(ranking_items(spark, d), models.shuffle_scores(F.col("pos"), 5, "ranking", "pos")).select("ranking", "item", "pos")


@query("random_items")
def random_items(spark: SparkSession, d: str) -> DataFrame:
    return models.random_items(interactions(spark, d), 10)


@query("rerank_by_price", f"WITH {RI} SELECT ranking, item, row_number() OVER (PARTITION BY ranking ORDER BY price DESC, pos) - 1 AS pos FROM ri")
def rerank_by_price(spark: SparkSession, d: str) -> DataFrame:
    return M.reranked(ranking_items(spark, d), F.col("price")).select("ranking", "item", F.col("pos").cast("long").alias("pos"))


@query("lambdamart_scores")
def lambdamart_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = C.vectorize(ranking_items(spark, d), [F.col("price"), F.col("quantity"), F.col("relevancy"), F.col("pos").cast("double")])
    model = models.LambdaMART(rounds=2, depth=3).fit(rows.select("ranking", F.col("label").cast("double").alias("label"), "features"))
    return model.score(rows.select("ranking", "pos", "features")).select("ranking", "pos", "score")


@query("ndcg", f"""WITH {RI}, r AS (SELECT ranking, pos, label, row_number() OVER (PARTITION BY ranking ORDER BY label DESC, pos) AS i FROM ri),
s AS (SELECT ranking, sum(CASE WHEN pos < 5 THEN (pow(2, label) - 1) / log2(pos + 2) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN (pow(2, label) - 1) / log2(i + 1) ELSE 0 END) AS ideal FROM r GROUP BY ranking)
SELECT ranking, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 1 END, 6) AS ndcg FROM s""")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return M.ndcg(ranking_items(spark, d), 5).select("ranking", F.round("ndcg", 6).alias("ndcg"))


@query("map", f"""WITH {RI}, h AS (SELECT *, count(*) FILTER (WHERE label > 0) OVER (PARTITION BY ranking ORDER BY pos) AS h FROM ri)
SELECT ranking, round(coalesce(avg(CASE WHEN pos < 5 AND label > 0 THEN h / (pos + 1) END), 0), 6) AS map FROM h GROUP BY ranking""")
def map_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(ranking_items(spark, d), 5).select("ranking", F.round("map", 6).alias("map"))


@query("mrr", f"WITH {RI} SELECT ranking, round(coalesce(1.0 / (min(CASE WHEN label > 0 THEN pos END) + 1), 0), 6) AS mrr FROM ri GROUP BY ranking")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return M.reciprocal_rank(ranking_items(spark, d)).select("ranking", F.round("mrr", 6).alias("mrr"))


@query("kendall", f"""WITH {RI}, o AS (SELECT ranking, pos, row_number() OVER (PARTITION BY ranking ORDER BY price, pos) AS r FROM ri), p AS (SELECT a.ranking, sum(CASE WHEN b.r > a.r THEN 1 ELSE -1 END) AS s, count(*) AS n FROM o a JOIN o b ON a.ranking = b.ranking AND a.pos < b.pos GROUP BY a.ranking)
SELECT ranking, round(coalesce(s / n, 1), 6) AS kendall FROM (SELECT DISTINCT ranking FROM ri) LEFT JOIN p USING (ranking)""")
def kendall(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d)
    by_price = F.row_number().over(Window.partitionBy("ranking").orderBy("price", "pos"))
    return M.kendall(rows.withColumn("other", by_price)).select("ranking", F.round("kendall", 6).alias("kendall"))


@query("autofeature_numeric", "SELECT unnest(['p_size', 'p_retailprice']) AS field, unnest([min(CAST(p_size AS DOUBLE)), min(p_retailprice)]) AS min, unnest([max(CAST(p_size AS DOUBLE)), max(p_retailprice)]) AS max, unnest([count(p_size), count(p_retailprice)]) AS n FROM part")
def autofeature_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_rule(profile.numeric_fields(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query("autofeature_string", """WITH v AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER w AS nth, sum(n) OVER (PARTITION BY field) AS total, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM c WINDOW w AS (PARTITION BY field ORDER BY n DESC, value)),
k AS (SELECT * FROM r WHERE (upto <= 0.9 * total OR nth <= 10) AND n >= 0.001 * total AND nth <= 100)
SELECT field, value, n, CAST(nth AS INTEGER) AS nth, CASE WHEN count(*) OVER (PARTITION BY field) < 10 THEN 'onehot' ELSE 'index' END AS encode FROM k QUALIFY count(*) OVER (PARTITION BY field) >= 2""")
def autofeature_string(spark: SparkSession, d: str) -> DataFrame:
    return profile.string_rule(profile.string_values(table(spark, d, "part"), ["p_brand", "p_type"]))


@query("autofeature_vector", "SELECT 'embedding' AS field, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN 'vector' || max(len(embedding)) ELSE 'min,max,size,avg' END AS reduce FROM embeddings")
def autofeature_vector(spark: SparkSession, d: str) -> DataFrame:
    return profile.vector_rule(table(spark, d, "embeddings"), "embedding")


@query("autofeature_interactions", f"WITH {EV}, t AS (SELECT DISTINCT type AS source FROM ev) SELECT p || source AS name, f AS feature, source FROM t, (VALUES ('count_', 'interaction_count'), ('window_', 'window_count'), ('rate_', 'rate'), ('interacted_', 'interacted_with')) x(p, f)")
def autofeature_interactions(spark: SparkSession, d: str) -> DataFrame:
    return profile.interaction_rules(interactions(spark, d))


@query("autofeature_models", f"WITH {RC} SELECT CASE WHEN (SELECT count(DISTINCT ranking) FROM ri) >= 100 AND (SELECT count(DISTINCT ranking) FROM rc) >= 100 THEN 'lambdamart,' ELSE '' END || CASE WHEN (SELECT count(*) FROM rc) >= 10 THEN 'trending,similar' ELSE '' END AS models")
def autofeature_models(spark: SparkSession, d: str) -> DataFrame:
    rankings = ranking_items(spark, d).agg(F.countDistinct("ranking").alias("r"))
    clicks = ranking_clicks(spark, d).agg(F.countDistinct("ranking").alias("c"), F.count("*").alias("i"))
    return rankings.crossJoin(F.broadcast(clicks)).select(F.array_join(profile.model_rules(F.col("r"), F.col("c"), F.col("i")), ",").alias("models"))  # a row each


@query("event_counts", f"WITH {EV} SELECT type, count(*) AS n FROM ev GROUP BY type")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.interaction_types(interactions(spark, d))


@query("value_counts", "SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.string_values(table(spark, d, "part"), ["p_brand"])


@query("distinct_items", f"WITH {EV} SELECT DISTINCT item FROM ev")
def distinct_items(spark: SparkSession, d: str) -> DataFrame:
    return interactions(spark, d).select("item").distinct()


@query("validate_order", "WITH x AS (SELECT o_orderkey AS seq, o_orderdate AS ts FROM orders) SELECT CAST(count(*) AS BIGINT) AS n_late FROM (SELECT ts, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x) WHERE ts < m")
def validate_order(spark: SparkSession, d: str) -> DataFrame:
    stream = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.floor(F.col("o_orderkey") / 10_000).alias("slot"))
    return validate.event_order(stream, "slot")


@query("validate_event_types", "SELECT unnest(['item', 'ranking', 'interaction']) AS kind EXCEPT SELECT DISTINCT event_type FROM events")
def validate_event_types(spark: SparkSession, d: str) -> DataFrame:
    return validate.event_types(table(spark, d, "events").select(F.col("event_type").alias("event")))


@query("validate_fields", "SELECT event, field FROM (VALUES ('item', 'p_brand'), ('item', 'p_colour'), ('user', 'age')) r(event, field) WHERE field <> 'p_brand'")
def validate_fields(spark: SparkSession, d: str) -> DataFrame:
    seen = spark.createDataFrame([("item", c) for c in table(spark, d, "part").columns], "event string, field string")
    return validate.missing_fields(spark.createDataFrame([("item", "p_brand"), ("item", "p_colour"), ("user", "age")], "event string, field string"), seen)


@query("validate_keys", f"WITH {RC} SELECT ranking, item, seq FROM rc WHERE ranking NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')")
def validate_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("ranking"))
    return validate.unknown_rankings(ranking_clicks(spark, d), known).select("ranking", "item", "seq")


@query("validate_metadata", f"""WITH {EV}, f AS (SELECT item, min(ts) AS first FROM ev WHERE type = 'view' GROUP BY item)
SELECT seq, ev.item, CASE WHEN first IS NULL THEN 'never' ELSE 'later' END AS why FROM ev LEFT JOIN f USING (item) WHERE type = 'purchase' AND (first IS NULL OR ts <= first)""")
def validate_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    return validate.unknown_items(rows.where("type = 'purchase'"), rows.where("type = 'view'").select("item", "ts")).select("seq", "item", "why")


@query("validate_positions", f"WITH {RC}, l AS (SELECT ranking, item, max(pos) AS pos FROM ri GROUP BY ALL) SELECT coalesce(l.pos, -1) AS pos, count(*) AS n FROM rc LEFT JOIN l USING (ranking, item) GROUP BY ALL")
def validate_positions(spark: SparkSession, d: str) -> DataFrame:
    return validate.click_positions(ranking_clicks(spark, d), ranking_items(spark, d))


@query("validate_types", f"WITH {EV} SELECT type, count(*) AS n FROM ev WHERE type NOT IN ('click', 'purchase') GROUP BY type")
def validate_types(spark: SparkSession, d: str) -> DataFrame:
    return validate.unused_types(interactions(spark, d), ["click", "purchase"])


@query("validate_string_values", "WITH c(field, value) AS (VALUES ('p_brand', 'Brand#11'), ('p_brand', 'x'), ('p_brand', 'y'), ('p_type', 'z')) SELECT field, CAST(count(*) FILTER (WHERE value IN (SELECT p_brand FROM part)) AS BIGINT) AS used, count(*) AS configured FROM c GROUP BY field")
def validate_string_values(spark: SparkSession, d: str) -> DataFrame:
    configured = spark.createDataFrame([("p_brand", "Brand#11"), ("p_brand", "x"), ("p_brand", "y"), ("p_type", "z")], "field string, value string")
    return validate.string_usage(profile.string_values(table(spark, d, "part"), ["p_brand", "p_type"]), configured).select("field", F.col("used").cast("long").alias("used"), "configured")


@query("catalogue_join", f"WITH {RI} SELECT ranking, pos, p_brand AS brand FROM ri JOIN part ON item = CAST(p_partkey AS VARCHAR)")
def catalogue_join(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).join(items(spark, d), "item").select("ranking", "pos", "brand")

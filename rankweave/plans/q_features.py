"""Queries of stateless extractors, encoders, reducers, dates, texts, diversity and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions import agents, text
from rankweave.functions import scalar as S
from rankweave.operators import features
from rankweave.plans.registry import EV, RI, query
from rankweave.sources.adapters import interactions, ranking_items, table

_BRANDS = [f"Brand#{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


@query("string_onehot", "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_brand = '{b}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{i}" for i, b in enumerate(_BRANDS)) + " FROM part")
def string_onehot(spark: SparkSession, d: str) -> DataFrame:
    hot = S.onehot(F.array("p_brand"), _BRANDS)
    return table(spark, d, "part").select("p_partkey", *(hot[i].alias(f"is_{i}") for i in range(len(_BRANDS))))


@query("string_index", f"SELECT p_partkey, CAST(coalesce(list_position({_BRANDS!r}, p_brand), 0) AS INTEGER) AS idx FROM part")
def string_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.category_index(F.array("p_brand"), _BRANDS).alias("idx"))


_VECTOR_SQL = {
    "first": "list_extract(e, 1)", "last": "list_extract(e, -1)", "min": "list_min(e)", "max": "list_max(e)", "avg": "round(list_sum(e) / len(e), 6)", "sum": "round(list_sum(e), 6)",
    "size": "CAST(len(e) AS DOUBLE)", "euclidean_distance": "round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6)",
}
for reducer, sql in _VECTOR_SQL.items():

    def reduce_vector(spark: SparkSession, d: str, reducer=reducer) -> DataFrame:
        v = S.reduced(F.col("embedding").cast("array<double>"), (reducer,))[0]
        return table(spark, d, "embeddings").select("vec_id", (F.round(v, 6) if reducer in ("avg", "sum", "euclidean_distance") else v).alias("value"))

    query(f"vector_{reducer}", f"SELECT vec_id, {sql} AS value FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")(reduce_vector)


@query("vector_first_n", "SELECT vec_id, e[1] AS a, e[4] AS b, 0.0::DOUBLE AS c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vector_first_n(spark: SparkSession, d: str) -> DataFrame:
    v = S.reduced(F.col("embedding").cast("array<double>"), ("vector70",))
    return table(spark, d, "embeddings").select("vec_id", v[0].alias("a"), v[3].alias("b"), v[69].alias("c"))


@query("vector_random")
def vector_random(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.reduced(F.col("embedding").cast("array<double>"), ("random",))[0].alias("value"))


@query("word_count", "SELECT p_partkey, CAST(CASE WHEN p_name = '' THEN 1 ELSE len(regexp_split_to_array(rtrim(p_name), '\\s+')) END AS DOUBLE) AS words FROM part")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.word_count(F.col("p_name")).alias("words"))


@query("relevancy", f"WITH {RI} SELECT ranking, pos, relevancy FROM ri")
def relevancy(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "pos", "relevancy")


_TIME_SQL = {"time_of_day": "(hour(t) * 3600 + minute(t) * 60 + second(t)) / 3600.0::DOUBLE", "day_of_week": "CAST(isodow(t) AS DOUBLE)", "month_of_year": "CAST(month(t) AS DOUBLE)", "year": "CAST(year(t) AS DOUBLE)", "second": "CAST(epoch_us(t) // 1000000 AS DOUBLE)"}
for mapper, sql in _TIME_SQL.items():

    def local_time(spark: SparkSession, d: str, mapper=mapper) -> DataFrame:
        return table(spark, d, "events").select("event_id", F.round(S.TIME_MAPPERS[mapper](F.col("ts")), 6).alias("value"))

    query(f"local_time_{mapper}", f"SELECT event_id, round({sql}, 6) AS value FROM (SELECT event_id, ts AS t FROM events)")(local_time)


@query("local_time_offset", "SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0::DOUBLE, 6) AS value FROM events")
def local_time_offset(spark: SparkSession, d: str) -> DataFrame:
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return table(spark, d, "events").select("event_id", F.round(S.TIME_MAPPERS["time_of_day"](S.wall_clock(iso)), 6).alias("value"))


@query("item_age", f"WITH {EV}, u AS (SELECT item, min(ts) AS first FROM ev GROUP BY item) SELECT seq, CAST(floor(abs(ts - first) / 1000) AS DOUBLE) AS age FROM ev JOIN u USING (item)")
def item_age(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    return rows.join(rows.groupBy("item").agg(F.min("ts").alias("first")), "item").select("seq", S.as_of_age(F.col("ts"), F.col("first")).alias("age"))


_AGENTS = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X) AppleWebKit/605.1.15 Version/16.0 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/108.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:107.0) Gecko/20100101 Firefox/107.0", "Mozilla/5.0 (Linux; Android 12; Pixel 6) AppleWebKit/537.36 Chrome/107.0.0.0 Mobile Safari/537.36", "Googlebot/2.1 (+http://www.google.com/bot.html)",
)
_AGENT_SQL = {
    "platform": ("mobile", "desktop", "desktop", "mobile", "other"), "os": ("ios", "windows", "linux", "android", "other"), "browser": ("safari", "chrome", "firefox", "chrome", "other"), "bot": ("other", "other", "other", "other", "bot"),
}
for agent_field, answers in _AGENT_SQL.items():

    def ua(spark: SparkSession, d: str, agent_field=agent_field) -> DataFrame:
        agent = F.get(F.array(*(F.lit(a) for a in _AGENTS)), F.pmod("user_id", F.lit(len(_AGENTS))).cast("int"))
        return table(spark, d, "events").select("event_id", agents.agent_value(agent, agent_field).alias("value"))

    query(f"ua_{agent_field}", f"SELECT event_id, ([{', '.join(map(repr, answers))}])[user_id % {len(_AGENTS)} + 1] AS value FROM events")(ua)


@query("referer_medium", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'internal' WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'social' ELSE 'unknown' END AS medium,
    CAST(CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 2 WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 3 ELSE 0 END AS INTEGER) AS idx FROM h""")
def referer_medium(spark: SparkSession, d: str) -> DataFrame:
    m = agents.medium(F.col("url"), ("example.org",), {"social": "example.net"})
    return table(spark, d, "pages").select("page_id", m.alias("medium"), agents.medium_index(m).alias("idx"))


#: Every document with one query: the items in turn.
_PAIRS = "pairs AS (SELECT a.item_id AS x, b.doc_id AS y, a.text AS p, b.text AS q FROM benchmark a JOIN documents b ON b.doc_id % (SELECT count(*) FROM benchmark) = a.item_id)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("x"), F.col("text").alias("p"))
    count = items.agg(F.count("*").alias("n"))  # one row
    docs = table(spark, d, "documents").crossJoin(F.broadcast(count)).select((F.col("doc_id") % F.col("n")).alias("x"), F.col("doc_id").alias("y"), F.col("text").alias("q"))
    return docs.join(items, "x")


def _terms_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"


_JACCARD = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS score"


@query("match_term", f"WITH {_PAIRS} SELECT x, y, {_JACCARD} FROM (SELECT x, y, {_terms_sql('p')} AS a, {_terms_sql('q')} AS b FROM pairs)")
def match_term(spark: SparkSession, d: str) -> DataFrame:
    return features.field_match(_pairs(spark, d), "p", "q", "term").select("x", "y", F.round("score", 6).alias("score"))


def _grams_sql(c: str) -> str:
    return f"list_distinct(flatten(list_transform({_terms_sql(c)}, lambda t: list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3)))))"


@query("match_ngram", f"WITH {_PAIRS} SELECT x, y, {_JACCARD} FROM (SELECT x, y, {_grams_sql('p')} AS a, {_grams_sql('q')} AS b FROM pairs)")
def match_ngram(spark: SparkSession, d: str) -> DataFrame:
    return features.field_match(_pairs(spark, d), "p", "q", "ngram").select("x", "y", F.round("score", 6).alias("score"))


@query("match_bm25", f"""WITH {_PAIRS}, l AS (SELECT doc_id, {_terms_sql('text')} AS t FROM documents), n AS (SELECT count(*) AS docs, sum(len(t)) / count(*) AS avgdl FROM l),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM l) GROUP BY term),
m AS (SELECT x, y, len(b) AS len, unnest(list_intersect(a, b)) AS term FROM (SELECT x, y, {_terms_sql('p')} AS a, {_terms_sql('q')} AS b FROM pairs)),
s AS (SELECT x, y, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM m JOIN df USING (term), n GROUP BY x, y)
SELECT x, y, round(coalesce(score, 0), 6) AS score FROM pairs LEFT JOIN s USING (x, y)""")
def match_bm25(spark: SparkSession, d: str) -> DataFrame:
    stats, df = text.term_frequencies(table(spark, d, "documents"), ["text"])
    return features.bm25_scores(_pairs(spark, d), "p", "q", ["x", "y"], stats, df).select("x", "y", F.round("score", 6).alias("score"))


@query("match_english")
def match_english(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return pairs.select("x", "y", text.jaccard(text.unique(text.english_terms("p")), text.unique(text.english_terms("q"))).alias("score"))


@query("term_freq_dict", f"WITH l AS (SELECT {_terms_sql('text')} AS t FROM documents) SELECT term, count(*) AS df, (SELECT count(*) FROM l) AS docs, (SELECT round(sum(len(t)) / count(*), 6) FROM l) AS avgdl FROM (SELECT unnest(t) AS term FROM l) GROUP BY term")
def term_freq_dict(spark: SparkSession, d: str) -> DataFrame:
    stats, df = text.term_frequencies(table(spark, d, "documents"), ["text"])
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "docs", F.round("avgdl", 6).alias("avgdl"))  # stats is one row




@query("biencoder_cosine", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS x, b.vec_id AS y, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 7""")
def biencoder_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("x"), (F.col("vec_id") + 7).alias("y"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("y"), F.col("embedding").alias("b"))
    return a.join(b, "y").select("x", "y", F.round(text.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query("crossencoder_cache", f"""WITH {RI}, cache AS (SELECT priority AS q, item, avg(relevancy) AS score FROM ri WHERE label = 2 GROUP BY ALL)
SELECT ranking, pos, round(score, 6) AS score FROM ri LEFT JOIN cache ON priority = q AND ri.item = cache.item""")
def crossencoder_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d)
    cache = rows.where("label = 2").groupBy("priority", "item").agg(F.avg("relevancy").alias("score"))
    return rows.join(cache, ["priority", "item"], "left").select("ranking", "pos", F.round("score", 6).alias("score"))


@query("diversity_num", f"WITH {RI}, m AS (SELECT ranking, quantile_cont(price, 0.5) AS m FROM ri WHERE pos < 3 GROUP BY ranking) SELECT ranking, pos, round(price - m, 6) AS diversity FROM ri JOIN m USING (ranking)")
def diversity_num(spark: SparkSession, d: str) -> DataFrame:
    return features.diversity_number(ranking_items(spark, d), "ranking", "pos", "price", 3).select("ranking", "pos", F.round("diversity", 6).alias("diversity"))


@query("diversity_str", f"""WITH {RI}, b AS (SELECT ranking, pos, p_brand AS brand FROM ri JOIN part ON item = CAST(p_partkey AS VARCHAR)), c AS (SELECT ranking, brand, count(*) AS n FROM b WHERE pos < 4 GROUP BY ALL)
SELECT ranking, pos, round(coalesce(n, 0) / sum_n, 6) AS diversity FROM b LEFT JOIN c USING (ranking, brand) JOIN (SELECT ranking, sum(n) AS sum_n FROM c GROUP BY ranking) USING (ranking)""")
def diversity_str(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.array("p_brand").alias("brands"))
    rows = ranking_items(spark, d).join(brands, "item")
    return features.diversity_string(rows, "ranking", "pos", "item", "brands", 4).select("ranking", "pos", F.round("diversity", 6).alias("diversity"))


@query("position", f"WITH {RI} SELECT ranking, item, pos FROM ri")
def position(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "item", "pos")


@query("random", f"WITH {RI} SELECT ranking, pos, CAST(('0x' || substr(md5('42|' || ranking || '|' || pos), 1, 13)) AS BIGINT) / 4503599627370496.0 AS value FROM ri")
def random_feature(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "pos", S.noise("ranking", "pos").alias("value"))


@query("norm_minmax", f"WITH {RI} SELECT ranking, pos, round((price - min(price) OVER w) / nullif(max(price) OVER w - min(price) OVER w, 0), 6) AS value FROM ri WINDOW w AS (PARTITION BY ranking)")
def norm_minmax(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "pos", F.round(features.minmax(F.col("price"), "ranking"), 6).alias("value"))


@query("norm_position", f"WITH {RI} SELECT ranking, pos, round((row_number() OVER (PARTITION BY ranking ORDER BY price, pos) - 1) / count(*) OVER (PARTITION BY ranking), 6) AS value FROM ri")
def norm_position(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "pos", F.round(features.rank_share(F.col("price"), "ranking", "pos"), 6).alias("value"))


@query("global_join", f"WITH {EV} SELECT seq, round(value / (SELECT avg(value) FROM ev), 6) AS ratio FROM ev WHERE type = 'click'")
def global_join(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    mean = rows.agg(F.avg("value").alias("mean"))
    return rows.where("type = 'click'").crossJoin(F.broadcast(mean)).select("seq", F.round(F.col("value") / F.col("mean"), 6).alias("ratio"))  # mean is one row


@query("ranking_size_window", f"WITH {RI} SELECT ranking, pos, count(*) OVER (PARTITION BY ranking) AS n FROM ri")
def ranking_size_window(spark: SparkSession, d: str) -> DataFrame:
    return ranking_items(spark, d).select("ranking", "pos", F.count(F.lit(1)).over(Window.partitionBy("ranking")).alias("n"))

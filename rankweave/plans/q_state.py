"""Queries of sources, states, windows, point-in-time joins and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import features, pit, state
from rankweave.plans.registry import DAY, EV, RI, query
from rankweave.sources import events as E
from rankweave.sources.adapters import interactions, ranking_items, table

MS = 86_400_000
CUT = 1_705_276_800_000  # 2024-01-15


@query("scan_filter_offset", f"WITH {EV} SELECT seq, item, type FROM ev WHERE ts >= {CUT}")
def scan_filter_offset(spark: SparkSession, d: str) -> DataFrame:
    return E.from_offset(interactions(spark, d), f"ts={CUT}").select("seq", "item", "type")


@query("scan_filter_last", f"WITH {EV} SELECT seq, usr FROM ev WHERE ts >= {CUT} - 3 * {DAY}")
def scan_filter_last(spark: SparkSession, d: str) -> DataFrame:
    return E.from_offset(interactions(spark, d), "last=3d", now_ms=CUT).select("seq", F.col("user").alias("usr"))


@query("snowplow_parse", f"WITH {EV} SELECT 'iglu:x/' || type || '/1' AS schema, CAST(seq AS BIGINT) AS seq, item FROM ev WHERE type IN ('click', 'purchase')")
def snowplow_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("iglu:x/"), "type", F.lit("/1")).alias("schema"), F.struct("seq", "item").alias("data")).alias("data")))
    lines = rows.select(F.concat(F.repeat(F.lit("x\t"), 58), body, F.repeat(F.lit("\ty"), 5)).alias("value"))
    found = E.parse_snowplow_tsv(lines, ["iglu:x/click/1", "iglu:x/purchase/1"])
    return found.select("schema", F.get_json_object("data", "$.seq").cast("long").alias("seq"), F.get_json_object("data", "$.item").alias("item"))


@query("snowplow_json", f"WITH {EV} SELECT CAST(seq AS BIGINT) AS seq, usr FROM ev WHERE type = 'view'")
def snowplow_json(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    lines = rows.select(F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("iglu:x/"), "type", F.lit("/1")).alias("schema"), F.struct("seq", "user").alias("data")).alias("data")).alias("unstruct_event"))).alias("value"))
    found = E.parse_snowplow_json(lines, ["iglu:x/view/1"])
    return found.select(F.get_json_object("data", "$.seq").cast("long").alias("seq"), F.get_json_object("data", "$.user").alias("usr"))


@query("event_typed_projection", f"WITH {EV} SELECT seq, ts, value, '[' || item || '!' AS tag, '00' || item AS code, item || ',true' AS list, CAST(item AS DOUBLE) + 0.5 AS sizes FROM ev WHERE type IN ('click', 'purchase')")
def event_typed_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    # As JSON text; tag and code are strings that look like something else, list has the item twice.
    text = F.to_json(F.struct(F.lit("interaction").alias("event"), F.col("seq").cast("string").alias("id"), F.col("ts").alias("timestamp"), "item", "user", "type"))
    values = F.concat(F.lit('[{"name":"value","value":'), F.col("value").cast("string"), F.lit('},{"name":"tag","value":"['), F.col("item"), F.lit('!"},{"name":"code","value":"00'), F.col("item"), F.lit('"},{"name":"list","value":["'), F.col("item"), F.lit('","true"]},{"name":"sizes","value":['), F.col("item"), F.lit(",0.5]}]"))
    line = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"fields":'), values, F.lit("}"))
    raw = rows.select(F.from_json(line, E.RAW).alias("e")).select("e.*")
    typed = E.decode(raw).where(F.col("type").isin("click", "purchase"))
    field = F.col("fields")
    return typed.select(F.col("id").cast("long").alias("seq"), "ts", field["value"]["n"].alias("value"), field["tag"]["s"].alias("tag"), field["code"]["s"].alias("code"), F.array_join(field["list"]["sl"], ",").alias("list"), F.aggregate(field["sizes"]["nl"], F.lit(0.0), lambda a, x: a + x).alias("sizes"))


@query("scalar_last_value", f"WITH {EV} SELECT usr, max_by(value, seq) AS value FROM ev GROUP BY usr")
def scalar_last_value(spark: SparkSession, d: str) -> DataFrame:
    return state.last_value(interactions(spark, d), ["user"]).select(F.col("user").alias("usr"), "value")


@query("map_state", f"""WITH {EV}, l AS (SELECT usr, item, max_by(CASE WHEN type = 'error' THEN 'DEL' ELSE type END, seq) AS v FROM ev GROUP BY usr, item)
SELECT usr, count(*) AS n, string_agg(item || '=' || v, ',' ORDER BY item) AS entries FROM l WHERE v <> 'DEL' GROUP BY usr""")
def map_state(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).withColumn("value", F.when(F.col("type") != "error", F.col("type")))
    found = state.map_state(rows, ["user"], "item", "value")
    return found.select(F.col("user").alias("usr"), F.size("entries").cast("long").alias("n"), F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


for name, key in (("item", "item"), ("user", "user"), ("global", None)):
    column = {"user": "usr"}.get(key, key)

    def counter(spark: SparkSession, d: str, key=key) -> DataFrame:
        found = state.counter(interactions(spark, d).where("type = 'click'"), [key] if key else [])
        return found.withColumnRenamed("user", "usr")

    query(f"counter_by_{name}", f"WITH {EV} SELECT {column + ', ' if column else ''}count(*) AS count FROM ev WHERE type = 'click' {'GROUP BY ' + column if column else ''}")(counter)


@query("bounded_list_last_n", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, seq DESC) AS n, max(ts) OVER (PARTITION BY usr) AS m FROM ev)
SELECT usr, string_agg(item, ',' ORDER BY n) AS items, count(*) AS n FROM r WHERE n <= 5 AND ts >= m - 10 * {DAY} GROUP BY usr""")
def bounded_list_last_n(spark: SparkSession, d: str) -> DataFrame:
    found = state.bounded_list(interactions(spark, d), ["user"], 5, 10 * MS, value="item")
    return found.select(F.col("user").alias("usr"), F.array_join(F.col("values")["value"], ",").alias("items"), F.size("values").cast("long").alias("n"))


@query("turn_list", "SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def turn_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ts"), F.col("turn").alias("seq"), "role")
    return state.bounded_list(rows, ["conv_id"], 3, value="role").select("conv_id", F.array_join(F.col("values")["value"], ",").alias("roles"))


@query("freq_share", f"WITH {EV} SELECT usr, type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY usr), 6) AS share FROM ev GROUP BY usr, type")
def freq_share(spark: SparkSession, d: str) -> DataFrame:
    return state.frequencies(interactions(spark, d), ["user"], "type").select(F.col("user").alias("usr"), "type", "n", F.round("share", 6).alias("share"))


@query("freq_top_approx")
def freq_top_approx(spark: SparkSession, d: str) -> DataFrame:
    return state.top_frequencies(interactions(spark, d), ["type"], 5, "item").select("type", F.size("top").alias("n"))


def _anchored(periods: tuple[int, ...], keys: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN b >= m - {p} * {DAY} THEN n END), 0) AS BIGINT) AS c{p}" for p in periods)
    return f"SELECT {keys}, {sums} FROM (SELECT *, max(b) OVER (PARTITION BY {keys}) AS m FROM (SELECT {keys}, ts - ts % {DAY} AS b, count(*) AS n FROM ev GROUP BY ALL)) GROUP BY {keys}"


@query("periodic_counter_windows", f"WITH {EV} {_anchored((3, 7, 14), 'item, type')}")
def periodic_counter_windows(spark: SparkSession, d: str) -> DataFrame:
    found = state.periodic_counter(interactions(spark, d), ["item", "type"], MS, [3, 7, 14])
    return found.select("item", "type", *(F.col("counts")[i].alias(f"c{p}") for i, p in enumerate((3, 7, 14))))


@query("trailing_window", f"WITH {EV}, b AS (SELECT item, ts - ts % {DAY} AS bucket, count(*) AS n FROM ev GROUP BY ALL) SELECT item, bucket, CAST(sum(n) OVER (PARTITION BY item ORDER BY bucket RANGE BETWEEN 7 * {DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS count_7 FROM b")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    return state.trailing_counts(interactions(spark, d), ["item"], MS, [7])


@query("tumbling_buckets", f"WITH {EV} SELECT type, ts - ts % {DAY} AS bucket, count(*) AS count FROM ev GROUP BY ALL")
def tumbling_buckets(spark: SparkSession, d: str) -> DataFrame:
    return state.buckets(interactions(spark, d), ["type"], MS)


@query("stats_percentiles", f"WITH {EV} SELECT type, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM ev GROUP BY type")
def stats_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = state.statistics(interactions(spark, d), ["type"])
    return found.select("type", F.col("min").alias("low"), F.col("max").alias("high"), F.round(F.col("percentiles")[0], 6).alias("p50"), F.round(F.col("percentiles")[1], 6).alias("p90"))


@query("state_ttl", f"WITH {EV}, l AS (SELECT usr, max(ts) AS ts FROM ev GROUP BY usr) SELECT usr, ts FROM l WHERE ts >= {CUT} - 5 * {DAY}")
def state_ttl(spark: SparkSession, d: str) -> DataFrame:
    last = interactions(spark, d).groupBy(F.col("user").alias("usr")).agg(F.max("ts").alias("ts"))
    return state.expired(last, F.lit(CUT), 5 * MS)


@query("ordering_guard", f"WITH {EV} SELECT seq, ts FROM (SELECT seq, ts, lag(ts) OVER (ORDER BY (seq * 7919) % 1000003, seq) AS p FROM ev) WHERE ts < p")
def ordering_guard(spark: SparkSession, d: str) -> DataFrame:
    # All events, in an order that isn't theirs; ids may be of any size.
    rest = F.col("seq") * 7919 % 1_000_003
    rows = interactions(spark, d).select(F.struct(F.col("seq").isNull().alias("last"), rest.alias("rest"), "seq").alias("seq"), "ts")
    return state.ordering_errors(rows, slot=F.floor(F.col("seq.rest") / 1_000)).select("seq.seq", "ts")


@query("number_pit", f"""WITH {EV}, w AS (SELECT item, seq AS s, value AS v FROM ev WHERE type = 'view')
SELECT seq, ev.item, w.v AS seen FROM (SELECT seq, item FROM ev WHERE type = 'click') ev ASOF LEFT JOIN w ON ev.item = w.item AND ev.seq > w.s""")
def number_pit(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    return pit.as_of_last(rows.where("type = 'click'").select("seq", "ts", "item"), rows.where("type = 'view'"), ["item"], "value", "seen").select("seq", "item", "seen")


@query("number_override", f"WITH {RI} SELECT ranking, pos, coalesce(CASE WHEN relevancy > 0.05 THEN relevancy END, p_retailprice) AS value FROM ri JOIN part ON item = CAST(p_partkey AS VARCHAR)")
def number_override(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d).withColumn("seq", F.lit(0)).withColumn("own", F.when(F.col("relevancy") > 0.05, F.col("relevancy")))
    writes = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.lit(0).cast("long").alias("ts"), F.lit(0).alias("seq"), F.col("p_retailprice").alias("value"))
    return features.number(rows.select("ranking", "pos", "item", "ts", "seq", "own"), writes, ["item"], "own").join(writes.select("item"), "item", "left_semi").select("ranking", "pos", "value")


@query("counter_pit", f"WITH {EV} SELECT seq, usr, count(*) FILTER (WHERE type = 'click') OVER (PARTITION BY usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clicks FROM ev")
def counter_pit(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    return pit.as_of_count(rows.select("seq", "ts", "user"), rows.where("type = 'click'"), ["user"], "clicks").select("seq", F.col("user").alias("usr"), "clicks")


@query("window_count_pit", f"""WITH {EV}, c AS (SELECT seq, item, ts, ts - ts % {DAY} AS b FROM ev WHERE type = 'click'), p AS (SELECT seq, item FROM ev WHERE type = 'purchase'),
a AS (SELECT p.seq, p.item, max(c.b) AS m FROM p JOIN c ON c.item = p.item AND c.seq < p.seq GROUP BY ALL)
SELECT p.seq, CAST(n AS BIGINT) AS count_3 FROM p LEFT JOIN (SELECT a.seq, count(*) AS n FROM a JOIN c ON c.item = a.item AND c.seq < a.seq AND c.b >= a.m - 3 * {DAY} GROUP BY a.seq) USING (seq)""")
def window_count_pit(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    found = pit.as_of_periodic(rows.where("type = 'purchase'").select("seq", "ts", "item"), rows.where("type = 'click'"), ["item"], MS, [3])
    return found.select("seq", F.col("count_3").cast("long").alias("count_3"))


@query("two_hop_lookup", f"""WITH {EV}, h AS (SELECT seq, item AS it, usr AS u FROM ev WHERE type = 'view'), g AS (SELECT seq AS s, usr AS u, value AS v FROM ev WHERE type = 'purchase'),
f AS (SELECT p.seq, h.u FROM (SELECT seq, item FROM ev WHERE type = 'click') p ASOF LEFT JOIN h ON p.item = h.it AND p.seq > h.seq)
SELECT f.seq, g.v AS seen FROM f ASOF LEFT JOIN g ON f.u = g.u AND f.seq > g.s""")
def two_hop_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    first = rows.where("type = 'view'").select("item", "ts", "seq", F.col("user").alias("via"))
    second = rows.where("type = 'purchase'").select(F.col("user").alias("via"), "ts", "seq", "value")
    return pit.two_hop(rows.where("type = 'click'").select("seq", "ts", "item"), first, second, ["item"], "via", "value", "seen").select("seq", "seen")


@query("boolean_feature", f"WITH {EV} SELECT item, CAST(max_by(value > 50, seq) AS DOUBLE) AS flag FROM ev GROUP BY item")
def boolean_feature(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).withColumn("value", F.col("value") > 50)
    return state.last_value(rows, ["item"]).select("item", F.col("value").cast("double").alias("flag"))


def _rate_sql(keys: str, source: str, periods: tuple[int, ...]) -> str:
    def sums(kind: str) -> str:
        return ", ".join(f"sum(CASE WHEN b >= m - {p} * {DAY} THEN n END) AS {kind}{p}" for p in periods)

    def part(kind: str, name: str) -> str:
        return f"{kind} AS (SELECT {keys}, {sums(kind)} FROM (SELECT *, max(b) OVER (PARTITION BY {keys}) AS m FROM (SELECT {keys}, ts - ts % {DAY} AS b, count(*) AS n FROM {source} WHERE type = '{name}' GROUP BY ALL)) GROUP BY {keys})"

    return f"{part('t', 'click')}, {part('v', 'view')} SELECT {keys}, {', '.join(f'round(t{p} / v{p}, 6) AS rate_{p}' for p in periods)} FROM t JOIN v USING ({keys})"


def _rates(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, *(F.round(F.col("rates")[i], 6).alias(f"rate_{p}") for i, p in enumerate((7, 30))))


@query("rate_item", f"WITH {EV}, {_rate_sql('item', 'ev', (7, 30))}")
def rate_item(spark: SparkSession, d: str) -> DataFrame:
    return _rates(features.rate(interactions(spark, d), ["item"], "click", "view", MS, [7, 30]), "item")


@query("rate_item_field", f"WITH {EV}, x AS (SELECT ev.*, p_brand AS brand FROM ev JOIN part ON item = CAST(p_partkey AS VARCHAR)), {_rate_sql('brand', 'x', (7, 30))}")
def rate_item_field(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_brand").alias("brand"))
    return _rates(features.rate(interactions(spark, d).join(brands, "item"), ["brand"], "click", "view", MS, [7, 30]), "brand")


@query("rate_ranking_field", f"WITH {EV}, x AS (SELECT *, CAST(dayofweek(make_timestamp(ts * 1000)) AS BIGINT) AS day FROM ev), {_rate_sql('day, item', 'x', (7, 30))}")
def rate_ranking_field(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).withColumn("day", (F.dayofweek(F.timestamp_millis("ts")) - 1).cast("long"))
    return _rates(features.rate(rows, ["day", "item"], "click", "view", MS, [7, 30]), "day", "item")


@query("rate_normalized", f"""WITH {EV}, r AS (SELECT item, type, sum(CASE WHEN b >= m - 7 * {DAY} THEN n END) AS c FROM (SELECT *, max(b) OVER (PARTITION BY item, type) AS m FROM (SELECT item, type, ts - ts % {DAY} AS b, count(*) AS n FROM ev GROUP BY ALL)) GROUP BY item, type),
g AS (SELECT type, sum(CASE WHEN b >= m - 7 * {DAY} THEN n END) AS c FROM (SELECT *, max(b) OVER (PARTITION BY type) AS m FROM (SELECT type, ts - ts % {DAY} AS b, count(*) AS n FROM ev GROUP BY ALL)) GROUP BY type)
SELECT t.item, round((10 + t.c) / (10 * ((SELECT c FROM g WHERE type = 'view') // (SELECT c FROM g WHERE type = 'click')) + v.c), 6) AS rate_7 FROM r t JOIN r v ON t.item = v.item AND t.type = 'click' AND v.type = 'view'""")
def rate_normalized(spark: SparkSession, d: str) -> DataFrame:
    found = features.normalised_rate(interactions(spark, d), ["item"], "click", "view", MS, [7], 10.0)
    return found.select("item", F.round(F.col("rates")[0], 6).alias("rate_7"))


@query("interacted_with", f"""WITH {EV}, p AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_brand AS brand FROM part),
h AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, seq DESC) AS n, max(ts) OVER (PARTITION BY usr) AS m FROM ev WHERE type = 'click'),
b AS (SELECT usr, brand, count(*) AS n FROM (SELECT * FROM h WHERE n <= 10 AND ts >= m - 10 * {DAY}) JOIN p USING (item) GROUP BY ALL),
c AS (SELECT DISTINCT usr, item FROM ev WHERE type = 'view')
SELECT usr, item, CAST(coalesce(b.n, 0) AS DOUBLE) AS score FROM c LEFT JOIN p USING (item) LEFT JOIN b USING (usr, brand)""")
def interacted_with(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d)
    brands = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.array("p_brand").alias("values"))
    found = features.interacted_with(rows.where("type = 'view'").select("user", "item").distinct(), rows.where("type = 'click'"), brands, "user", "item", 10, 10 * MS)
    return found.select(F.col("user").alias("usr"), "item", "score")


@query("external_sort", f"WITH {EV} SELECT seq, ts FROM ev ORDER BY ts, seq")
def external_sort(spark: SparkSession, d: str) -> DataFrame:
    return E.external_sort(interactions(spark, d).select("seq", "ts"), "ts", "seq")


@query("dedup_last", f"WITH {EV} SELECT usr, item, max(seq) AS seq FROM ev GROUP BY usr, item")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).withColumn("id", F.struct("user", "item"))
    return E.last_by_id(rows, "id", "ts", "seq").select(F.col("user").alias("usr"), "item", "seq")




@query("position_lookup", f"WITH {RI} SELECT ranking, item, max(pos) AS pos FROM ri GROUP BY ranking, item")
def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking_items(spark, d)
    last = F.row_number().over(Window.partitionBy("ranking", "item").orderBy(F.col("pos").desc()))
    return rows.withColumn("n", last).where("n = 1").select("ranking", "item", "pos")

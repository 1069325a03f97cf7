"""From a configuration and events to the feature matrix of rankings, as of the moment each was shown, and to training sets.

Every stateful feature is one union-and-window join of the rankings' items with the writes of that feature, keyed by its scope. Features that need
no state are columns. Events are those of sources.events.decode; a column seq gives the order of equal timestamps (0 if it isn't there).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import agents, text
from rankweave.functions import scalar as S
from rankweave.operators import clickthrough, features, pit
from rankweave.plans.config import ConfigError, Feature, Plan


def ranking_rows(events: DataFrame) -> DataFrame:
    """A row a ranking and item: ranking, user, session, ts, seq, pos, item, relevancy, label, request (the ranking's fields)."""
    seq = F.col("seq") if "seq" in events.columns else F.lit(0).cast("long")
    shown = events.where("event = 'ranking'").select(F.col("id").alias("ranking"), "user", "session", "ts", seq.alias("seq"), F.col("fields").alias("request"), F.posexplode("items").alias("pos", "_i"))
    return shown.select("ranking", "user", "session", "ts", "seq", F.col("pos").cast("long").alias("pos"), F.col("_i.id").alias("item"), F.col("_i.relevancy").alias("relevancy"), F.col("_i.label").cast("long").alias("label"), "request")


def _scope(f: Feature) -> str:
    if f.scope not in ("item", "user", "session", "global"):
        raise ConfigError(f"feature {f.name}: no state of scope {f.scope}")
    return f.scope


def _keyed(df: DataFrame, scope: str) -> DataFrame:
    """df with _key, without rows that lack the scope's id."""
    return df.withColumn("_key", F.lit("all") if scope == "global" else F.col(scope)).where(F.col("_key").isNotNull())


def _field_writes(events: DataFrame, f: Feature, scope: str) -> DataFrame:
    """_key, ts, seq, value (the typed field) of the events that the feature's source names."""
    seq = F.col("seq") if "seq" in events.columns else F.lit(0).cast("long")
    rows = events if f.source.event == "*" else events.where(F.col("event") == f.source.event)
    if f.source.type:
        rows = rows.where(F.col("type") == f.source.type)
    return _keyed(rows, scope).select("_key", "ts", seq.alias("seq"), F.col("fields")[f.source.name].alias("value")).where(F.col("value").isNotNull())


def _looked_up(rows: DataFrame, events: DataFrame, f: Feature, out: str) -> DataFrame:
    """rows with the typed field as of the request: from the request itself for source ranking, else the state of the scope."""
    if f.source is None:
        raise ConfigError(f"feature {f.name} needs a source")
    if f.source.event == "ranking" or f.scope == "ranking":
        return rows.withColumn(out, F.col("request")[f.source.name])
    scope = _scope(f)
    # Rows without the key keep a key of their own kind, and so find nothing.
    probes = rows.withColumn("_key", F.lit("all") if scope == "global" else F.col(scope))
    return pit.as_of_last(probes, _field_writes(events, f, scope), ["_key"], "value", out).drop("_key")


def _interactions(events: DataFrame, kind: str, scope: str) -> DataFrame:
    seq = F.col("seq") if "seq" in events.columns else F.lit(0).cast("long")
    return _keyed(events.where((F.col("event") == "interaction") & (F.col("type") == kind)), scope).select("_key", "ts", seq.alias("seq"))


def _strings(v: Column) -> Column:
    return F.coalesce(v["sl"], F.when(v["s"].isNotNull(), F.array(v["s"])))


def _counts(rows: DataFrame, events: DataFrame, f: Feature, kind: str, out: str) -> DataFrame:
    """rows with the periodic counts of a type of interaction, an array by period; NULL without any."""
    periods, scope = list(f.options["periods"]), _scope(f)
    probes = rows.withColumn("_key", F.lit("all") if scope == "global" else F.col(scope))
    found = pit.as_of_periodic(probes, _interactions(events, kind, scope), ["_key"], S.duration_ms(f.options.get("bucket", "1d")), periods)
    counts = [F.col(f"count_{p}").cast("double") for p in periods]
    return found.withColumn(out, F.when(counts[0].isNotNull(), F.array(*counts))).drop("_key", *(f"count_{p}" for p in periods))


def add_feature(rows: DataFrame, events: DataFrame, f: Feature) -> DataFrame:
    """rows with a column named as the feature: double, or array of double."""
    o, name = f.options, f.name
    value = F.col("_v")
    if f.type in ("number", "boolean", "word_count", "string", "vector", "ua", "referer", "item_age"):
        seen = _looked_up(rows, events, f, "_v")
        made = {
            "number": lambda: value["n"],
            "boolean": lambda: value["b"].cast("double"),
            "word_count": lambda: S.word_count(value["s"]),
            "string": lambda: S.onehot(_strings(value), o["values"]) if o.get("encode", "index") == "onehot" else S.category_index(_strings(value), o["values"]).cast("double"),
            "vector": lambda: S.reduced(value["nl"], tuple(o.get("reduce", S.DEFAULT_REDUCERS))),
            "ua": lambda: S.onehot(F.array(agents.agent_value(value["s"], o["field"])), [n for n, _ in agents.AGENT_FIELDS[o["field"]]]),
            "referer": lambda: agents.medium_index(agents.medium(value["s"])).cast("double"),
            "item_age": lambda: S.as_of_age(F.col("ts"), F.coalesce(value["n"] * 1000, S.event_millis(value["s"]))),
        }[f.type]()
        return seen.withColumn(name, made).drop("_v")
    if f.type == "relevancy":
        return rows.withColumn(name, F.col("relevancy"))
    if f.type == "position":
        return rows.withColumn(name, F.col("pos").cast("double"))
    if f.type == "random":
        return rows.withColumn(name, S.noise("ranking", "pos"))
    if f.type == "local_time":
        at = S.wall_clock(F.col("request")[f.source.name]["s"]) if f.source and f.source.name != "timestamp" else F.timestamp_millis("ts").cast("timestamp_ntz")
        return rows.withColumn(name, S.TIME_MAPPERS[o["parse"]](at))
    if f.type == "interaction_count":
        scope = _scope(f)
        probes = rows.withColumn("_key", F.lit("all") if scope == "global" else F.col(scope))
        return pit.as_of_count(probes, _interactions(events, o["interaction"], scope), ["_key"], name).withColumn(name, F.col(name).cast("double")).drop("_key")
    if f.type == "window_count":
        return _counts(rows, events, f, o["interaction"], name)
    if f.type == "rate":
        both = _counts(_counts(rows, events, f, o["top"], "_top"), events, f, o["bottom"], "_bottom")
        if "normalize" not in o:
            return both.withColumn(name, F.zip_with("_top", "_bottom", lambda t, b: F.try_divide(t, b))).drop("_top", "_bottom")
        # Drawn to the rate of all: (weight + top) / (weight * (all bottom div all top) + bottom), with whole-number division.
        weight, whole = float(o["normalize"]["weight"]), replace(f, scope="global")
        both = _counts(_counts(both, events, whole, o["top"], "_all_top"), events, whole, o["bottom"], "_all_bottom")
        parts = [F.try_divide(weight + F.get("_top", F.lit(i)), weight * F.floor(F.try_divide(F.get("_all_bottom", F.lit(i)), F.get("_all_top", F.lit(i)))) + F.get("_bottom", F.lit(i))) for i in range(len(o["periods"]))]
        some = F.col("_top").isNotNull() & F.col("_bottom").isNotNull()
        return both.withColumn(name, F.when(some, F.array(*parts))).drop("_top", "_bottom", "_all_top", "_all_bottom")
    if f.type == "diversity":
        seen = _looked_up(rows, events, f, "_v")
        if o.get("values", "number") == "number":
            return features.diversity_number(seen.withColumn("_n", value["n"]), "ranking", "pos", "_n", o.get("top", 20)).withColumnRenamed("diversity", name).drop("_v", "_n")
        return features.diversity_string(seen.withColumn("_s", _strings(value)), "ranking", "pos", "item", "_s", o.get("top", 20)).withColumnRenamed("diversity", name).drop("_v", "_s")
    if f.type == "field_match" and o.get("method", "term") in ("term", "ngram"):
        seen = _looked_up(rows, events, f, "_v")
        a, b = text.terms(F.col("request")[o["ranking_field"]]["s"]), text.terms(value["s"])
        score = text.jaccard(text.ngrams(a, o.get("n", 3)), text.ngrams(b, o.get("n", 3))) if o.get("method") == "ngram" else text.jaccard(text.unique(a), text.unique(b))
        return seen.withColumn(name, score).drop("_v")
    raise ConfigError(f"feature {name}: {f.type} isn't computed from a configuration; call its operator")


def feature_rows(plan: Plan, model: str, events: DataFrame) -> DataFrame:
    """ranking_rows with a column a feature of the model."""
    rows = ranking_rows(events)
    for name in plan.models[model]["features"]:
        rows = add_feature(rows, events, plan.features[name])
    return rows


def training_set(plan: Plan, model: str, events: DataFrame, gap_ms: int = clickthrough.SESSION_MS) -> DataFrame:
    """ranking, pos, item, label, features (array): rankings with interactions in session, labelled by the model's weights of their types; explicit labels come first."""
    rows = feature_rows(plan, model, events)
    seq = F.col("seq") if "seq" in events.columns else F.lit(0).cast("long")
    shown = events.where("event = 'ranking'").select(F.col("id").alias("ranking"), F.col("ts").alias("shown"))
    clicks = events.where("event = 'interaction'").select("ranking", "item", "type", "ts", seq.alias("seq")).join(shown, "ranking")
    given = clickthrough.explicit_labels(rows.select("ranking", "item", "label", "ts", "pos")).select("ranking", "item", "type", F.lit(2**62).cast("long").alias("ts"), "seq")
    inside = clickthrough.sessions(clicks, gap_ms).where("in_session").select("ranking", "item", "type", "ts", "seq").unionByName(given)
    labelled = clickthrough.labels(rows, inside, plan.models[model].get("weights", {"click": 1.0}))
    kept = labelled.join(inside.select("ranking").distinct(), "ranking", "left_semi")
    order = [F.col(n) for n in plan.models[model]["features"]]
    sizes = plan.width(model)
    filled = [F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), sizes[n][1])) if kept.schema[n].dataType.typeName() == "array" else c for c, n in zip(order, sizes, strict=True)]
    return clickthrough.vectorize(kept, filled).select("ranking", "pos", "item", "label", "features")

"""Event sources: JSON files and arrays, Snowplow exports, Kafka; offsets; the schema of events; sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.scalar import duration_ms, event_millis

FIELD = "struct<s: string, b: boolean, n: double, sl: array<string>, nl: array<double>>"
RAW_FIELD = "struct<name: string, value: variant>"
#: The shape of all kinds of event; parts that a kind lacks are NULL. Field values keep their JSON type until they are decoded.
RAW = f"event string, id string, timestamp string, item string, user string, session string, ranking string, type string, fields array<{RAW_FIELD}>, items array<struct<id: string, relevancy: double, label: int, fields: array<{RAW_FIELD}>>>"


def typed_field(value: Column) -> Column:
    """A JSON value (variant) as the one of string, boolean, number, list of strings, list of numbers that it is; an empty list is one of strings.

    All parts are NULL for others: null, objects, lists that mix types or have a null.
    """
    kind = F.schema_of_variant(value)

    def listed(of: str) -> Column:
        whole = F.try_variant_get(value, "$", f"array<{of}>")
        return F.when(F.forall(whole, lambda x: x.isNotNull()), whole)

    return F.struct(
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("s"),
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("b"),
        F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double")).alias("n"),
        F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), listed("string")).alias("sl"),
        F.when(kind.rlike("^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL)"), listed("double")).alias("nl"),
    )


def checked(raw: DataFrame) -> DataFrame:
    """raw with metadata read as item, ts (milliseconds), fields a map of typed values (the first of a name), and error: why the event can't be taken, or NULL."""
    given = F.coalesce("fields", F.array().cast(f"array<{RAW_FIELD}>"))
    typed = F.transform(given, lambda f: F.struct(f["name"].alias("key"), typed_field(f["value"]).alias("value")))
    untyped = F.exists("_typed", lambda f: f["key"].isNull() | F.coalesce(f["value"]["s"].cast("string"), f["value"]["b"].cast("string"), f["value"]["n"].cast("string"), F.when(f["value"]["sl"].isNotNull() | f["value"]["nl"].isNotNull(), "list")).isNull())
    first = F.aggregate("_typed", F.array().cast(f"array<struct<key: string, value: {FIELD}>>"), lambda acc, f: F.when(f["key"].isNull() | F.exists(acc, lambda a: a["key"] == f["key"]), acc).otherwise(F.concat(acc, F.array(f))))
    lacks = {"item": F.col("item").isNull(), "user": F.col("user").isNull(), "ranking": F.size(F.coalesce("items", F.array())) <= 0, "interaction": F.col("item").isNull() | F.col("type").isNull()}
    rows = raw.withColumn("event", F.when(F.col("event") == "metadata", "item").otherwise(F.col("event"))).withColumn("ts", event_millis(F.col("timestamp"))).withColumn("_typed", typed)
    error = F.when(F.col("event").isNull(), "no event").when(~F.col("event").isin(*lacks), "unknown kind of event").when(F.coalesce(F.length("id"), F.lit(0)) == 0, "no id").when(F.col("ts").isNull(), "no timestamp")
    for kind, lack in lacks.items():
        error = error.when((F.col("event") == kind) & lack, f"no part that the kind {kind} needs")
    return rows.withColumn("error", error.when(untyped, "field of no known type")).withColumn("fields", F.map_from_entries(first)).drop("_typed", "timestamp")


def decode(raw: DataFrame) -> DataFrame:
    """The events of raw that can be taken (see checked)."""
    return checked(raw).where(F.col("error").isNull()).drop("error")


def read_checked(spark: SparkSession, path: str, glob: str = "*.json*", array: bool = False) -> DataFrame:
    """checked() events of a file or folder (with all below it), one JSON value a line, or arrays; gzip and zstd by extension. Lines that aren't JSON have an error and _line, their text."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob, "multiLine": str(array).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    return checked(spark.read.schema(RAW + ", _line string").options(**options).json(path))


def read_json(spark: SparkSession, path: str, glob: str = "*.json*", array: bool = False, bad: str | None = None) -> DataFrame:
    """The events of read_checked that can be taken. The others are written to the folder bad, if given, with what is wrong; else they are left out."""
    rows = read_checked(spark, path, glob, array)
    if bad is not None:
        rows.where(F.col("error").isNotNull()).select("error", "_line", "event", "id", "ts").write.mode("append").json(bad)
    return rows.where(F.col("error").isNull()).drop("error", "_line")


def read_cache(spark: SparkSession, path: str, scores: bool = False, skip: int = 0) -> DataFrame:
    """A CSV cache, quoted as RFC 4180: key, vector (array of double) of texts; with scores, left, right, score of pairs of texts. skip leaves out so many first lines of each file."""
    lines = spark.read.option("header", skip > 0).option("multiLine", True).option("escape", '"').csv(path)
    names = lines.columns
    if scores:
        return lines.select(F.col(names[0]).alias("left"), F.col(names[1]).alias("right"), F.col(names[2]).cast("double").alias("score"))
    return lines.select(F.col(names[0]).alias("key"), F.array(*(F.col(c).cast("double") for c in names[1:])).alias("vector"))


def in_file_order(events: DataFrame, by: str = "name") -> DataFrame:
    """events with a sort key (file, then place in it) for orders by name or time of file."""
    first = "_metadata.file_name" if by == "name" else "_metadata.file_modification_time"
    return events.withColumn("_file", F.col(first)).withColumn("_place", F.monotonically_increasing_id())


def parse_snowplow_tsv(lines: DataFrame, allowed: list[str], column: str = "value") -> DataFrame:
    """The data of the self-describing event in field 58 (from 0), where its schema is allowed: schema, data (JSON)."""
    event = F.get(F.split(column, "\t"), F.lit(58))
    schema = F.get_json_object(event, "$.data.schema")
    return lines.select(schema.alias("schema"), F.get_json_object(event, "$.data.data").alias("data")).where(F.col("schema").isin(*allowed))


def parse_snowplow_json(lines: DataFrame, allowed: list[str], column: str = "value") -> DataFrame:
    schema = F.get_json_object(column, "$.unstruct_event.data.schema")
    return lines.select(schema.alias("schema"), F.get_json_object(column, "$.unstruct_event.data.data").alias("data")).where(F.col("schema").isin(*allowed))


def from_offset(events: DataFrame, offset: str, now_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """Events from an offset: earliest, latest (none of those that are there), ts=N (milliseconds), last=N[smhd]."""
    if offset == "earliest":
        return events
    if offset == "latest":
        return events.limit(0)
    kind, value = offset.split("=")
    if kind == "ts":
        return events.where(F.col(ts) >= int(value))
    if now_ms is None:
        raise ValueError("last= needs the present time")
    return events.where(F.col(ts) >= now_ms - duration_ms(value))


def read_kafka(spark: SparkSession, servers: str, topic: str, offset: str = "latest") -> DataFrame:
    """A stream of events from Kafka (needs the connector package); the checkpoint makes it exactly once."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if offset.startswith("ts="):
        stream = stream.option("startingTimestamp", offset[3:])
    else:
        stream = stream.option("startingOffsets", offset)
    return decode(stream.load().select(F.from_json(F.col("value").cast("string"), RAW).alias("e")).select("e.*"))


def external_sort(events: DataFrame, *by: str) -> DataFrame:
    """All events in order of time: a range partitioning and a sort that spills."""
    return events.orderBy(*(by or ("ts",)))


def last_by_id(rows: DataFrame, id_col: str, *order: str) -> DataFrame:
    """One row an id: the last written."""
    last = rows.groupBy(id_col).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return last.select("_row.*")


# Sinks.


def write_training(rows: DataFrame, path: str, max_rows_a_file: int = 1_000_000) -> None:
    """Click-throughs or values, appended as compressed Parquet in files of bounded size."""
    rows.write.mode("append").option("maxRecordsPerFile", max_rows_a_file).option("compression", "zstd").parquet(path)


def write_libsvm(rows: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """label and non-zero features from 1, a line a row."""
    pairs = F.filter(F.transform(features, lambda v, i: F.when((v != 0) & ~F.isnan(v), F.concat_ws(":", i + 1, v))), lambda x: x.isNotNull())
    rows.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " ")).alias("value")).write.mode("error").text(path)


def write_csv(rows: DataFrame, path: str, names: list[str], label: str = "label", group: str = "ranking", features: str = "features") -> None:
    """label, group and a column a feature, with a header."""
    rows.select(F.col(label).alias("label"), F.col(group).alias("group"), *(F.col(features)[i].alias(n) for i, n in enumerate(names))).write.mode("error").option("header", True).csv(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")) if fs.exists(folder) else []


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that write_state finished."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no state in {path}")
    return spark.read.parquet(f"{path}/{versions[-1]}")


def write_state(values: DataFrame, path: str) -> None:
    """Feature values, latest of each key, as a new version beside those that are there. It counts once its folder is renamed, so a job that fails leaves the old one."""
    spark = values.sparkSession
    fs, _ = _folder(spark, path)
    mark = uuid.uuid4().hex
    version = f"{max([int(n[1:]) for n in _versions(spark, path)], default=0) + 1:012d}"
    values.write.mode("error").option("compression", "zstd").parquet(f"{path}/_new-{version}-{mark}")
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(new(f"{path}/_new-{version}-{mark}"), new(f"{path}/v{version}")):
        raise OSError(f"can't name version {version} of {path}")


def write_term_frequencies(stats: DataFrame, df: DataFrame, path: str) -> None:
    """docs, avgdl and term counts as JSON lines; fails if the path is there."""
    df.crossJoin(F.broadcast(stats)).write.mode("error").json(path)  # stats is one row


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()

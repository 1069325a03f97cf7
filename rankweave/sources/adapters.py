"""The driver's tables as events of the ranking model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINUTE, DAY = 60_000, 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str):
    """Milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, item, user, type, value of the events table; view is an impression, click and purchase are interactions."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), millis("ts").alias("ts"), F.get_json_object("props", "$.k").alias("item"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"), "value")


def ranking_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a ranking and position: ranking, user, ts, pos (from 0), item, label (0 to 2), price, quantity, relevancy, of orders and their lines."""
    lines = table(spark, sf_dir, "lineitem")
    total = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    placed = lines.withColumn("pos", (F.row_number().over(total) - 1).cast("long"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ranking"), F.col("o_custkey").cast("string").alias("user"), millis("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority"))
    label = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return placed.join(orders, placed.l_orderkey == orders.ranking).select("ranking", "user", "ts", "priority", "pos", F.col("l_partkey").cast("string").alias("item"), label.cast("long").alias("label"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("relevancy"))


def ranking_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of rankings: ranking, item, user, type, ts, seq. A line with a label is one; they follow the order at gaps of their quantity in minutes."""
    lines = ranking_items(spark, sf_dir).where("label > 0")
    after = F.sum("quantity").over(Window.partitionBy("ranking").orderBy("pos"))
    kind = F.when(F.col("label") == 2, "purchase").otherwise("click")
    return lines.select("ranking", "item", "user", kind.alias("type"), (F.col("ts") + after.cast("long") * MINUTE).alias("ts"), F.col("pos").alias("seq"), F.col("ts").alias("shown"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item and its fields of the part table."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))

"""Session defaults. A session that already exists keeps its own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "rankweave", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and those that plans profit from (AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )

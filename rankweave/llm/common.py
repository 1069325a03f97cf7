"""What the corpus operators share: scratch tables in the shared folder, Arrow batches of bounded size, small text helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode. Elsewhere it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="rankweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/rankweave/{name}-{uuid.uuid4().hex}"


#: Rows of a file, about, of tables with short rows whose number is bounded.
FILE_ROWS = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df written to the shared folder and read again: computed once, and safe when executors are lost.

    rows: df has at most so many, and short ones; it gets as many files as they need, whatever the number of shuffle partitions.
    For tables whose last stage is light, as that many tasks then run it.
    """
    return stored_at(df if rows is None else df.coalesce(rows // FILE_ROWS + 1), name)[0]


#: Rows, and bytes of them, up to which a table stays in the plan.
FEW_ROWS, FEW_BYTES = 10_000, 1_000_000


def held(df: DataFrame, name: str, rows: int, size: int) -> DataFrame:
    """The rows of df, computed once: the driver holds them in the plan, or they are stored if rows or size (bytes), their bounds, are above FEW_ROWS or FEW_BYTES.

    For the small tables of loops: a stored one costs the driver a job, a commit and, on local files, a process for each folder and file that it makes.
    """
    if rows > FEW_ROWS or size > FEW_BYTES:
        return stored(df, name, rows)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


#: Spark drops a plan's shuffle files when it has run; a plan that is written runs once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and where: for tables to drop before the query ends."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        # Nothing looks for the marker of a scratch table, which the driver would write.
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: they needn't have it on their path."""
    if spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="rankweave-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds what a Python worker holds at once, whatever the length of the texts; and lets workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches into parts of at most size bytes of text each; a single longer text is a part of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def estimated_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, by one aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)

"""Secret scans with an incremental blob ledger.

Every historical version of every path is addressed by the SHA-256 of its content. Only blobs that the ledger does not have for
this rule version are read again and scanned, once each however many paths and versions carry them; their findings (none, too)
are appended to the ledger, and the ledger's findings are joined back to all paths by digest.

Defined results: a null text is an empty blob; repeated rows (of path and text) come back as often as they came, and their blob may be
scanned as often, but counts once; null path columns stay null.
Spans are in code points, end exclusive, by start and then by the order of the rules; matches of one rule don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, scratch, slices, stored

SPANS = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern; the shortest accepted length of one of its groups; texts without any of the hints can't match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Published formats of further credentials.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----", 0, 0, ("-----BEGIN ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyJ",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0, ("AIza",)),
    Rule("url_login", r"://[^/\s:@]{1,100}:[^/\s:@]{1,100}@", 0, 0, ("://",)),
)

RULES = BASE + EXTRA


def scanner(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[str, int, int]]]:
    """A function from a text to its (kind, start, end)."""
    compiled = [(i, r, re.compile(r.pattern)) for i, r in enumerate(rules)]

    def scan(text: str) -> list[tuple[str, int, int]]:
        found = []
        for i, rule, pattern in compiled:
            if not rule.hints or any(h in text for h in rule.hints):
                found += [(m.start(), i, rule.kind, m.end()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    return scan


def _ledger(spark, path: str, rule_version: str, only: Column | None = None) -> DataFrame:
    """digest, spans of the ledger's blobs for a rule version, only those if given; a blob that two runs appended counts once."""
    try:
        found = spark.read.schema(f"digest binary, spans {SPANS}, rule_version string").parquet(path).where((F.col("rule_version") == rule_version) & (F.lit(True) if only is None else only))
    except AnalysisException:  # no run has written it yet
        found = spark.createDataFrame([], f"digest binary, spans {SPANS}")
    return found.select("digest", "spans").dropDuplicates(["digest"])


def scan_versions(versions: DataFrame, path_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = "1", ledger: str | None = None) -> DataFrame:
    """One row per row of versions: path_cols, digest (binary), spans. ledger: a folder kept between runs; None: a new one.

    rule_version must change whenever rules do. path_cols identify a version of a path, such as repository, path and commit.
    """
    spark = versions.sparkSession
    bounded_batches(spark)
    ledger = ledger or scratch(spark, "ledger")
    blobs = versions.select(F.struct(*path_cols).alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    paths = stored(blobs.select("at", "digest"), "paths")
    fresh = paths.groupBy("digest").agg(F.min("at").alias("at")).join(_ledger(spark, ledger, rule_version).select("digest"), "digest", "left_anti")
    # The join's keys have the path, so that copies of a blob are dealt evenly and all but one fall out; texts are neither sorted nor kept.
    unseen = blobs.join(fresh.hint("shuffle_hash").select(F.col("at").alias("_at"), F.col("digest").alias("_digest")), F.col("at").eqNullSafe(F.col("_at")) & (F.col("digest") == F.col("_digest"))).select("digest", "text")
    scan = scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x)] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["digest", "spans"])

    unseen.mapInArrow(run, f"digest binary, spans {SPANS}").withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    # Blobs without findings, such as the empty one that all null texts share, take no part in the join.
    findings = _ledger(spark, ledger, rule_version, F.size("spans") > 0)
    joined = paths.join(findings, "digest", "left")
    return joined.select(*(F.col("at")[c].alias(c) for c in path_cols), "digest", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

"""The registered queries of the corpus operators: each applies its operator to its whole table and derives the columns of the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import language_id, oracle
from rankweave.llm.common import table
from rankweave.llm.decontaminate import decontaminate
from rankweave.llm.licenses import scan_licenses
from rankweave.llm.mixing import mix_sources
from rankweave.llm.ngram_join import ngram_join
from rankweave.llm.pseudonyms import pseudonymise
from rankweave.llm.repetition import repetition
from rankweave.llm.secret_ledger import BASE, scan_versions
from rankweave.llm.url_rules import ListedRule, filter_urls
from rankweave.llm.warc import round_trip


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select(F.struct("doc_id", "held_out").alias("id"), "text"), model, "id").select("id.doc_id", "id.held_out", "lang_pred", "score")


#: The key of registered queries; a production run brings its own.
KEY = "rankweave"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY, found_col="found").select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), F.array_join(F.transform("found", lambda x: x["kind"]), ",").alias("kinds"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(found.gram_chars[i].alias(f"chars_in_repeated_{n}grams") for i, n in enumerate(range(6, 11))), "dup_line_chars")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE)))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unknown")


#: The listed rules of the query.
LISTED = [ListedRule("allow", "com", "/"), ListedRule("block", "example.com", "/en/"), ListedRule("allow", "www.example.com", "/en/"), ListedRule("block", "net", "/es/"), ListedRule("block", "net", "/fr/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), LISTED).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_repetition": op6_repetition,
    "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses,
    "op9_urls": op9_urls,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": oracle.OP4,
    "op6_repetition": oracle.OP6,
    "op8_licenses": oracle.OP8,
    "op10_ngram_join": oracle.OP10,
}

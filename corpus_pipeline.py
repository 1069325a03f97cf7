"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, mixture.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each works on all that the one before it
kept. All but the last return the columns of documents. Decisions are by row content (id and text), so rows that repeat both
share one. The last returns them with the mixture's columns. run() writes what each stage returns to the shared folder and reads it for the next.

What goes: documents without text or letters and those in no learned language (language), all but the least id of each
component of near duplicates (near_duplicates), documents with a benchmark window (decontaminate). Documents without any
shingle or word pass the later stages unchanged; a mixture takes them with no words. Null texts, languages and sources are allowed in every stage; a
null text is in no language. An empty table gives an empty one, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm import language_id
from rankweave.llm.common import stored
from rankweave.llm.decontaminate import decontaminate
from rankweave.llm.mixing import mix_sources
from rankweave.llm.ngram_join import ngram_join
from rankweave.llm.pseudonyms import pseudonymise
from rankweave.llm.queries import KEY

#: Below this margin of every language against the rest, a text is in no learned language. It drops none of the
#: 10,000 texts of sf0.1; in a trial, texts of 20 characters or more in five unlearned languages and of random letters had -0.15 at most.
LEAST_MARGIN = -0.13
#: Keys of rows (about 100 bytes each) up to which decisions are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 100_000
#: Texts with fewer letters are too short to tell, and stay.
LEAST_LETTERS = 20


def _content() -> Column:
    """What identifies a row to its decision: the id and a digest of the text."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), F.col("text").isNull().cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns, so that no name clashes) and key."""
    return docs.select(F.struct(*docs.columns).alias("row"), _content().alias("key"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose content is in gone (key)."""
    return _keyed(docs).join(gone, "key", "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    judged = language_id.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, "row")
    short = ~F.col("row")["text"].rlike(rf"^(?:\P{{L}}*+\p{{L}}){{{LEAST_LETTERS}}}")
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("own_margin") >= LEAST_MARGIN) | short)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = stored(ngram_join(docs.select("doc_id", "text", _content().alias("key")).select(F.struct("doc_id", "key").alias("id"), "text"), "id"), "near", docs.count())
    # Rows that repeat id and text are the same row of the join: of those, and only those, one of each is taken.
    gone = joined.where(F.col("id") != F.col("component_id")).select(F.col("id.key").alias("key"), F.lit(True).alias("gone"))
    twice = joined.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id.key").alias("key"), F.lit(False).alias("gone"))
    told = stored(gone.unionByName(twice).groupBy("key").agg(F.max("gone").alias("gone")), "told", joined.count())
    # One join for both, so that texts move once at most.
    rows = _keyed(docs).join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, "key", "left")
    single = rows.where(F.col("gone").isNull()).select("row.*")
    again = rows.where(~F.col("gone")).dropDuplicates(["key"]).select("row.*")
    return single.unionByName(again)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs.select(_content().alias("key"), "text"), benchmark, "key")
    return _without(docs, stored(found.where("contaminated").select("key").distinct(), "contaminated", docs.count()))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken of the mix; one whose name docs has is called mix_ and that name."""
    mixed = stored(mix_sources(docs.select(_content().alias("key"), "text", "source"), "key"), "mixed", docs.count())
    own = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "rate", "copies", "taken")]
    twice = stored(mixed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice", mixed.count())
    rows = _keyed(docs)
    # Rows that repeat id and text share a key, and have their copies in any order; no other rows are numbered.
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))).alias("nth")
    single = rows.join(twice, "key", "left_anti").join(mixed, "key")
    again = rows.join(twice, "key", "left_semi").select("key", "row", nth).join(mixed.join(twice, "key", "left_semi").select("*", nth), ["key", "nth"])
    return single.select("row.*", *own).unionByName(again.select("row.*", *own))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", private),
    ("mixture", mixture),
]

#: SQL can't express the fitted classifier of the first stage or the keyed permutations of the fourth.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

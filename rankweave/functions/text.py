"""Text matching: tokens, n-grams, Jaccard, BM25, cosine; term statistics; an English analyzer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common English words that the English analyzer leaves out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

#: BM25 parameters.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def unique(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct n-grams of characters of each token, in order; tokens shorter than n have none."""
    # Every token once, then one pattern that looks ahead at each character (not from within a surrogate pair); tokens have no spaces.
    return unique(F.regexp_extract_all(F.array_join(F.array_distinct(tokens), " "), F.lit(rf"(?=([^ \uDC00-\uDFFF][^ ]{{{n - 1}}}))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct elements; 0.0 if either is empty or missing."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)), F.lit(0.0))


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25_term(docs: Column, avgdl: Column, df: Column, length: Column) -> Column:
    """A query term's part of the score for a document of so many distinct terms that has it (a term counts once)."""
    return idf(docs, df) * (K1 + 1) / (1 + K1 * (1 - B + B * length / avgdl))


def bm25(query: Column, doc: Column, docs: Column, avgdl: Column, df: Column) -> Column:
    """BM25 of two arrays of distinct terms; df is a map from term to its document frequency (absent: 0)."""
    score = F.aggregate(
        F.array_intersect(query, doc),
        F.lit(0.0),
        lambda acc, t: acc + bm25_term(docs.cast("double"), avgdl, F.coalesce(F.try_element_at(df, t), F.lit(0)).cast("double"), F.size(doc).cast("double")),
    )
    return F.coalesce(score, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if a vector is missing or has length 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def term_frequencies(docs: DataFrame, fields: list[str], tokens=terms) -> tuple[DataFrame, DataFrame]:
    """(docs, avgdl) of one row and (term, df): documents, mean distinct terms of a field, documents with the term in any field."""
    lists = docs.select(*(F.array_distinct(tokens(F.col(f))).alias(f) for f in fields))
    sizes = sum((F.coalesce(F.size(f), F.lit(0)) for f in fields), F.lit(0))
    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    stats = lists.agg(F.count("*").alias("docs"), (F.sum(sizes) / F.nullif(F.sum(present), F.lit(0))).alias("avgdl"))
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields))))
    return stats, lists.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(stem))


def stem_english(word: str) -> str:
    """A light suffix stemmer for English: plurals, -ed, -ing, -ly and common noun endings, guarded by the stem's measure."""
    if len(word) < 4:
        return word
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + new
            break
    for ending in ("ing", "ed"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and _has_vowel(stem):
            word = stem + "e" if stem.endswith(("at", "bl", "iz")) else stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz" else stem
            break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for ending, new in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ement", ""), ("ment", ""), ("ness", ""), ("ousli", "ous"), ("entli", "ent"), ("alli", "al"), ("eli", "e")):
        if word.endswith(ending) and _measure(word[: len(word) - len(ending)]) > 0:
            word = word[: len(word) - len(ending)] + new
            break
    return word[:-1] if word.endswith("e") and _measure(word[:-1]) > 1 else word


def english_terms(text: Column) -> Column:
    """Stemmed English terms without stop words, in order; Arrow batches, as stemming isn't a Spark function."""
    stop, word = frozenset(STOP_WORDS), r"[^\W_]+"

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find, known = re.compile(word).findall, {}
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [known.setdefault(w, stem_english(w)) for w in find(t.lower()) if w not in stop])

    return run(text)

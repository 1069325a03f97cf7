"""Repetition coverage: how much of a text lies in word n-grams and lines that the same text has more than once.

Words are the maximal runs of characters other than ASCII whitespace. A text's n-grams get rolling polynomial hashes over the
words' 64-bit codes in numpy, for several n; a character counts once however many repeated n-grams cover its word.

Defined results: a null or empty text has no words, and fails for want of them; repeated rows are judged one by one; columns
of the input other than id and text are passed by (their names can't clash).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, slices

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A text is dropped if the share in percent of its word characters exceeds a limit: in repeated n-grams, or in repeated lines."""

    min_words: int = 10
    repeat_words_pct: int = 20
    gram_pct: tuple[tuple[int, int], ...] = ((6, 20), (7, 18), (8, 16), (9, 14), (10, 12))
    line_pct: int = 30


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring codes give unrelated hashes."""
    x = codes.astype(np.uint64) * _ODD + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each n of sizes, the hash of every run of n codes; each length extends the one before it by a word."""
    found: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        each = _mixed(codes)
        now = each
        for n in range(1, max(sizes) + 1):
            if n > 1:
                if len(each) < n:
                    break
                now = now[:-1] * _ODD + each[n - 1 :]
            if n in sizes:
                found[n] = now
    return found


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for each word inside an n-gram whose hash occurs at least twice."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return np.zeros(words, bool)
    twice = np.zeros(len(ordered), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters in repeated n-grams by n, in repeated lines, base_failed, kept."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    total = int(lengths.sum())
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(map(len, _WORDS.findall(line)))
            elif line and _WORDS.search(line):
                seen.add(line)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    sizes = (5, *(k for k, _ in limits.gram_pct))
    marks = {k: covered(h, k, n) for k, h in rolling(codes, sizes).items()} if n and len(ids) < n else {}
    repeat_words = int(marks[5].sum()) if 5 in marks else 0
    chars = [int(lengths[marks[k]].sum()) if k in marks else 0 for k, _ in limits.gram_pct]
    base_failed = n < limits.min_words or 100 * repeat_words > limits.repeat_words_pct * n
    over = any(100 * c > pct * total for c, (_, pct) in zip(chars, limits.gram_pct, strict=True)) or 100 * dup_line_chars > limits.line_pct * total
    return n, total, len(_SYMBOLS.findall(text)), dup_lines, repeat_words, chars, dup_line_chars, base_failed, not base_failed and not over


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of docs: the id, counts, gram_chars (characters in repeated n-grams, by the n of limits), dup_line_chars, base_failed, kept."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"row_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, gram_chars array<long>, dup_line_chars long, base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()]
        names = ["row_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "gram_chars", "dup_line_chars", "base_failed", "kept"]
        for part in slices(batches, "text"):
            rows = [measure(x, limits) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, out).withColumnRenamed("row_id", id_col)

"""Language identification by hierarchical discrimination over hashed byte n-grams of whole texts.

A one-versus-rest linear SVM picks the language family, then one-versus-one linear SVMs vote within it, where languages are close. Features
are the square roots of a text's shares of byte n-grams (of 1 to 4 bytes, ASCII letters lower-cased, every run of other ASCII
characters one space), hashed to DIMENSIONS slots; their vectors have length 1.

The score compares learned languages with each other only. Whether a text is in any of them is told by a further one-versus-rest SVM a language: the
greatest of their margins (own_margin) is low for texts in no learned language. It tells most with three languages or more, and little with one.

Fitting uses a bounded sample: of each language, the per_language different labelled texts of the least hashes. Prediction reads the
text alone, and all of it.

Defined results: a null text or one without a letter is und with score 0, as is everything if nothing was labelled; with one
language learned, that one; repeated rows are judged one by one; other columns are passed by.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, slices
from rankweave.llm.tokens import text_bytes

DIMENSIONS = 8192
UNKNOWN = "und"
#: Families by language code; a code that isn't here is of the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk tr uz",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_WORDLIKE = re.compile(r"[^\W\d_]")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_PRIME = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    """Whether a character is of one of Unicode's classes of letters (\\p{L}): the same rule as in fitting."""
    return text is not None and any(unicodedata.category(m[0])[0] == "L" for m in _WORDLIKE.finditer(text))


def held_out(id_col: str) -> Column:
    """The fifth of rows that fitting never sees: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, a vector of DIMENSIONS a text."""
    data, offsets = text_bytes(column)
    data = _PLAIN[data]
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    keep[inner] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = data[keep].astype(np.uint32), at[offsets]
    shift = np.uint32(32 - int(math.log2(DIMENSIONS)))
    slots = []
    with np.errstate(over="ignore"):
        gram = data.copy()
        for n in range(1, 5):
            if n > 1:
                gram = gram[:-1] * np.uint32(257) + data[n - 1 :] if len(gram) else gram
            slots.append((((gram + np.uint32(n * 7919)) * _PRIME) >> shift).astype(np.int32))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.bincount(np.concatenate([s[a : max(b - n, a)] for n, s in enumerate(slots)]), minlength=DIMENSIONS)


def unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


class Vectors:
    """Vectors of DIMENSIONS by their slots that aren't 0: the driver's memory holds no matrix. x[i] is a whole vector, good until the next is asked for."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray]):
        self.slots, self.values = slots, values
        self._row, self._filled = np.zeros(DIMENSIONS, np.float32), np.zeros(0, np.uint16)

    def __len__(self) -> int:
        return len(self.slots)

    def __getitem__(self, i: int) -> np.ndarray:
        self._row[self._filled] = 0
        self._filled = self.slots[i]
        self._row[self._filled] = self.values[i]
        return self._row

    def norms(self) -> np.ndarray:
        """Squared lengths."""
        return np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", (v := self[i])[None], v[None]) for i in range(len(self)))])


def svm(x: Vectors, y: np.ndarray, rows: np.ndarray | None = None, cost: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss on some rows of x, by dual coordinate descent. y is 1 or -1."""
    rows = np.arange(len(x)) if rows is None else rows
    norms = x.norms() + 1 + 0.5 / cost
    alpha, w, bias, rng = np.zeros(len(x)), np.zeros(DIMENSIONS, np.float32), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(rows):
            v = x[i]
            step = max(alpha[i] - (y[i] * (float(v @ w) + bias) - 1 + 0.5 / cost * alpha[i]) / norms[i], 0.0) - alpha[i]
            if abs(step) > 1e-9:
                alpha[i] += step
                w += np.float32(step * y[i]) * v
                bias += step * y[i]
    return np.append(w, np.float32(bias))


@dataclass
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]
    own_weights: np.ndarray | None = None

    def own_margin(self, x: np.ndarray) -> float:
        """The greatest margin of a language against the rest."""
        return 0.0 if self.own_weights is None else max(float(w[:-1] @ x + w[-1]) for w in self.own_weights)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the confidence in the family times that in the language within it."""
        if not self.families:
            return UNKNOWN, 0.0
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            order = np.argsort(-margins, kind="stable")
            family = self.families[order[0]]
            score = _confidence(float(margins[order[0]] - margins[order[1]]))
        votes: Counter[str] = Counter()
        margin: dict[str, list[float]] = {m: [] for m in self.members[family]}
        for a, b in combinations(self.members[family], 2):
            w = self.pair_weights[a, b]
            m = float(w[:-1] @ x + w[-1])
            votes[a if m >= 0 else b] += 1
            margin[a].append(m)
            margin[b].append(-m)
        best = max(self.members[family], key=lambda k: (votes[k], sum(margin[k])))
        return best, score * (_confidence(2 * min(margin[best])) if margin[best] else 1.0)


def _confidence(margin: float) -> float:
    return 1 / (1 + math.exp(-max(min(2 * margin, 50.0), -50.0)))


def fit(x: Vectors, langs: list[str]) -> LanguageModel:
    """A model of the first rows of x, one a language in langs; rows after these are in no language."""
    labelled = np.arange(len(langs))
    names = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for n in names:
        members.setdefault(_FAMILY.get(n, "other"), []).append(n)
    families = sorted(members)
    of = np.array([families.index(_FAMILY.get(k, "other")) for k in langs])
    weights = np.stack([svm(x, np.where(of == i, 1, -1), labelled) for i in range(len(families))]) if len(families) > 1 else np.zeros((len(families), DIMENSIONS + 1), np.float32)
    own = np.array(langs)
    pairs = {}
    for group in members.values():
        for a, b in combinations(group, 2):
            pairs[a, b] = svm(x, np.where(own == a, 1, -1), np.flatnonzero((own == a) | (own == b)))
    of = np.append(own, [""] * (len(x) - len(langs)))
    against_rest = np.stack([svm(x, np.where(of == n, 1, -1)) for n in names])
    return LanguageModel(families, members, weights, pairs, against_rest)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 800) -> LanguageModel:
    """A model of at most per_language labelled texts (with a letter) of each language: those whose texts' hashes are least."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    # A row a language; Spark keeps per_language rows of a language in each task before it shuffles the draws.
    last = {r["lang"]: r["draw"] for r in rows.select("lang", "draw").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).groupBy("lang").agg(F.max("draw").alias("draw")).collect()}
    if not last:
        return LanguageModel([], {}, np.zeros((0, DIMENSIONS + 1), np.float32), {})
    limit = F.create_map(*(F.lit(v) for kv in last.items() for v in kv))
    sample = rows.where(F.col("draw") <= limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for part in slices(batches, "text"):
            out = []
            for lang, draw, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), features(part.column(0)), strict=True):
                if (lang, draw) not in seen:  # a text that is there often counts once in a task
                    seen.add((lang, draw))
                    at = np.flatnonzero(x)
                    out.append((lang, draw, at.astype(np.uint16).tobytes(), x[at].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "draw", "slots", "counts"])

    drawn = sample.select("text", "lang", "draw").mapInArrow(count, "lang string, draw long, slots binary, counts binary").dropDuplicates(["lang", "draw"])
    found = {(r["lang"], r["draw"]): (np.frombuffer(r["slots"], np.uint16), unit(np.frombuffer(r["counts"], np.uint32))) for r in drawn.toLocalIterator()}
    order = sorted(found)
    # Some empty vectors count as rest, so that a text of other n-grams than the learned ones is far from every language.
    rest = [np.zeros(0, np.uint16)] * max(len(order) // 32, 1)
    x = Vectors([*(found[k][0] for k in order), *rest], [*(found[k][1] for k in order), *(r.astype(np.float32) for r in rest)])
    return fit(x, [lang for lang, _ in order])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, own_margin (0 where lang_pred is und)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # (families + pairs of close languages + languages) * DIMENSIONS * 4 bytes
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        judge = lambda x: (*model.predict(x), model.own_margin(x))
        for part in slices(batches, "text"):
            found = [judge(unit(x)) if has_letter(t) else (UNKNOWN, 0.0, 0.0) for t, x in zip(part.column(1).to_pylist(), features(part.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], ["row_id", "lang_pred", "score", "own_margin"])

    return docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"row_id {kind}, lang_pred string, score double, own_margin double").withColumnRenamed("row_id", id_col)

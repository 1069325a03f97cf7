"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments: each row has the postings of some whole documents, every term (64-bit word hash) with all its
positions, delta-coded. Segments are of bounded size, are built without a shuffle, and are searched where they lie. A search
looks up a phrase's terms, takes the positions of the rarest, moves them back by that term's offset in the phrase, and keeps
the starts that the other terms' lists confirm at their own offsets, rarest first.

Test phrases come to the segments in blocks of bounded size (phrase_words words each); with several blocks, each is a pass
over the segments and the passes are united by document. The document side is never broadcast or collected.

Defined results: null and empty texts have no words and match nothing; an item without words has no windows; items that share
an id count once; an item whose id is null marks words but is no counted item; repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, slices, stored
from rankweave.llm.tokens import ALPHANUMERIC, hashed_words, text_bytes

SEGMENT = "segment long, ids array<{id}>, bounds binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored segments of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, part in enumerate(slices(batches, "text", 3_000_000)):
            words, bounds = hashed_words(*text_bytes(part.column(1)), ALPHANUMERIC)
            order = np.argsort(words, kind="stable").astype(np.int32)
            terms, counts = np.unique(words[order], return_counts=True)
            deltas = np.diff(order, prepend=np.int32(0)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([task * 2**32 + k]), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (bounds.astype(np.int32), terms, counts.astype(np.int32), deltas))], ["segment", "ids", "bounds", "terms", "counts", "positions"])

    return stored(rows.mapInArrow(build, SEGMENT.format(id=docs.schema[id_col].dataType.simpleString())), "postings")


class Segment:
    """The postings of one row of the index."""

    def __init__(self, row: dict):
        self.bounds = np.frombuffer(row["bounds"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.span = max(len(self.positions), 1) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.span + self.positions  # ordered: by term, then position

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """True where the term's list has the position."""
        key = term * self.span + position
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows: a row of words each. The numbers of those that occur within one document, and their starts."""
        none = np.zeros(0, np.int64)
        terms = self.lookup(windows)
        alive = np.flatnonzero((terms >= 0).all(axis=1))
        if not len(alive):
            return none, none
        terms, n = terms[alive], windows.shape[1]
        order = np.argsort(self.counts[terms], axis=1, kind="stable")
        rare = order[:, 0]
        term = terms[np.arange(len(alive)), rare]
        counts = self.counts[term]
        which = np.repeat(np.arange(len(alive)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = self.positions[self.first[term][which] + within] - rare[which]
        keep = (start >= 0) & (start + n <= len(self.positions))
        keep &= np.searchsorted(self.bounds, start, "right") == np.searchsorted(self.bounds, start + n - 1, "right")
        which, start = which[keep], start[keep]
        for k in range(1, n):
            at = order[which, k]
            keep = self.has(terms[which, at], start + at)
            which, start = which[keep], start[keep]
        return alive[which], start

    def near(self, words: np.ndarray, within: int) -> Iterator[tuple[int, int]]:
        """Smallest spans (start, end) of at most within words, in one document, that have all the words (as a set)."""
        terms = np.unique(self.lookup(np.unique(words)))
        if not len(terms) or terms[0] < 0:
            return
        lists = sorted((self.positions[self.first[t] : self.first[t + 1]] for t in terms), key=len)
        around = lists[0]
        for other in lists[1:]:  # positions of the rarest term that have each other term close by
            if not len(around):
                return
            at = np.searchsorted(other, around)
            left, right = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
            around = around[(np.abs(around - left) < within) | (np.abs(right - around) < within)]
        found: set[tuple[int, int]] = set()
        for p in around.tolist():
            doc = np.searchsorted(self.bounds, p, "right")
            low, high = max(p - within + 1, self.bounds[doc - 1]), min(p + within, self.bounds[doc])
            close = sorted((int(x), k) for k, ys in enumerate(lists) for x in ys[np.searchsorted(ys, low) : np.searchsorted(ys, high)])
            last: dict[int, int] = {}
            for x, k in close:
                last[k] = x
                if len(last) == len(lists) and x - (first := min(last.values())) < within and (first <= p <= x):
                    found.add((first, x + 1))
        for first, end in sorted(found):
            if not any((a >= first and b <= end) and (a, b) != (first, end) for a, b in found):
                yield first, end


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int | None, phrase_words: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Items as (id, words), streamed from the cluster, in blocks of a bounded number of words."""
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        words, _ = hashed_words(*text_bytes(pa.array([row["text"]], pa.string())), ALPHANUMERIC)
        if len(words):
            block.append((row["id"], words))
            held += len(words)
            if held >= phrase_words:
                yield block
                block, held = [], 0
    if block:
        yield block


def _windows(block: list[tuple[str | None, np.ndarray]], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the distinct (item, window) pairs as item numbers and rows of words."""
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, (_, words) in enumerate(block):
        n = min(window, len(words))
        rows = np.unique(np.lib.stride_tricks.sliding_window_view(words, n), axis=0)
        by.setdefault(n, []).append((np.full(len(rows), i), rows))
    return {n: (np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x])) for n, x in by.items()}


def phrase_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, phrase_words: int = 2_000_000) -> DataFrame:
    """One row per document of the index: segment, ordinal, id, n_words, item_ids (that have a window here), spans (merged, of word positions).

    A window is any window consecutive words of an item, or all of a shorter item.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    out = f"segment long, ordinal int, id {kind}, n_words long, item_ids array<string>, spans array<struct<start: int, end: int>>"

    def search(block: list[tuple[str | None, np.ndarray]]) -> DataFrame:
        phrases = index.sparkSession.sparkContext.broadcast((_windows(block, window), [i for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by, names = phrases.value
            for batch in batches:
                for k in range(batch.num_rows):
                    here = batch.slice(k, 1)
                    yield _found(here, by, names)

        return index.mapInArrow(run, out)

    parts = [search(block) for block in _blocks(items, id_col, text_col, window, phrase_words)] or [search([])]
    if len(parts) == 1:
        return parts[0]
    united = reduce(DataFrame.unionByName, parts).groupBy("segment", "ordinal").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start: int, end: int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return united.withColumn("spans", merged)


def _found(row: pa.RecordBatch, by: dict, names: list) -> pa.RecordBatch:
    data = {n: row.column(i)[0].as_py() for i, n in enumerate(row.schema.names) if n not in ("ids",)}
    segment = Segment(data)
    docs = len(segment.bounds) - 1
    edges = np.zeros(len(segment.positions) + 1, np.int64)
    pairs: set[tuple[int, int]] = set()
    for n, (owner, windows) in by.items():
        which, start = segment.phrases(windows)
        if len(which):
            np.add.at(edges, start, 1)
            np.add.at(edges, start + n, -1)
            doc = np.searchsorted(segment.bounds, start, "right") - 1
            pairs.update(map(tuple, np.unique(np.stack([doc, owner[which]], axis=1), axis=0).tolist()))
    ids: list[list[str]] = [[] for _ in range(docs)]
    for doc, owner in sorted(pairs):
        if (name := names[owner]) is not None and name not in ids[doc]:
            ids[doc].append(name)
    spans: list[list[dict]] = [[] for _ in range(docs)]
    if pairs:
        hit = np.zeros(len(segment.positions) + 2, np.int8)
        hit[1:-1] = np.cumsum(edges[:-1]) > 0
        begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):  # a run of hit words may cross into the next documents
            doc = int(np.searchsorted(segment.bounds, a, "right")) - 1
            while a < b:
                stop = min(b, int(segment.bounds[doc + 1]))
                if stop > a:
                    base = int(segment.bounds[doc])
                    spans[doc].append({"start": a - base, "end": stop - base})
                a, doc = max(a, stop), doc + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([data["segment"]] * docs, pa.int64()),
            pa.array(range(docs), pa.int32()),
            row.column(row.schema.get_field_index("ids")).flatten(),
            pa.array(np.diff(segment.bounds), pa.int64()),
            pa.array(ids, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ],
        ["segment", "ordinal", "id", "n_words", "item_ids", "spans"],
    )


def proximity_matches(index: DataFrame, items: DataFrame, within: int, id_col: str = "item_id", text_col: str = "text", phrase_words: int = 2_000_000) -> DataFrame:
    """Where all different words of an item stand, in any order, within so many consecutive words of a document: id, item_id, start, end (smallest spans)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def search(block: list[tuple[str | None, np.ndarray]]) -> DataFrame:
        phrases = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    segment = Segment({n: row.column(i)[0].as_py() for i, n in enumerate(row.schema.names) if n != "ids"})
                    hits = [(name, a, b) for name, words in phrases.value for a, b in segment.near(words, within)]
                    doc = np.searchsorted(segment.bounds, [a for _, a, _ in hits], "right") - 1 if hits else np.zeros(0, np.int64)
                    base = segment.bounds[doc] if hits else doc
                    ids = row.column(row.schema.get_field_index("ids")).flatten().take(pa.array(doc, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in hits], pa.string()), pa.array([x[1] - int(s) for x, s in zip(hits, base, strict=True)], pa.int64()), pa.array([x[2] - int(s) for x, s in zip(hits, base, strict=True)], pa.int64())], ["id", "item_id", "start", "end"])

        return index.mapInArrow(run, f"id {kind}, item_id string, start long, end long")

    return reduce(DataFrame.unionByName, [search(b) for b in _blocks(items, id_col, text_col, None, phrase_words)] or [search([])])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = 10, **search: object) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any occurrence of a window), item_ids, spans, contaminated."""
    found = phrase_matches(build_index(docs, id_col), benchmark, window=window, **search)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort("item_ids").alias("item_ids"), "spans", (n_hit > 0).alias("contaminated"))

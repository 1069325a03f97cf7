"""N-gram Jaccard self-join by PartEnum signatures: all links of similarity 0.8 or more, as classes, verified pairs and components.

1. One pass over the texts gives each document its shingle set's name (equal sets have equal names of 128 bits: they are one class), size
   and parity sketch, and the classes' signatures in chunks, dealt to buckets by signature.
2. In a bucket, classes that share a signature are a candidate group; equal groups, and those within a larger one of the same least class, count once. Groups of more than BLOCK classes are dealt out as
   pairs of blocks, each a task's worth of its own.
3. In a group, sizes and sketches refuse pairs without loss (sketches never differ in more bits than the sets do in elements). Classes without any
   pair that passes leave the group for good.
4. Pairs that pass are verified on the sets themselves, made again from the texts of the classes concerned alone, in three steps: each
   class with the least class that it was found with; then pairs that would join what is still apart within a group; then all
   pairs left whose classes are in different components. After each, components are made anew. So no link between components is lost, and
   copies aren't expanded into pairs. Of a pair, the text of the class with more pairs is sent once for all of up to STAR of them.

Defined results: null and empty texts have an empty set, linked with nothing; a text of fewer than five words is one shingle;
repeated rows are one class; a null id counts as the largest in its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, drop_path, estimated_bytes, slices, stored, stored_at
from rankweave.llm.components import components
from rankweave.llm.signatures import SIMILARITY, folded, linked, set_name, shingle_sets, signatures, sketch
from rankweave.llm.tokens import mix

#: Signatures of a bucket, about; how many a byte of text has, at most; and how many a task gathers before it sends them.
BUCKET, RATE, GATHER = 2_000_000, 0.1, 1_500_000
#: Shuffle partitions that buckets are dealt to, at most; a task then takes several buckets one after the other.
PARTITIONS = 20_000
#: Classes of a group that are looked at in one task, in pairs of blocks beyond; and pairs of a class whose texts meet in one.
BLOCK, STAR = 1024, 512
#: Groups of up to so many classes are looked at many at once.
SMALL = 24
#: Rows of keys up to which the verification broadcasts them (about 50 bytes each); beyond, it joins by shuffling.
BROADCAST_ROWS = 1_000_000


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of binaries that are cut from data at the byte offsets ends."""
    offsets = np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all binaries of a column without nulls, one after the other."""
    if not len(column):
        return np.zeros(0, np.uint8)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)


def _chunks(signed: list[np.ndarray], names: list[bytes], buckets: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The signatures of classes as a row a bucket: bucket, signatures (32 bits each), runs (how many a class has, 16 bits each), classes (the first 8 bytes of names)."""
    every = np.concatenate(signed)
    owner = np.repeat(np.arange(len(signed)), [len(x) for x in signed])
    bucket = ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, short = bucket[order], owner[order], (every[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))
    lengths = np.diff(np.append(starts, len(bucket)))
    if lengths.max() > 65_535:  # a run that 16 bits can't count becomes several
        pieces = -(-lengths // 65_535)
        first = np.repeat(starts, pieces) + 65_535 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        starts, lengths = first, np.diff(np.append(first, len(bucket)))
    found, at = np.unique(bucket[starts], return_index=True)
    run_ends = np.append(at[1:], len(starts))
    short_ends = np.append(starts[at[1:]], len(bucket))
    classes = np.frombuffer(b"".join(n[:8] for n in names), np.int64)[owner[starts]]
    return pa.array(found, pa.int32()), _binaries(short.view(np.uint8), short_ends * 4), _binaries(lengths.astype(np.uint16).view(np.uint8), run_ends * 2), _binaries(classes.view(np.uint8), run_ends * 8)


def _index(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, str]:
    """A table and its path: id, row_key, name, class (the first 8 bytes of the name), size, sketch: a row a document; and chunks of signatures, with a bucket: bucket, signatures, runs, classes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    columns = ["id", "row_key", "name", "class", "size", "sketch", "bucket", "signatures", "runs", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[bytes, np.ndarray] = {}
        held, id_type = 0, None

        def chunks() -> pa.RecordBatch:
            parts = _chunks(list(gathered.values()), list(gathered), buckets)
            k = len(parts[0])
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), *parts], columns)

        for part in slices(batches, "text", 3_000_000):
            id_type = part.column(0).type
            sets = shingle_sets(part.column(2))
            names = [set_name(s) if len(s) else None for s in sets]
            n = len(sets)
            sketches = pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            short = pa.array([None if name is None else int.from_bytes(name[:8], "little", signed=True) for name in names], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), short, sizes, sketches, pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3))], columns)
            for name, s in zip(names, sets, strict=True):
                if name is not None and name not in gathered:
                    gathered[name] = signatures(s)
                    held += len(gathered[name])
                    if held >= GATHER:
                        yield chunks()
                        held = 0
        if gathered:
            yield chunks()

    out = f"id {kind}, row_key long, name binary, class long, size long, sketch binary, bucket int, signatures binary, runs binary, classes binary"
    return stored_at(rows.mapInArrow(run, out), "signatures")


def _groups(chunks: DataFrame, buckets: int) -> DataFrame:
    """group, class: sets of two or more classes that share a signature, but for those within another that has the same least class.

    Groups of more than BLOCK classes come as pairs of blocks, with side 0 and 1 of each; else side is 0.
    """

    def run(table: pa.Table) -> pa.Table:
        signed, runs, classes = (_bytes(table.column(n).combine_chunks()) for n in ("signatures", "runs", "classes"))
        s, c = signed.view(np.uint32), np.repeat(classes.view(np.int64), runs.view(np.uint16))
        order = np.argsort(s, kind="stable")
        same = s[order][1:] == s[order][:-1]
        shared = np.zeros(len(s), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        s, c = s[order], c[order]
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        if not len(s):
            return pa.table({"group": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "blocks": pa.array([], pa.int32()), "members": pa.array([], pa.binary())})
        keep = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
        s, c = s[keep], c[keep]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        sizes = np.diff(np.append(starts, len(s)))
        names = mix(np.add.reduceat(mix(c.view(np.uint64)), starts) + sizes.astype(np.uint64))
        once = np.zeros(len(starts), bool)
        once[np.unique(names, return_index=True)[1]] = True
        once &= sizes > 1
        c, sizes, names = c[np.repeat(once, sizes)], sizes[once], names[once]
        # A row a block of at most BLOCK members.
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        block = np.arange(blocks.sum()) - np.repeat(first, blocks)
        ends = np.minimum((block + 1) * BLOCK, np.repeat(sizes, blocks)) + np.repeat(np.cumsum(sizes) - sizes, blocks)
        least = c[np.cumsum(sizes) - sizes]
        repeated = [pa.array(np.repeat(x, blocks)) for x in (names.view(np.int64), least, blocks.astype(np.int32))]
        return pa.table({"group": repeated[0], "least": repeated[1], "block": pa.array(block, pa.int32()), "blocks": repeated[2], "members": _binaries(c.view(np.uint8), ends * 8)})

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members a row each, without groups of one block that lie within a larger one of the same least class."""
        least, kept = None, []
        for batch in batches:
            taken = []
            for i, (low, blocks, members) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True)):
                if low != least:
                    least, kept = low, []
                if blocks == 1:
                    own = frozenset(np.frombuffer(members, np.int64).tolist())
                    if any(own <= other for other in kept):
                        continue
                    kept.append(own)
                taken.append(i)
            rows = batch.take(pa.array(taken, pa.int64()))
            data = rows.column(4)
            n = np.array([len(x) // 8 for x in data.to_pylist()], np.int64)
            spread = pa.array(np.repeat(np.arange(len(taken)), n), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(spread), pa.array(_bytes(data).view(np.int64)), rows.column(2).take(spread), rows.column(3).take(spread)], ["group", "class", "block", "blocks"])

    found = chunks.select("bucket", "signatures", "runs", "classes").repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(run, "group long, least long, block int, blocks int, members binary")
    # A class is in no more groups than it has signatures, so the groups of one least class are a bounded number.
    found = found.repartition("least").dropDuplicates(["least", "group", "block", "blocks"]).sortWithinPartitions("least", F.length("members").desc(), "group")
    found = found.select("group", "least", "block", "blocks", "members").mapInArrow(largest, "group long, class long, block int, blocks int")
    # A block meets each other block, and itself, in a task of its own.
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    task = F.when(F.col("blocks") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")))
    return found.select("group", "class", "block", "blocks", other).select(task.alias("group"), "class", (F.col("block") > F.col("other")).cast("int").alias("side"))


class _Rows:
    """Members of groups, as arrays: sizes, sketches by length, components and sides as numbers."""

    def __init__(self, table: pa.Table):
        self.names = table.column("name").combine_chunks()
        self.sizes = table.column("size").to_numpy()
        self.sides = table.column("side").to_numpy()
        self.group = table.column("group").to_numpy()
        column = table.column("sketch").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.at, self.words = at[:-1] // 8, np.diff(at) // 8
        self.data = np.frombuffer(column.buffers()[2], np.uint8)[: at[-1]].view(np.uint64)
        self.comp = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()

    def sketches(self, rows: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(rows), words), np.uint64)
        for length in np.unique(self.words[rows]):
            own = self.words[rows] == length
            out[own] = folded(self.data[self.at[rows[own]][:, None] + np.arange(length)], words)
        return out

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and sketches let the pairs of rows pass."""
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        passed = 100 * small >= SIMILARITY * large
        words = np.minimum(self.words[i], self.words[j])
        for length in np.unique(words[passed]).tolist():
            at = np.flatnonzero(passed & (words == length))
            step = max(1, 2_000_000 // length)
            for k in range(0, len(at), step):
                own = at[k : k + step]
                apart = np.bitwise_count(self.sketches(i[own], length) ^ self.sketches(j[own], length)).sum(axis=1, dtype=np.int64)
                passed[own] = apart * 9 <= self.sizes[i[own]] + self.sizes[j[own]]
        return passed


def _found(rows: _Rows, starts: np.ndarray, ends: np.ndarray, every: bool) -> tuple[list[int], list[int]]:
    """Pairs of rows of the groups from starts to ends that pass, of different components (and sides, where a group has two); only those that join what is apart unless every."""
    left: list[int] = []
    right: list[int] = []

    def take(i: int, j: int) -> None:
        if every:
            left.append(i)
            right.append(j)
        elif comp[i] != comp[j]:
            left.append(i)
            right.append(j)
            a, b = group_of[i]
            own = comp[a:b]
            own[own == comp[j]] = comp[i]

    comp = rows.comp.copy()
    group_of: dict[int, tuple[int, int]] = {}
    sizes = ends - starts
    two = np.repeat(np.maximum.reduceat(rows.sides, starts), sizes) > 0
    for n in np.unique(sizes[sizes <= SMALL]).tolist():
        first = starts[sizes == n]
        x, y = np.triu_indices(n, 1)
        step = max(1, 500_000 // max(len(x), 1))
        for k in range(0, len(first), step):
            base = first[k : k + step, None]
            i, j = (base + x).ravel(), (base + y).ravel()
            apart = (rows.comp[i] != rows.comp[j]) & ((rows.sides[i] != rows.sides[j]) == two[i])
            i, j = i[apart], j[apart]
            passed = rows.passing(i, j)
            for a, b in zip(i[passed].tolist(), j[passed].tolist(), strict=True):
                if not every and a not in group_of:
                    g = int(np.searchsorted(starts, a, side="right")) - 1
                    for r in range(int(starts[g]), int(ends[g])):
                        group_of[r] = int(starts[g]), int(ends[g])
                take(a, b)
    for a, b in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist(), strict=True):
        group_of.update({r: (a, b) for r in range(a, b)})
        for i in range(a, b - 1):
            if not every and (comp[a:b] == comp[a]).all():
                break
            other = np.flatnonzero((comp[i + 1 : b] != comp[i]) & ((rows.sides[i + 1 : b] != rows.sides[i]) == two[i])) + i + 1
            for j in other[rows.passing(np.full(len(other), i), other)].tolist():
                take(i, j)
    return left, right


def _surviving(members: DataFrame, every: bool) -> DataFrame:
    """group, a < b: pairs of different components, within groups, that sizes and sketches let pass. members: group, side, name, size, sketch, component.

    every False: of each group's pairs only so many that they would join what they can, no pair between classes that those before it join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> pa.RecordBatch:
            rows = _Rows(table)
            starts = np.flatnonzero(np.append(True, rows.group[1:] != rows.group[:-1]))
            left, right = _found(rows, starts, np.append(starts[1:], len(rows.group)), every)
            group = pa.array(rows.group[left] if left else [], pa.int64())
            pairs = list(zip(*(rows.names.take(pa.array(x, pa.int64())).to_pylist() for x in (left, right)), strict=True))
            return pa.RecordBatch.from_arrays([group, *(pa.array([f(p) for p in pairs], pa.binary()) for f in (min, max))], ["group", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 8 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            group = table.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, group[1:] != group[:-1]))[-1])
            held = table.slice(cut).to_batches()
            if cut:
                yield finish(table.slice(0, cut))
        if held:
            yield finish(pa.Table.from_batches(held))

    return members.select("group", "side", "name", "size", "sketch", "component").repartition("group").sortWithinPartitions("group", "side", "name").mapInArrow(run, "group long, a binary, b binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """a, b of pairs (a, b), a stored table, whose sets are linked."""
    n = pairs.count()
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))
    counted = pairs.join(ends.select(F.col("name").alias("a"), F.col("n").alias("_a")), "a").join(ends.select(F.col("name").alias("b"), F.col("n").alias("_b")), "b")
    swap = F.col("_b") > F.col("_a")
    hub, leaf = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    star = F.pmod(F.xxhash64(leaf), F.ceil(F.greatest("_a", "_b") / STAR)).cast("int")
    stars = stored(counted.select(hub.alias("hub"), leaf.alias("leaf"), star.alias("star")), "stars", n)
    nothing = F.lit(None).cast("binary").alias("leaf")
    routes = stars.select("hub", "star", nothing).distinct().withColumn("name", F.col("hub")).unionByName(stars.select("hub", "star", "leaf", F.col("leaf").alias("name")))
    routes = stored(routes.join(classes.select("name", "row_key"), "name").select("row_key", "hub", "star", "leaf"), "routes", 2 * n)
    if routes.count() <= BROADCAST_ROWS:
        routes = F.broadcast(routes)
    # Texts, not sets, go through the shuffle: they are half as long, and each goes once a route.
    texts = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text")).join(routes, "row_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for part in slices(batches, "text"):
            a, b = [], []
            for h, leaf, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(3)), strict=True):
                # Names are compared again, so a clash of row keys does no harm.
                if leaf is None:
                    if set_name(s) == h:
                        hub, own = h, s
                elif hub == h and set_name(s) == leaf and linked(own, s):
                    a.append(min(h, leaf))
                    b.append(max(h, leaf))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = texts.select("hub", "star", "leaf", "text").repartition("hub", "star").sortWithinPartitions("hub", "star", F.col("leaf").asc_nulls_first())
    return dealt.mapInArrow(verify, "a binary, b binary").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, class (null without shingles), component_id (least id reachable by links)."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=1000)
    buckets = max(32, int(estimated_bytes(docs, text_col) * RATE / BUCKET))
    index, at = _index(docs, id_col, text_col, buckets)
    nodes = stored(index.where(F.col("bucket").isNull()).select("id", "row_key", "name", "class", "size", "sketch"), "nodes")
    least_row = F.min(F.struct("row_key", "class", "size", "sketch")).alias("x")
    # The groups know the first 8 bytes of a class's name; should two classes clash in them, both are members.
    classes = stored(nodes.where(F.col("name").isNotNull()).groupBy("name").agg(least_row).select("name", "x.*"), "classes", nodes.count())
    groups = stored(_groups(index.where(F.col("bucket").isNotNull()), buckets), "groups")
    drop_path(spark, at)
    members = groups.join(classes.select("class", "name", "size", "sketch"), "class").withColumn("component", F.col("name"))
    links = tried = found = alive = None
    for step in ("nearest", "spanning", "all"):
        if step != "nearest":
            # Groups that still span components: their members with what is known of them.
            placed = alive.join(found.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
            apart = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group")
            members = placed.join(apart, "group").join(classes.select("name", "size", "sketch"), "name").withColumn("side", F.lit(0))
        pairs = _surviving(members, every=step == "all")
        if step == "nearest":
            pairs = stored(pairs, "passed")
            most = pairs.count()
            alive = stored(pairs.select("group", F.col("a").alias("name")).unionByName(pairs.select("group", F.col("b").alias("name"))).distinct(), "alive", 2 * most)
            alive_rows = alive.count()
            classes = stored(classes.join(alive.select("name").distinct(), "name", "left_semi"), "known", alive_rows)
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        else:
            most = alive_rows if step == "spanning" else None  # a group's spanning pairs are fewer than its members
        pairs = stored(pairs.select("a", "b").distinct() if tried is None else pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs", most)
        if found is not None and pairs.isEmpty():
            continue
        more = stored(_verified(pairs, docs, classes, id_col, text_col), "links", pairs.count())
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found is None or not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            found = stored(components(links), "components", 2 * links.count())
    least = nodes.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("id").alias("least")).join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("name").alias("_name"), "component_id")
    placed = nodes.join(named, F.col("name") == F.col("_name"), "left")
    return placed.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("name").alias("class"), F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

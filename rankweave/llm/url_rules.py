"""URL filters by association rules.

A URL becomes a set of tokens: its scheme, the labels of its host, all its path segments (numbers as one token), the keys of its query, and
whether it has a fragment. Spark's FP-growth mines token sets of labelled URLs together with their verdict; rules token
set -> verdict that reach the least support and confidence, and that no rule of fewer of their tokens matches in confidence,
are kept. A rule is indexed under its rarest token; a URL meets only the rules under its own tokens, and of those whose tokens
it all has, the one of the greatest confidence, then support, decides. Listed host and path rules come first.

The number of rules is bounded, as the index is broadcast. Where tokens have too many frequent sets to list, the sets of the surest tokens are
mined, and for URLs with others the best rule that has any of these is sought by branch and bound, a task a token: no rule is passed over.

Defined results: null URLs and those without :// have empty host and path, no tokens, and the default verdict; repeated rows are
judged one by one; without labelled URLs there are no rules; on equal confidence and support, fewer tokens, then block, decide.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bounded_batches, stored

MAX_RULES = 200_000
#: Frequent token sets that mining may look at; there are some 10,000 a second.
MAX_SETS = 2_000_000
#: URLs of a task that seeks rules.
BLOCK_URLS = 1_000
_VERDICT = "verdict="


@dataclass(frozen=True)
class ListedRule:
    """A verdict for a host, all its subdomains, and paths that start so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TokenRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[ListedRule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, in order."""
    scheme = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(_lower(x), "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    rest = F.filter(F.array(F.when(scheme != "", F.concat(F.lit("scheme="), _lower(scheme))), F.when(F.instr(url, "#") > 0, F.lit("fragment"))), lambda x: x.isNotNull())
    valid = url.isNotNull() & (F.instr(url, "://") > 0)
    return F.when(valid, F.array_sort(F.array_distinct(F.concat(labels, segments, keys, rest)))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rest:
    """What the mined rules don't cover: token sets with one of the tokens in order."""

    of: dict[str, str]  # each frequent token: the first of those that come in the same rows
    order: dict[str, int]  # those left out of the mining, the rarest first
    top: dict[str, int]  # the most rows of a verdict that each of them is in
    n: int
    least: float  # rows
    least_confidence: float
    most_tokens: int | None

    def own(self, tokens: list[str]) -> dict[str, str]:
        """Of tokens, the frequent ones, one of those that come in the same rows: by class, the token itself."""
        out: dict[str, str] = {}
        for t in sorted(tokens):
            if t in self.of:
                out.setdefault(self.of[t], t)
        return out

    def beside(self, name: str, names: list[str]) -> list[str]:
        """Of names, those whose sets are sought with name: the mined ones and those after it."""
        return [c for c in names if self.order.get(c, len(self.order)) > self.order[name]]


def _classes(rows: DataFrame, least: float) -> tuple[dict[str, list[str]], dict[str, tuple[int, int]]]:
    """Of the tokens in rows that have the least count: those that come in the same rows, under the first of them; the surest of a verdict first.
    Also the rows of each first one, and of its most frequent verdict.

    There are at most mean tokens of a row / least support of them, whatever the number of rows.
    """
    each = rows.select("verdict", F.explode("tokens").alias("token"), F.xxhash64("tokens", "verdict").cast("decimal(38,0)").alias("h"))
    by_verdict = each.groupBy("token", "verdict").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    often = by_verdict.groupBy("token").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("top")).where(F.col("n") >= least)
    together: dict[tuple, list[str]] = {}
    counts: dict[str, tuple[int, int]] = {}
    for r in often.orderBy("token").toLocalIterator():
        together.setdefault((-r["top"] / r["n"], -r["n"], r["h"]), []).append(r["token"])
        counts[r["token"]] = r["n"], r["top"]
    found = {tokens[0]: tokens for _, tokens in sorted(together.items())}
    return found, {t: counts[t] for t in found}


def mine(labelled: DataFrame, least_support: float = 0.005, least_confidence: float = 0.9, most_tokens: int | None = None, most_sets: int = MAX_SETS) -> list[TokenRule]:
    """Rules of labelled (tokens, verdict), with token sets of every size or, if given, of at most most_tokens.

    FP-growth looks at all frequent sets, and tokens that come together have very many. So of tokens that come in the same rows it gets one, and the
    rules it gives stand for each of them. Where there may still be more than most_sets frequent sets (rows' sets by the least support), or are more
    than MAX_RULES rules, only those of the tokens that tell most of a verdict by themselves are listed, half of them, and so on; a warning says so.
    filter_urls seeks the rules of the other tokens for each URL.
    """
    rules, rest = _mined(labelled, least_support, least_confidence, most_tokens, most_sets)
    if rest:
        kinds = len(set(rest.of.values()))
        warnings.warn(f"rules are listed of the {kinds - len(rest.order)} surest of {kinds} kinds of frequent tokens, as tokens come together too often: filter_urls seeks the others", stacklevel=2)
    return rules


def _mined(labelled: DataFrame, least_support: float = 0.005, least_confidence: float = 0.9, most_tokens: int | None = None, most_sets: int = MAX_SETS) -> tuple[list[TokenRule], Rest | None]:
    """The rules that can be listed, and what they leave, if anything."""
    rows = labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0)).select("tokens", "verdict")
    n = rows.count()
    if not n:
        return [], None
    classes, counts = _classes(rows, least_support * n)
    names = list(classes)
    while True:
        kept = rows.select(F.array_intersect("tokens", F.array(*map(F.lit, names)).cast("array<string>")).alias("tokens"), "verdict")
        sets = kept.agg(F.sum(F.pow(F.lit(2.0), F.size("tokens")))).first()[0]
        few = sets / (least_support * n) <= most_sets or not names
        rules = _listed_rules(kept, classes, least_support, least_confidence, most_tokens) if few else None
        if rules is not None:
            break
        names = names[: len(names) // 2]
    if len(names) == len(classes):
        return rules, None
    left = sorted(set(classes) - set(names), key=lambda c: (counts[c][0], c))
    of = {t: c for c, same in classes.items() for t in same}
    return rules, Rest(of, {c: i for i, c in enumerate(left)}, {c: counts[c][1] for c in left}, n, least_support * n, least_confidence, most_tokens)


def _listed_rules(kept: DataFrame, classes: dict[str, list[str]], least_support: float, least_confidence: float, most_tokens: int | None) -> list[TokenRule] | None:
    """All rules of kept (tokens, verdict), each also with the tokens that come in the same rows; None if they are more than MAX_RULES."""
    items = kept.select(F.concat("tokens", F.array(F.concat(F.lit(_VERDICT), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items)
    small = F.lit(True) if most_tokens is None else F.size("antecedent") <= most_tokens
    mined = model.associationRules.where(F.col("consequent")[0].startswith(_VERDICT) & small & ~F.exists("antecedent", lambda x: x.startswith(_VERDICT)))
    found: dict[tuple[str, ...], list[TokenRule]] = {}
    for k, r in enumerate(mined.select("antecedent", F.col("consequent")[0].alias("verdict"), "confidence", "support").toLocalIterator()):
        if k >= MAX_RULES:
            return None
        key = tuple(sorted(r["antecedent"]))
        found.setdefault(key, []).append(TokenRule(key, r["verdict"].removeprefix(_VERDICT), r["confidence"], r["support"]))

    best: dict[tuple[str, ...], float] = {(): 0.0}

    def below(key: tuple[str, ...]) -> float:
        """The greatest confidence of rules of some but not all of the tokens, for whatever verdict; each token set is looked at once."""
        out = 0.0
        for i in range(len(key)):
            part = key[:i] + key[i + 1 :]
            if part not in best:
                best[part] = max(below(part), *(r.confidence for r in found.get(part, ())), 0.0)
            out = max(out, best[part])
        return out

    def useful(rule: TokenRule) -> bool:
        """False if a rule of some of the tokens is as confident."""
        return below(rule.tokens) < rule.confidence

    out: list[TokenRule] = []
    for rule in (r for rules in found.values() for r in rules if useful(r)):
        if len(out) + prod(len(classes[t]) for t in rule.tokens) > MAX_RULES:
            return None
        out += [TokenRule(tuple(sorted(same)), rule.verdict, rule.confidence, rule.support) for same in product(*(classes[t] for t in rule.tokens))]
    return sorted(out, key=lambda r: (r.tokens, r.verdict))


def index(rules: list[TokenRule]) -> dict[str, list[tuple[tuple, frozenset[str], str]]]:
    """Under each rule's rarest token (the one in the fewest rules): how it ranks, its tokens and verdict."""
    often: dict[str, int] = {}
    for r in rules:
        for t in r.tokens:
            often[t] = often.get(t, 0) + 1
    out: dict[str, list[tuple[tuple, frozenset[str], str]]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append(((-r.confidence, -r.support, len(r.tokens), r.verdict != "block", r.tokens), frozenset(r.tokens), r.verdict))
    return out


def _best(under: dict, own: list[str]) -> tuple[tuple, frozenset[str], str] | None:
    """Of the indexed rules whose tokens are all in own, the one that decides."""
    have = set(own)
    return min(((rank, names, v) for t in own for rank, names, v in under.get(t, ()) if names <= have), default=None, key=lambda x: x[0])


def _best_with(first: str, tokens: list[str], has: np.ndarray, counts: np.ndarray, verdicts: list[str], rest: Rest, best: tuple | None) -> tuple | None:
    """How the best rule ranks, with its verdict, of first and any of tokens; best where none is before it.

    has: which of tokens each labelled row (all with first) has; counts: how often the row comes with each verdict. A better set must part with
    rows of other verdicts: one such row is taken at a time, and either it stays, and with it only its tokens, or the set has one of the tokens that it lacks.
    """
    most = len(tokens) + 1 if rest.most_tokens is None else rest.most_tokens
    has = has.astype(np.float64)  # products of floats are the fast ones, and exact for counts
    for v, verdict in enumerate(verdicts):
        good = counts[:, v].astype(np.float64)
        bad = counts.sum(axis=1) - good
        todo = [(np.arange(len(has)), (), np.arange(len(tokens)))]
        while todo:
            rows, chosen, more = todo.pop()
            n_good, size = int(good[rows].sum()), len(chosen) + 1
            if n_good < rest.least or not n_good or size > most:
                continue
            against = rows[bad[rows] > 0]
            n_bad = int(bad[against].sum())
            confidence = n_good / (n_good + n_bad)
            if confidence >= rest.least_confidence:
                rank = (-confidence, -(n_good / rest.n), size, verdict != "block", tuple(sorted([first, *(tokens[t] for t in chosen)])), verdict)
                best = rank if best is None else min(best, rank)
            # A better set's tokens each leave enough rows of the verdict; after a rule without exceptions, as many as that has.
            with_good = good[rows] @ has[rows][:, more]
            enough = with_good >= max(rest.least, 1 if best is None or best[0] > -1.0 else round(-best[1] * rest.n))
            more, with_good = more[enough], np.sort(with_good[enough])
            lacks = has[against][:, more] == 0
            n_lacks = lacks.sum(axis=1)
            if not n_lacks.any():
                continue
            # It has so many of them, at least, that enough rows of other verdicts go: the one that leaves fewest bounds what is left.
            sure = max(rest.least_confidence, -best[0] if best is not None else 0.0, 1e-9)
            few = (n_bad - with_good[-1] * (1 - sure) / sure) / (bad[against] @ lacks).max()
            some = max(int(np.ceil(few - 1e-6)), 1)
            if some > len(more):
                continue
            n_left = int(with_good[-some])
            bound = n_left / (n_left + int(bad[against[n_lacks == 0]].sum()))
            if bound < rest.least_confidence or (best is not None and (-bound, -(n_left / rest.n), size + some, verdict != "block") > best[:4]):
                continue
            row = int(np.argmin(np.where(n_lacks > 0, n_lacks, len(more) + 1)))
            todo.append((rows, chosen, more[~lacks[row]]))
            part = more[lacks[row]]
            stay = has[np.ix_(rows, part)]
            part = part[np.argsort(good[rows] @ stay - bad[rows] @ stay, kind="stable")]  # the last one is looked at first, with all of more
            for i, t in enumerate(part):
                todo.append((rows[has[rows, t] > 0], (*chosen, t), np.setdiff1d(more, part[i:])))
    return best


def _sought(asked: DataFrame, labelled: DataFrame, under: Broadcast, rest: Broadcast) -> DataFrame:
    """For each asked URL (have, its frequent tokens): verdict and why (tokens) of the best rule with a token that was left out of the mining, if that rule is better than the mined ones.

    Each token left out is a group: the labelled rows with it, alike ones as one, and the URLs with it. Groups of many URLs are cut into blocks of them.
    """
    spark = asked.sparkSession

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rest.value
        for batch in batches:
            out = []
            for tokens, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = list(r.own(tokens))
                out += [(c, sorted(r.beside(c, names)), verdict) for c in names if c in met]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))], ["first", "beside", "verdict"])

    def urls_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rest.value
        for batch in batches:
            out = []
            for have in batch.column(0).to_pylist():
                best = _best(under.value, have)
                # No set with the token is in more rows than the token.
                out += [(c, have) for c in r.own(have) if c in r.order and (best is None or (-1.0, -(r.top[c] / r.n), 1, False) <= best[0][:4])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string())))], ["first", "have"])

    def seek(group: pa.Table) -> pa.Table:
        r, first = rest.value, group.column("first")[0].as_py()
        urls = group.filter(pc.is_valid(group.column("have"))).column("have")
        rows = group.filter(pc.is_null(group.column("have"))).select(["beside", "verdict", "n"])
        found = []
        if len(urls) and len(rows):
            verdicts = rows.column("verdict").unique().to_pylist()
            counts = np.zeros((len(rows), len(verdicts)), np.int64)
            counts[np.arange(len(rows)), [verdicts.index(v) for v in rows.column("verdict").to_pylist()]] = rows.column("n").to_numpy()
            beside = rows.column("beside").combine_chunks()
            at = pc.list_parent_indices(beside).to_numpy()
            coded = pc.list_flatten(beside).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            by = np.argsort(codes, kind="stable")
            parts = dict(zip(names, np.split(at[by], np.searchsorted(codes[by], np.arange(1, len(names)))), strict=True)) if names else {}
            for have in urls.to_pylist():
                own = r.own(have)
                mine = [c for c in r.beside(first, list(own)) if c in parts]
                has = np.zeros((len(rows), len(mine)), bool)
                for i, c in enumerate(mine):
                    has[parts[c], i] = True
                packed = np.packbits(has, axis=1)
                words_of = np.zeros((len(rows), packed.shape[1] // 8 + 1, 8), np.uint8)
                words_of.reshape(len(rows), -1)[:, : packed.shape[1]] = packed
                bits = words_of.view(np.uint64)[:, :, 0]
                _, some, of = np.unique(bits[:, 0] if bits.shape[1] == 1 else bits, axis=0, return_index=True, return_inverse=True)  # numbers sort much faster than rows
                n = np.zeros((len(some), len(verdicts)), np.int64)
                np.add.at(n, of.reshape(-1), counts)
                best = _best(under.value, have)
                before = None if best is None else (*best[0], best[2])
                rank = _best_with(own[first], [own[c] for c in mine], has[some], n, verdicts, r, before)
                if rank is not None and rank != before:
                    found.append({"have": have} | dict(zip(("confidence", "support", "size", "later", "why", "verdict"), (*rank[:4], list(rank[4]), rank[5]), strict=True)))
        return pa.Table.from_pylist(found, pa.schema([("have", words), ("confidence", pa.float64()), ("support", pa.float64()), ("size", pa.int32()), ("later", pa.bool_()), ("why", words), ("verdict", pa.string())]))

    words = pa.list_(pa.string())
    urls = stored(asked.mapInArrow(urls_of, "first string, have array<string>"), "urls")
    per = urls.groupBy("first").agg(F.ceil(F.count("*") / BLOCK_URLS).cast("int").alias("blocks")).collect()  # a row a frequent token at most
    met = {x["first"] for x in per}
    cut = F.broadcast(spark.createDataFrame(per, "first string, blocks int"))
    rows = labelled.mapInArrow(rows_of, "first string, beside array<string>, verdict string").groupBy("first", "beside", "verdict").agg(F.count("*").alias("n"))
    rows = rows.join(cut, "first").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    urls = urls.join(cut, "first").withColumn("block", F.pmod(F.xxhash64("have"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    both = rows.unionByName(urls, allowMissingColumns=True)
    ranks = both.groupBy("first", "block").applyInArrow(seek, "have array<string>, confidence double, support double, size int, later boolean, why array<string>, verdict string")
    best = ranks.groupBy("have").agg(F.min(F.struct("confidence", "support", "size", "later", "why", "verdict")).alias("best"))
    return best.select(F.col("have").alias("asked"), F.col("best.verdict").alias("sought"), F.array_join("best.why", " ").alias("why"))


def filter_urls(pages: DataFrame, rules: list[ListedRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", mined: list[TokenRule] | None = None, **mining: float) -> DataFrame:
    """One row per row of pages: id, host, path, rule (the listed one, or null), verdict, mined_rule (the tokens that decided, or null).

    mined None: rules are mined here, with the listed rules' verdicts as labels.
    """
    spark = pages.sparkSession
    bounded_batches(spark, rows=10_000)
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens")).withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    labelled = rows.select("tokens", F.col("listed.verdict").alias("verdict"))
    left = None
    if mined is None:
        mined, left = _mined(labelled, **mining)
    shared, rest = spark.sparkContext.broadcast(index(mined)), spark.sparkContext.broadcast(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under, r = shared.value, rest.value
        for batch in batches:
            verdicts, why, asked = [], [], []
            for rule, verdict, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                best = _best(under, own) if rule is None else None
                verdicts.append(verdict or (best[2] if best else default))
                why.append(" ".join(sorted(best[1])) if best else None)
                some = r.own(own) if r and rule is None else {}
                asked.append(sorted(some.values()) if any(c in r.order for c in some) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(why, pa.string()), pa.array(asked, pa.list_(pa.string()))], ["id", "host", "path", "rule", "verdict", "mined_rule", "have"])

    flat = rows.select("id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"), "tokens")
    judged = flat.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, mined_rule string, have array<string>")
    if left:
        sought = _sought(judged.where("have IS NOT NULL").select("have").distinct(), labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0)), shared, rest)
        # Rows that don't ask are spread by a hash, which no URL's tokens equal.
        judged = judged.withColumn("have", F.coalesce("have", F.array(F.xxhash64("id", "host", "path").cast("string")))).join(sought, F.col("have") == F.col("asked"), "left")
        judged = judged.withColumn("verdict", F.coalesce("sought", "verdict")).withColumn("mined_rule", F.coalesce("why", "mined_rule"))
    return judged.select("id", "host", "path", "rule", "verdict", "mined_rule").withColumnRenamed("id", id_col)

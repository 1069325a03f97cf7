"""Mixing, languages, WARC, URL rules, the n-gram join, components and the pipeline."""

import base64
import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, row
from pyspark.sql import functions as F

from rankweave.llm import language_id as L
from rankweave.llm import signatures as G
from rankweave.llm import url_rules as U
from rankweave.llm import warc as W
from rankweave.llm.components import components
from rankweave.llm.mixing import mix_sources, targets
from rankweave.llm.ngram_join import ngram_join


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 300)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in targets(sizes, 1.5, [3.0, 1.0, 2.0], 2.0).collect()}
    # a, b, c, null weigh 3, 1, 2, 3 of 2115; a and c stop at 200 and 20, null at 600, b has the rest
    assert found == pytest.approx({"a": 200, "b": 1295, "c": 20, None: 600})


def test_mixing(spark, edge, empty, words):
    rng = random.Random(3)
    docs = [row(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 50, 300]))), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    table = spark.createDataFrame(docs, SCHEMA).unionByName(edge)
    found = mix_sources(table)
    rows = found.collect()
    assert len(rows) == table.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"]].append(r)
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(0.02 * group[0]["target"], 3) or len(group) < 20
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(1.5 * sum(g[0]["source_size"] for g in by.values()))
    again = mix_sources(table.repartition(7))
    assert sorted(map(str, again.select("doc_id", "size", "copies").collect())) == sorted(map(str, found.select("doc_id", "size", "copies").collect()))
    assert mix_sources(empty).count() == 0


def test_mixing_writes_few_tables(spark, words, tmp_path, monkeypatch):
    """What has a row a source stays with the driver while it is small: no folder of files for each step of the rates; beyond, it is stored, with the same rows."""
    from rankweave.llm import common

    rng = random.Random(8)
    docs = spark.createDataFrame([row(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 50, 300]))), "en", rng.choice(["a", "a", "b", "c", None])) for i in range(300)], SCHEMA)
    found = []
    for name, few in (("held", common.FEW_ROWS), ("stored", 2)):
        monkeypatch.setattr(common, "shared_dir", lambda spark, at=tmp_path / name: f"file://{at}")
        monkeypatch.setattr(common, "FEW_ROWS", few)
        found.append(sorted(map(str, mix_sources(docs).select("doc_id", "size", "target", "copies").collect())))
    made = [sorted(p.name.split("-")[0] for p in (tmp_path / name / "rankweave").iterdir()) for name in ("held", "stored")]
    assert found[0] == found[1] and len(found[0]) == 300
    assert made[0] == ["cells", "extras", "rates", "sizes", "tilted"] and {"newton", "moves", "goals"} < set(made[1])
    assert not list(tmp_path.rglob("_SUCCESS"))


TEXTS = {"en": "the of and to in is that was for with", "de": "der die und das ist nicht ein mit von auch", "fr": "le la les des est une pour que dans vous", "es": "el los las una para por con del como muy"}


def test_languages(spark, edge, empty):
    rng = random.Random(4)
    docs = [row(i, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randint(4, 40))), lang) for i, lang in enumerate(list(TEXTS) * 60)]
    table = spark.createDataFrame(docs, SCHEMA)
    model = L.train(table.where(~L.held_out("doc_id")))
    assert set(model.members) == {"germanic", "romance"} and set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    judged = L.predict(table.where(L.held_out("doc_id")), model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged) and all(0 <= r["score"] <= 1 for r in judged)
    rows = L.predict(edge, model).collect()
    assert len(rows) == edge.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert L.predict(empty, model).count() == 0
    nothing = L.train(empty)
    assert {r["lang_pred"] for r in L.predict(edge, nothing).collect()} == {"und"}
    single = L.train(table.where("lang = 'xx' OR lang = 'en'"))
    assert L.predict(table.limit(3), single).first()["lang_pred"] == "en"


def test_training_holds_no_matrix(spark, words):
    """The driver holds the n-grams that texts have, not a place for each that they could have."""
    import tracemalloc

    rng = random.Random(14)
    docs = spark.createDataFrame([row(i, " ".join(rng.choices(TEXTS[lang].split(), k=8)), lang) for i, lang in enumerate(list(TEXTS) * 200)], SCHEMA)
    tracemalloc.start()
    try:
        model = L.train(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(model.members) == {"germanic", "romance"} and most < docs.count() * L.DIMENSIONS * 4 / 3


def test_unlearned_languages_go(spark):
    import corpus_pipeline

    rng = random.Random(12)
    docs = [row(i, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randint(4, 40))), lang) for i, lang in enumerate(list(TEXTS) * 60)]
    other = ["Litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil", "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    other += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(5)]
    table = spark.createDataFrame([*docs, *(row(1000 + i, t, None) for i, t in enumerate(other))], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, table, "").collect()) == list(range(len(docs)))


def test_copies_use_up_no_sample(spark, monkeypatch):
    """However often a text is there, per_language different ones are fitted."""
    docs = [row(i, f"{lang} {i}", lang) for i, lang in enumerate(["en", "de"] * 20)]
    table = spark.createDataFrame(docs + [d for d in docs for _ in range(30)], SCHEMA)
    fitted = []
    monkeypatch.setattr(L, "fit", lambda x, langs: fitted.extend(langs))
    L.train(table, per_language=10)
    assert sorted(fitted) == ["de"] * 10 + ["en"] * 10


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, id long")


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "same", "d", 1), (2, "http://a/2", "same", "d", 1), (3, "http://a/3", None, "d", 1), (4, None, "", "d", 1), (5, "http://a b/5", "\r\n\r\nWARC/1.1\r\n\r\n é", "d", 1), (5, "http://a b/5", "\r\n\r\nWARC/1.1\r\n\r\n é", "d", 1), (6, "u", "x" * 300_000, "d", 1)]
    found = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.round_trip(pages(spark, rows)).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert found == sorted((i, len((h or "").encode()), digest(h), *kinds[i]) for i, _, h, _, _ in rows)
    assert W.round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_filters_and_payloads(spark, tmp_path, compression):
    W.archive(pages(spark, [(i, f"http://a/{i}", f"body {i % 3}" * 50, "d", 1) for i in range(9)]), f"file://{tmp_path}/w", compression=compression)
    read = spark.read.format("warc").load(f"file://{tmp_path}/w")
    assert read.count() == 9
    found = read.where("record_type = 'response'").select("record_id", "payload").collect()
    assert {(r["record_id"], bytes(r["payload"]).decode()) for r in found} == {(f"urn:page:{i}", f"body {i % 3}" * 50) for i in (6, 7, 8)}
    assert read.where("target_uri IN ('http://a/1', 'http://a/7') AND record_type = 'revisit'").count() == 1
    reader = W.WarcReader(f"file://{tmp_path}/w", ["record_id"], 1 << 20)
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 3)])) == [EqualTo(("payload_bytes",), 3)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6


RULES = [U.ListedRule("allow", "com", "/"), U.ListedRule("block", "example.com", "/en/"), U.ListedRule("allow", "www.example.com", "/en/"), U.ListedRule("block", "net", "/es/")]


def test_listed_urls(spark):
    urls = ["http://Example.COM/en/1?x#y", "https://a.www.example.com/en/2", "http://x.com", "http://x.com/", "http://notexample.com/en/3", None, "nothing", "ftp://net/es/", "http://a.net/fr/1", "http://h?q/://z/en"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(table, RULES, mined=[]).collect()}
    assert found[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert found[1] == ("a.www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert found[2] == ("x.com", "", None, "allow") and found[3] == ("x.com", "/", "com/", "allow") and found[4][2] == "com/"
    assert found[5] == ("", "", None, "allow") == found[6] and found[7] == ("net", "/es/", "net/es/", "block") and found[8][2] is None
    assert found[9] == ("h", "", None, "allow")


def test_mined_urls(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['spam', 'news'])}.x.{rng.choice(['org', 'com'])}/{rng.choice(['a', 'b'])}/{i}{rng.choice(['', '?q=1'])}" for i in range(300)]
    verdict = ["block" if "spam" in u and "/b/" in u else "allow" for u in urls]
    table = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(urls, verdict, strict=True))], "page_id long, url string, verdict string")
    labelled = table.select(U.tokens(F.col("url")).alias("tokens"), "verdict")
    mined = U.mine(labelled, 0.05, 0.9, 3)
    sets = [(frozenset(r["tokens"]), r["verdict"]) for r in labelled.collect()]
    want = {}
    for size in (1, 2, 3):
        for part in itertools.combinations(sorted({t for s, _ in sets for t in s}), size):
            has = [v for s, v in sets if s.issuperset(part)]
            for v in ("allow", "block"):
                if has and has.count(v) >= 0.05 * len(sets) and has.count(v) >= 0.9 * len(has) and not any(c >= has.count(v) / len(has) for n in range(1, size) for sub in itertools.combinations(part, n) for (s, _), c in want.items() if s == sub):
                    want[part, v] = has.count(v) / len(has)
    assert {(r.tokens, r.verdict): pytest.approx(r.confidence) for r in mined} == want
    found = {r["page_id"]: r["verdict"] for r in U.filter_urls(table.drop("verdict"), [], mined=mined).collect()}
    assert [found[i] for i in range(300)] == verdict
    assert U.mine(labelled.limit(0)) == [] and U.filter_urls(table.limit(0), RULES).count() == 0


def test_mined_urls_of_any_depth(spark):
    """A verdict by the fifth path segment, and one that only five tokens together tell."""
    deep = [(f"http://h.x/a/b/c/d/{'bad' if i % 2 else 'good'}", "block" if i % 2 else "allow") for i in range(200)]
    five = [("http://h.x/" + "/".join(c for k, c in enumerate("pqrst") if k != i % 6), "block" if i % 6 == 5 else "allow") for i in range(300)]
    for rows in (deep, five):
        table = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "page_id long, url string, verdict string")
        mined = U.mine(table.select(U.tokens(F.col("url")).alias("tokens"), "verdict"), 0.05, 0.9)
        found = {r["page_id"]: r["verdict"] for r in U.filter_urls(table.drop("verdict"), [], mined=mined).collect()}
        assert [found[i] for i in range(len(rows))] == [v for _, v in rows]
    assert [r.tokens for r in mined if r.verdict == "block"] == [tuple(f"path={c}" for c in "pqrst")]


def test_mining_many_keys(spark):
    """Thirty query keys, always together or by chance, are mined in seconds; those together tell as each alone does."""
    import time

    rng = random.Random(13)
    keys = [f"k{i}" for i in range(30)]
    together = [("http://h.x/a?" + "&".join(f"{k}=1" for k in keys), "block") if i % 3 == 0 else ("http://h.x/b", "allow") for i in range(600)]
    chance = [("http://h.x/a?" + "&".join(f"{k}=1" for k in keys if rng.random() < 0.7), "block" if i % 2 else "allow") for i in range(600)]
    table = lambda rows: spark.createDataFrame(rows, "url string, verdict string").select(U.tokens(F.col("url")).alias("tokens"), "verdict")
    began = time.time()
    mined = U.mine(table(together))
    assert {r.tokens for r in mined if r.verdict == "block"} == {(f"key={k}",) for k in keys} | {("path=a",)}
    chance += [("http://h.x/bad?" + "&".join(f"{k}=1" for k in keys if rng.random() < 0.7), "block") for i in range(100)]
    with pytest.warns(UserWarning, match="surest"):
        assert ("path=bad",) in {r.tokens for r in U.mine(table(chance), most_sets=100_000)}
    assert time.time() - began < 60


def test_urls_of_tokens_left_out_of_mining(spark, monkeypatch):
    """However few tokens are mined or rules listed, each URL gets the verdict and rule that it gets when all are."""
    rng = random.Random(21)
    rows = []
    for i in range(500):
        bad = rng.random() < 0.5
        keys = [f"k{k}" for k in range(8) if rng.random() < (0.85 if bad == (k % 2 == 0) else 0.3)]
        keys += [f"same{k}" for k in range(3)] if "k0" in keys else []
        host = rng.choice(["a.com", "b.com", "c.org"])
        rows.append((i, f"http://{host}/{'bad' if bad else 'good'}/{rng.choice('xy')}?" + "&".join(f"{k}=1" for k in keys)) if host != "c.org" else (i, f"http://c.org/?{'&'.join(keys)}"))
    rows += [(None, "http://c.org/?same1"), (None, "http://c.org/?same1"), (-1, "http://c.org/?k1&same2&k3"), (-2, None), (-3, "http://d.org/z")]
    table = spark.createDataFrame(rows, "page_id long, url string")
    listed = [U.ListedRule("allow", "com", "/"), U.ListedRule("block", "com", "/bad/")]
    judge = lambda **how: sorted(map(tuple, U.filter_urls(table, listed, least_support=0.01, **how).collect()), key=str)
    want = judge()
    assert len(want) == len(rows) and len({r[5] for r in want}) >= 8 and {r[4] for r in want if r[3] is None} == {"allow", "block"}
    monkeypatch.setattr(U, "BLOCK_URLS", 50, raising=False)
    assert judge(most_sets=0) == want
    monkeypatch.setattr(U, "MAX_RULES", 20)
    assert judge() == want


def test_best_rule_by_brute_force():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(200):
        n_tokens, n_verdicts = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        has = np.unique(rng.random((int(rng.integers(1, 60)), n_tokens)) < rng.choice([0.4, 0.7, 0.9]), axis=0)
        counts = rng.integers(0, 4, (len(has), n_verdicts)) * (rng.random((len(has), n_verdicts)) < 0.5)
        tokens, verdicts = [f"t{i}" for i in rng.permutation(n_tokens)], ["allow", "block", "z"][:n_verdicts]
        rest = U.Rest({}, {}, {}, int(counts.sum()) + 5, float(rng.choice([0, 1, 2, 5])), float(rng.choice([0.3, 0.6, 0.9, 1.0])), rng.choice([None, 2]))
        before = None if rng.random() < 0.5 else (-float(rng.choice([0.5, 0.9, 1.0])), -4 / rest.n, 2, False, ("a", "b"), "block")
        ranks = [before] if before else []
        for k in range(min(n_tokens, (rest.most_tokens or 9) - 1) + 1):
            for part in itertools.combinations(range(n_tokens), k):
                n = counts[has[:, list(part)].all(axis=1)].sum(axis=0)
                ranks += [(-(g / n.sum()), -(g / rest.n), k + 1, v != "block", tuple(sorted(["f", *(tokens[i] for i in part)])), v) for g, v in zip(n, verdicts, strict=True) if g and g >= rest.least and g / n.sum() >= rest.least_confidence]
        want = min(ranks, default=None)
        assert U._best_with("f", tokens, has, counts, verdicts, rest, before) == want
        found += want != before
    assert found > 50


def test_urls_of_many_keys(spark):
    """Thirty keys: what only three together tell, each of which tells less than any other key, is found."""
    rng = random.Random(13)
    rows = []
    for i in range(600):
        three = [k for k in (3, 5, 27) if rng.random() < 0.7]
        bad = len(three) % 2 == 1
        keys = three + [k for k in range(30) if k not in (3, 5, 27) and rng.random() < (0.9 if bad == (k % 2 == 0) else 0.45)]
        rows.append((i, f"http://h.com/{'bad' if bad else 'good'}?" + "&".join(f"k{k}" for k in keys)))
    rows += [(1000 + i, "http://a.org?" + "&".join(f"k{k}" for k in range(30) if rng.random() < 0.7)) for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    listed = [U.ListedRule("allow", "com", "/good"), U.ListedRule("block", "com", "/bad")]
    found = U.filter_urls(table, listed, most_sets=100_000).where("page_id >= 1000").join(table.select("page_id", "url"), "page_id").collect()
    three = [r for r in found if {"k3", "k5", "k27"} <= set(r["url"].split("?")[1].split("&"))]
    assert len(found) == 30 and len(three) > 5
    assert all((r["verdict"], r["mined_rule"]) == ("block", "key=k27 key=k3 key=k5") for r in three)


def test_urls_edges(spark, empty):
    """Nulls, ties, repeated rows, very long URLs and columns that clash."""
    long = "https://x.net/" + "a/" * 20_000 + "?q=1"
    urls = [None, "", "no scheme", "://", "http://NET/es/x", "http://a.net/es", "http://a.net/es/", long, long, "http://xnet/es/"]
    table = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in U.filter_urls(table, [U.ListedRule("block", "net", "/es/")], mined=[]).collect()}
    assert [found[i] for i in range(len(urls))] == [("", None, "allow")] * 4 + [("net", "net/es/", "block"), ("a.net", None, "allow"), ("a.net", "net/es/", "block"), ("x.net", None, "allow"), ("x.net", None, "allow"), ("xnet", None, "allow")]


def test_signatures_meet():
    """Sets of similarity 0.8 or more always share a signature, at sizes of all bands and at their edges."""
    rng = np.random.default_rng(9)
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 15, 16, 17, 23, 24, 25, 37, 60, 91, 140, 220, 500]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            low, high = -(-4 * len(a) // 5), 5 * len(a) // 4
            keep = int(rng.integers(low, len(a) + 1))
            extra = int(rng.integers(0, max(high - len(a) + 1, 1)))
            b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            if G.linked(a, b):
                assert set(G.signatures(a).tolist()) & set(G.signatures(b).tolist())
                x, y = (np.frombuffer(G.sketch(s), np.uint64)[None] for s in (a, b))
                x, y = (G.folded(z, min(x.shape[1], y.shape[1])) for z in (x, y))
                assert 9 * int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b)


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return sorted((str(k), len(sets[i]), str(min(least[find(i)], default=None))) for i, (k, _) in enumerate(rows))


def test_ngram_join(spark, edge, empty, words):
    rng = random.Random(10)
    docs = []
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 8, 12, 25, 60, 200, 600]))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            docs.append(w)
    passage = rng.choices(words, k=70)
    docs += [[*rng.choices(words, k=30), *passage, *rng.choices(words, k=30)] for _ in range(15)]
    table = spark.createDataFrame([row(100 + i, " ".join(w)) for i, w in enumerate(docs)], SCHEMA).unionByName(edge)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join(table).collect())
    assert found == brute_components([(r["doc_id"], r["text"]) for r in table.collect()])
    assert ngram_join(empty).count() == 0


def test_ngram_join_in_blocks(spark, words, monkeypatch):
    """The same links where groups come in pairs of blocks, tasks send often, stars are cut, and nothing is small or broadcast."""
    from rankweave.llm import ngram_join as J

    for name, value in (("BLOCK", 3), ("SMALL", 1), ("STAR", 2), ("GATHER", 500), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(12)
    base = rng.choices(words, k=120)
    chain = [base[i : i + 100] for i in range(0, 20)]
    docs = [*chain, *(base[: 60 + i % 3] + rng.choices(words, k=60) for i in range(10)), *(rng.choices(words, k=50) for _ in range(5)), *chain[:4]]
    table = spark.createDataFrame([row(i, " ".join(w)) for i, w in enumerate(docs)], SCHEMA)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join(table).collect())
    assert found == brute_components([(r["doc_id"], r["text"]) for r in table.collect()])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 150)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[103] == found[101] == found[100] == 100 and found[200] == 150 and len(found) == 46


def test_components_not_settled(spark):
    with pytest.raises(RuntimeError, match="settled"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


def test_pipeline_stages(spark, tmp_path, words):
    import corpus_pipeline

    rng = random.Random(11)
    passage = " ".join(rng.choices(words, k=12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    english = lambda n: " ".join(rng.choices(TEXTS["en"].split() + words[:300], k=n))
    french = lambda n: " ".join(rng.choices(TEXTS["fr"].split(), k=n))
    rows = [(i, english(60), "en", "a", 0) for i in range(20)] + [(20 + i, french(60), "fr", "b", 0) for i in range(10)]
    rows += [(50, rows[3][1], "en", "a", 0), (51, rows[4][1], "en", "a", 0), (51, rows[4][1], "en", "a", 0), (52, f"{english(30)} {passage} {english(30)}", "en", "a", 0), (53, f"{english(40)} 10.1.2.3", "en", None, 0), (54, None, None, None, None), (55, "12 34", "en", "a", 0), (7, rows[7][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = sorted(str(r["doc_id"]) for r in docs.collect())
        if name != "mixture":  # which adds its own
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    ids = [str(r[0]) for r in rows]
    assert kept["language"] == sorted(x for x in ids if x not in ("54", "55"))
    assert kept["near_duplicates"] == sorted({x for x in ids if x not in ("50", "51", "54", "55")})
    assert kept["decontaminate"] == [x for x in kept["near_duplicates"] if x != "52"]
    assert kept["pii"] == kept["decontaminate"] == kept["mixture"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixture"])


def test_pipeline_stages_edges(spark, tmp_path, edge, empty):
    """Every stage by itself: nulls, empty and very long texts, repeated rows, clashing columns; and an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, edge, str(tmp_path))
        assert set(found.columns) >= set(edge.columns)
        if name in ("pii", "mixture"):
            assert found.count() == edge.count()
        if name == "mixture":
            assert found.agg(F.sum("taken")).first()[0] <= 2 * found.agg(F.sum("mix_size")).first()[0]
        assert stage(spark, empty, str(tmp_path)).count() == 0

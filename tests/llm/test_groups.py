"""Language, quality, URL rules, duplicates and search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetgauge.llm import covertree, graph, langid, quality, queries, radix, simhash, urls

from .frames import documents, rows_of, texts


def duck(sql, name, df):
    con = duckdb.connect()
    con.register(name, df.toPandas())
    return con.sql(sql)


def ends_of(pairs, vertices):
    """Smallest vertex reachable, by plain union-find."""
    up = {v: v for v in vertices}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {v: top(v) for v in vertices}


def test_components(spark):
    r = random.Random(3)
    for n, m in ((200, 150), (300, 600)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1060)]
        got = {x["vertex"]: x["root"] for x in graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
        want = ends_of(pairs, {v for p in pairs for v in p})
        assert got == {v: t for v, t in want.items() if v in got} and set(got) >= {v for a, b in pairs if a != b for v in (a, b)}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [256, 2])
def test_simhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    for extra in (False, True):
        docs = documents(spark, extra)
        rows = [(i, plain_fingerprint(t)) for i, t in rows_of(docs)]
        fps = {f for _, f in rows}
        roots = ends_of([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
        smallest = {}
        for i, f in rows:
            known = smallest.get(roots[f])
            smallest[roots[f]] = i if known is None else known if i is None else min(i, known)
        got = Counter(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()))
        assert got == Counter((i, f"{f:016x}", smallest[roots[f]]) for i, f in rows)
        left = simhash.one_of_each(docs)
        assert left.columns == docs.columns
        assert {i for i, _ in rows_of(left)} == {smallest[roots[f]] for _, f in rows} | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_lose_none(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted(p)) for p in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_exact_duplicates(spark, monkeypatch):
    for extra, first in ((False, 64), (True, 2)):
        monkeypatch.setattr(radix, "FIRST", first)
        docs = documents(spark, extra)
        got = radix.exact_duplicates(docs).collect()
        groups = defaultdict(list)
        for i, t in rows_of(docs):
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
        assert sum(r["kept"] for r in got) == len(groups) and len(got) == docs.count()
        want = Counter((i, min(g)[2], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, _, i in g)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        left = radix.without_copies(docs)
        assert left.columns == docs.columns
        assert Counter(i for i, _ in rows_of(left)) == Counter(min(g)[2] for g in groups.values())
    assert radix.exact_duplicates(docs.limit(0)).count() == 0


RULES = queries.URL_RULES
URLS = [None, "", "no scheme", "://", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/70", "http://example.com/en/", "http://example.com/en", "http://com/en/1",
        "http://xcom/en/1", "ftp://a.b.net/de/8/9", "net://net/de/", "http://example.org?/es/", "http://example.org/es/#x", "http://u@example.org:80/es/1", "x://y://com/en/", "http://É.Org/es/é/", "http://a..com/en/"]


def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[5:7])] + [(None, "http://a.org/es/")]
    return spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rest", F.lit("clash"))


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_urls(spark, size):
    rules = spark.createDataFrame(RULES + [RULES[0], ("example.com", "/en/7", "allow"), ("", "/x", "block")], "host string, path string, verdict string")
    got = urls.judge_urls(pages(spark), rules, max_index_bytes=size)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = duck(queries.oracle_sql()["op2_url_filter"], "pages", pages(spark).select("page_id", "url")).fetchall()
    fixed = lambda rows: Counter(tuple(None if x is None or x != x else x for x in r) for r in rows)             # noqa: E731
    assert fixed(map(tuple, got.collect())) == fixed(want)
    assert urls.judge_urls(pages(spark).limit(0), rules, max_index_bytes=size).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages(spark), rules.limit(0), max_index_bytes=size).collect()} == {"allow"}


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data, seed: len(data) % 3)
    rules = [(f"h{i}.com", "/p" * (i % 4), i % 2 == 0) for i in range(40)]
    path = tmp_path / "index"
    path.write_bytes(urls.write_index(rules))
    index = urls.Index(str(path))
    probes = [(h + "\0" + p).encode() for h, p, _ in rules] + [b"other\0", b"h1.com\0/x"]
    found = index.lookup(probes)
    assert list(found[-2:]) == [-1, -1] and [bool(index.block[i]) for i in found[:-2]] == [r[2] for r in rules]


def brute_top(rows, k=5, every=50):
    fit = {(i, tuple(np.floor(np.array(v) * 256.0))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in fit:
        if q % every == 0:
            best = sorted({(-int(np.dot(a, b)) if a else 0, i) for i, b in fit if i != q and len(a) == len(b)})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [16_384, 60])
def test_top_k(spark, block):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=6) * r.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [rows[100], rows[7]]
    rows += [(-50, [0.5] * 6), (2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (2200, [1.0, 2.0]), (2201, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("vec", F.lit("clash")).withColumn("a", F.lit(1))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = covertree.top_k(df, block_rows=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(exact))
    assert covertree.top_k(df.limit(0)).count() == 0


def best_scores(queries, points, k=5):
    scores = queries @ points.T
    np.fill_diagonal(scores, -np.inf)
    return np.sort(scores, axis=1)[:, -k:][:, ::-1]


class Counting(covertree.Search):
    """Counts compared pairs of rows, and pairs of nodes left out by whether the query node has nodes below."""

    def __init__(self, *args):
        self.pairs, self.out = 0, Counter()
        super().__init__(*args)

    def compare(self, query, rows):
        self.pairs += len(query.rows) * len(rows)
        super().compare(query, rows)

    def left_out(self, query, node):
        self.out[bool(query.below)] += len(query.rows) * len(node.rows)


def test_top_k_prunes(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 16)
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 8)) * 20
    points = np.floor((np.repeat(centres, 200, axis=0) + r.normal(size=(8000, 8)) * 0.05) * 16)
    found = Counting(points[:600], np.arange(600), points, np.arange(8000), 5)
    assert (best_scores(points[:600], points) == found.scores).all()
    assert found.pairs < 0.2 * 600 * 8000
    assert found.out[True] > 0.3 * 600 * 8000          # pairs of an inner query node and a candidate node


def test_top_k_where_all_lie_equally_far():
    points = np.eye(3000) * 7
    found = covertree.Search(points[:5], np.arange(5), points, np.arange(3000), 5)
    assert (found.scores == 0).all() and found.found.tolist() == [[j for j in range(6) if j != i][:5] for i in range(5)]

    def depth(node):
        return 1 + max(map(depth, node.below), default=0)
    assert depth(covertree.Node(points, np.arange(3000), 0)) < 12


def test_top_k_of_scores_beyond_doubles(spark):
    r = random.Random(4)
    vectors = [(i, [float(r.randrange(2 ** 20)) for _ in range(8)]) for i in range(60)]         # 256-fold, their products have over 53 bits
    got = covertree.top_k(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()
    whole = {i: [int(x) * 256 for x in v] for i, v in vectors}
    want = []
    for q in (0, 50):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(ranked)]
    assert sorted(map(tuple, got)) == want


def test_language(spark):
    r = random.Random(4)
    vocab = {"en": ["the", "river", "house", "walking", "green"], "de": ["das", "Haus", "grün", "laufen", "Straße"], "fr": ["maison", "était", "vert", "garçon", "rivière"]}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "12 34 ²½!", "en"), (902, "Straßen Häuser", None), (None, "the river", "en"), (903, "中文", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(df.filter(~langid.held_out()))
    got = {x["doc_id"]: x for x in langid.predict(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "de" and got[903]["lang_pred"] in model.langs
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = langid.keep_known(df, model, 0.5)
    assert kept.columns == df.columns and 900 not in {x["doc_id"] for x in kept.collect()}
    unlearnt = langid.learn(df.filter("lang = 'xx'"))
    assert {x["lang_pred"] for x in langid.predict(df, unlearnt).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_backs_off():
    entries = [(0, "known", "a", 5), (3, "xyz", "a", 3), (2, "qq", "b", 4), (1, "q", "a", 1), (1, "z", "b", 9)]
    model = langid.Model(["a", "b"], pa.table(dict(zip(("n", "gram", "lang", "count"), map(list, zip(*entries))))))
    assert model.score("known")[0] > model.score("known")[1]
    assert model.score("wxyzw")[0] > model.score("wxyzw")[1]          # three letters beat the single z
    assert model.score("qqz")[1] > model.score("qqz")[0]
    assert (model.score("mmm") == 0).all()


def plain_language(rows):
    """(language, confidence) of each text, learned from the (text, language) rows that have one, with plain dictionaries."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in langid.words(text or "") if lang is not None else []:
            for n, parts in [(0, [w])] + [(n, langid.grams(w, n)) for n in range(1, 6)]:
                for part in parts:
                    counts[n, part][lang] += 1
    langs = sorted({lang for _, lang in rows if lang is not None})
    sizes = Counter(n for n, _ in counts)
    totals = {(n, lang): sum(c[lang] for (m, _), c in counts.items() if m == n) + 0.5 * (sizes[n] + 1) for n in range(6) for lang in langs}

    def of(n, part):
        return np.array([np.log((counts[n, part][lang] + 0.5) / totals[n, lang]) for lang in langs])

    def score(w):
        if (0, w) in counts:
            return of(0, w)
        for n in range(5, 0, -1):
            known = [of(n, g) for g in langid.grams(w, n) if (n, g) in counts]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    def predict(text):
        found = langid.words(text or "")
        if not found:
            return "und", 0.0
        sums = sum(score(w) for w in found)
        return langs[int(sums.argmax())], 1 / np.exp(sums - sums.max()).sum()
    return predict


@pytest.mark.parametrize("memo", [150_000, 30])
def test_language_against_brute_force(spark, monkeypatch, memo):
    monkeypatch.setattr(langid, "MEMO", memo)
    for extra in (False, True):
        docs = documents(spark, extra)
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
        held = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
        predict = plain_language([(t, lang) for i, t, lang in rows if i is not None and i not in held])
        got = sorted(map(tuple, langid.predict(docs, langid.learn(docs.filter(~langid.held_out()))).collect()), key=repr)
        want = sorted(((i, i in held, *predict(t)) for i, t, _ in rows), key=repr)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-3)


def test_language_held_out_accuracy(spark):
    got = langid_rows(spark, "/root/testdata/sf0.01")
    own = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in own) > 0.97 * len(own)


def langid_rows(spark, sf_dir):
    return queries.op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()


def test_quality(spark):
    found = queries.op5_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [(r["keep"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels]
    assert sum(k == (q == 1) for k, q in own) > 0.95 * len(own)
    assert sum(k for k, q in own if q == 1) > 0.98 * sum(q for _, q in own)
    for extra in (False, True):
        docs = documents(spark, extra)
        rows = quality.score_quality(docs).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in rows_of(docs)) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_estimate_finds_labellers():
    r = random.Random(8)
    right = [0.95, 0.9, 0.85, 0.8, 0.6, 0.7, 0.9, 0.75, 0.65, 0.8]
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(20_000):
        good = r.random() < 0.7
        pattern = "".join("-" if r.random() < 0.2 else "1" if good == (r.random() < p) else "0" for p in right)
        counts[pattern] += 1
        truth[pattern][good] += 1
    chance, rates = quality.estimate(counts)
    for p, (bad, good) in zip(right, rates):
        assert abs(good[1] - p) < 0.05 and abs(bad[0] - p) < 0.07
    hits = sum(n for p, c in truth.items() for good, n in c.items() if (chance[p] > 0.5) == good)
    assert hits > 0.95 * 20_000


def test_contract_twins(spark):
    from tests.oracle import connect
    con = connect("/root/testdata/sf0.001")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.sql(sql)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall()), name
    assert set(queries.queries()) >= set(queries.oracle_sql()) and len(queries.queries()) == 13


def test_texts_hold_near_copies():
    assert len(set(texts())) < 120


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_url_rules_have_the_words_of_the_contract(spark, size):
    urls_of = {1: "http://a.com/en/1", 2: "http://example.com/en/7", 3: "http://example.com/en/8", 4: "http://net/de/", 5: "http://a.example.net/de/8/9",
               6: "http://example.net/de/7", 7: "http://b.org/es/", 8: "http://org/en/"}
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = urls.judge_urls(spark.createDataFrame(list(urls_of.items()), "page_id bigint, url string"), rules, max_index_bytes=size).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("com/en/", "block"), 4: ("net/de/", "allow"),
        5: ("example.net/de/8", "block"), 6: ("net/de/", "allow"), 7: ("org/es/", "block"), 8: (None, "allow")}


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_urls_with_very_long_hosts_and_paths(spark, size):
    long = "a." * 100_000
    rows = [(1, f"http://{long}example.com/en/7x"), (2, f"http://{long}org/{'es/' * 50_000}"), (3, f"http://{long}net"), (4, "http://com/en/1")]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules, max_index_bytes=size).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {1: ("example.com/en/7", "allow"), 2: ("org/es/", "block"), 3: (None, "allow"), 4: ("com/en/", "block")}


def test_quality_sample_is_bounded_without_ids(spark, monkeypatch):
    taken = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, chances: (taken.append(len(rows)), fit(rows, chances))[1])
    docs = spark.createDataFrame([(None if i % 3 else i, f"some words number {i} are here.") for i in range(6000)], "doc_id bigint, text string").repartition(4)
    assert quality.score_quality(docs, fit_rows=600).count() == 6000
    assert 300 < taken[0] < 1200


def test_words_of_letters_take_no_room_in_the_table_of_marks():
    words = "Plain ok, end. no! wait?! a_b c# it's 'quoted' x²y ² 3rd e.g. -dash semi; (par) İ don't!! ...".split()
    tests = (quality.SYMBOL.search, quality.PLAIN.fullmatch, quality.END.search, quality.DOUBLED.search)
    known = quality.Words()
    assert known.shares(words) == [sum(bool(t(w)) for w in words) / len(words) for t in tests]
    assert known and not any(w.isalpha() for w in known)
    marks = ["\0odd3", "\0empty"]
    assert quality.features(words, marks).tolist() == sorted({zlib.crc32(w.encode()) % quality.BUCKETS for w in words + marks})

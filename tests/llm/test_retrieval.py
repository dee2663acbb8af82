"""Lexical search, URL verdicts and hard negatives against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerhop.llm import hard_negatives, lexical_search, url_filter
from ledgerhop.llm.queries import URL_RULES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def last(x):
    return (x is None, "" if x is None else x)


# Lexical search


def plain_search(docs, items, top):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if s > 0:
                scored.append((-s, *last(doc_id), doc_id))
        out += [(item_id, k, s[-1], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(5)
    texts = [t for _, t, *_ in corpus if t and len(t) > 200]
    rows = [(i, " ".join(rng.choice(texts).split()[a : a + 25])) for i, a in enumerate(range(0, 60, 2))]
    rows += [(40, None), (41, "..!"), (None, "the ing"), (None, "of st"), (42, rows[0][1]), (0, rows[0][1]), (0, "the THE again é")]
    return rows


@pytest.mark.parametrize("block_terms", [200_000, 60])
def test_search(spark, docs, corpus, items, block_terms):
    df = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id", "2 as score")
    for top in (3, 10):
        got = lexical_search.search(docs, df, top, block_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search([r[:2] for r in corpus], items, top)


def test_search_of_strings_ties_and_nothing(spark, clashing, empty):
    rows = [(f"d{i % 40:02}", "one two") for i in range(60)] + [(None, "one two"), ("x", "three"), ("y", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    items = [("a", "One"), ("a", "One"), ("b", "three one"), (None, "four")]
    items_df = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((tuple(r) for r in lexical_search.search(docs, items_df, 5).collect()), key=str)
    assert got == plain_search(rows, items, 5)
    assert lexical_search.search(empty, items_df).collect() == []
    assert lexical_search.search(docs, items_df.limit(0)).collect() == []
    assert lexical_search.search(clashing, items_df).count() > 0


def test_plan_shares_sets(monkeypatch):
    rng = random.Random(3)
    shared = [{f"s{k}{i}".encode() for i in range(8)} for k in range(5)]
    items = [(i, set().union(*rng.sample(shared, 3), {f"own{i}{j}".encode() for j in range(3)})) for i in range(40)]
    plan = lexical_search.mine(items)
    assert plan.additions() < 0.2 * sum(len(t) for _, t in items)
    value = np.arange(1, len(plan.terms) + 1)
    table = lexical_search.accumulate(plan, plan.leaf, np.zeros(len(value), int), value, 1)[:, 0]
    number = dict(zip(plan.terms, value.tolist(), strict=True))
    assert table.tolist() == [sum(number[t] for t in held) for _, held in items]


def test_long_texts_in_pieces(monkeypatch):
    text = "Ab-12 é_ünïc x " * 200 + "y" * 300 + " z"
    whole = [t for run in lexical_search.term_runs(text.encode()) for t in run]
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    runs = list(lexical_search.term_runs(text.encode()))
    assert len(runs) > 50 and [t for run in runs for t in run] == whole
    assert [t.decode() for t in whole] == terms(text)


# URL verdicts


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


URLS = [
    "http://A.Net/x", "http://net", "http://net/", "http://xnet/", "http://Example.net/en/1", "http://a.example.net/en/", "http://a.example.net/EN/",
    "http://example.com/de/x?y", "https://b.example.com/de", "http://z.org/fr/#a", "http://z.org/f", "no scheme", None, "", "://", "a://b://c/d",
    "http://user@Host:80/p;q?r", "http://é.org/ü/\n/x", "http://h?x/y", "http://h#x", "http://casino-bets.example.com/en/1", "http://" + "w" * 3000 + ".io/" + "long/" * 900,
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as rule", "1 as p_blocked")
    labelled = spark.createDataFrame([*url_filter.labelled_urls(), (None, True), ("http://q", None)], "url string, blocked boolean")
    got = url_filter.judge(pages, labelled, URL_RULES).collect()
    assert sorted(str((r.page_id, r.host, r.path)) for r in got) == sorted(str((i, *plain_split(u))) for i, u in rows)
    model = url_filter.train(labelled)
    for r in got:
        fit = [(len(x.name), x) for x in URL_RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fit, key=lambda x: x[0])[1] if fit else None
        p = model.probabilities([r.host.encode()], [r.path.encode()])[0]
        assert abs(p - r.p_blocked) < 1e-9
        assert (r.rule, r.verdict) == ((best.name, best.verdict) if best else (None, "block" if p >= 0.5 else "allow"))
        if not r.host and not r.path:
            assert (r.verdict, r.p_blocked) == ("allow", 0.0)


def test_scorer_learns_names_not_shapes(spark):
    labelled = url_filter.labelled_urls()
    assert len(labelled) < 200
    folds = []
    for fold in range(5):
        held = [x for i, x in enumerate(labelled) if i % 5 == fold]
        model = url_filter.train(spark.createDataFrame([x for i, x in enumerate(labelled) if i % 5 != fold], "url string, blocked boolean"))
        split = [plain_split(u) for u, _ in held]
        p = model.probabilities([h.encode() for h, _ in split], [q.encode() for _, q in split])
        folds += [(p[i] >= 0.5) == b for i, (_, b) in enumerate(held)]
    assert np.mean(folds) >= 0.8
    one = spark.createDataFrame([("http://a/b", True)] * 3, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://c/d"), (2, None)], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.judge(pages, one).orderBy("page_id").collect()] == ["block", "allow"]
    assert {r.verdict for r in url_filter.judge(pages, one.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), one).collect() == []
    assert len(url_filter.train(one.union(one), fit_rows=1).weights) == url_filter.FEATURES


def test_url_features_in_pieces(monkeypatch):
    hosts, paths = [b"a.example.com", b"", b"x"], [b"/some/long/path/" * 20, b"", b"/"]
    whole = url_filter.features(hosts, paths)
    assert whole[1].sum() == 0 and np.isclose(whole[0].sum(), np.sqrt(url_filter.lengths(hosts, paths)[0]), rtol=1e-4)
    model = url_filter.Model(np.random.default_rng(1).normal(size=url_filter.FEATURES), 0.1)
    before = model.probabilities(hosts, paths)
    monkeypatch.setattr(url_filter, "PIECE", 7)
    assert np.allclose(url_filter.features(hosts, paths), whole) and np.allclose(model.probabilities(hosts, paths), before)


# Hard negatives


def plain_negatives(rows, positives=5, negatives=3):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(rows) if label is not None and good(v)]
    out = []
    for n, i, label, v in rows:
        if i is None or i % 50:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(v, w)), *last(j), m, j, other) for m, j, other, w in rows if m != n), key=lambda s: s[:4]
        )
        for p in [s for s in scored if s[-1] == label][:positives]:
            fits = [s for s in scored if s[-1] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[-2], k, s[-2], -p[0], -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def embeddings(rng, n, dim):
    centres = rng.normal(size=(4, dim)) / 3
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 4] + rng.normal(size=dim) / 8], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(40)]  # many equal vectors
    rows += [rows[100], rows[100], (None, rows[3][1], 1), (2000, None, 1), (2050, [0.1, None] + [0.0] * (dim - 2), 1), (2100, [float("nan")] * dim, 0)]
    rows += [(2150, [0.0] * dim, 2), (2200, [], 1), (2250, [0.5, 0.25], 3), (2300, [float("inf")] * dim, 3), (2350, rows[5][1], None)]
    return rows


@pytest.mark.parametrize("page_rows,part_rows", [(256, 50_000), (5, 60)])
def test_negatives(spark, page_rows, part_rows):
    rows = embeddings(np.random.default_rng(4), 400, 6)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    df = df.selectExpr("*", "'x' as row", "0 as anchor", "7 as rank")
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, page_rows=page_rows, part_rows=part_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)


def test_negatives_of_large_numbers_and_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 10, (rng.integers(-1 << 17, 1 << 17, 3) / 1.0).tolist(), i % 3) for i in range(60)]
    schema = "vec_id bigint, embedding array<double>, label int"
    got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, page_rows=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives.mine(spark.createDataFrame(rows, schema), F.lit(False)).collect() == []


def test_boxes_prune():
    rng = np.random.default_rng(8)
    x = np.sort(rng.integers(-200, 200, (4000, 2)), axis=0).astype(np.int64)
    found = [
        dict(label=1, vec=x[p].astype("<i2").tobytes(), low=x[p].min(0).astype("<i2").tobytes(), high=x[p].max(0).astype("<i2").tobytes(),
             rows=p.astype(np.int64).tobytes(), ids=p.astype(np.int64).tobytes(), nulls=np.zeros(len(p), np.uint8).tobytes())
        for p in hard_negatives.tiles(x, [0, 1], 16)
    ]
    forest = hard_negatives.Forest(found, 2, 200)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key)
            return super().__getitem__(key)

    forest.vectors = forest.vectors.view(Watched)
    query = np.array([3, 5])
    (best,) = forest.search(query, -1, [forest.roots[1]], [(-(10**9), None)], 5)
    scores = x @ query
    want = sorted(zip((-scores).tolist(), range(4000)))[:5]
    assert [(int(b[0]), b[3]) for b in best] == want
    assert len(seen) < 0.1 * len(found)

"""Near-duplicates, line deduplication, passages and the pipeline against plain versions."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from ledgerhop.llm import line_dedup, links, near_duplicates, passages
from ledgerhop.llm.decontamination import words_of
from .conftest import prose


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in links.classes(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == components({n for p in pairs for n in p}, pairs)


# Near-duplicates


def near_rows():
    rng = random.Random(9)
    texts = [prose(rng, "en", rng.randint(1, 150)) for _ in range(25)]
    rows = list(enumerate(texts))
    i = 100
    for base in texts[:12]:
        words = base.split(" ")
        for edits in (0, 1, 2, 5, 9):
            changed = list(words)
            for _ in range(min(edits, len(words))):
                changed[rng.randrange(len(changed))] = rng.choice(["new", "other", "zz"])
            rows.append((i, " ".join(changed)))
            i += 1
    shared = " ".join(prose(rng, "de", 40).split())
    rows += [(i + k, shared + " " + prose(rng, "fr", 8)) for k in range(8)]  # alike in a common part
    rows += [(900, None), (901, ""), (902, " \n"), (903, ""), (None, texts[3]), (None, None), (5, texts[5]), (5, texts[6])]
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    weights = near_duplicates.word_weights(df)
    sets = [near_duplicates.shingles((t or "").encode(), weights) for _, t in rows]
    pairs = [
        (a, b)
        for a, b in combinations(range(len(rows)), 2)
        if len(sets[a][0]) and len(sets[b][0]) and near_duplicates.weighted_jaccard(sets[a], sets[b]) >= 0.8
    ]
    root = components(range(len(rows)), pairs)
    classes = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[root[k]].append(i)
    want = []
    for members in classes.values():
        known = [i for i in members if i is not None]
        want += [(str(i), str(min(known, default=None)), len(members)) for i in members]
    got = [(str(r.doc_id), str(r.class_id), r.class_size) for r in near_duplicates.near_duplicates(df).collect()]
    assert sorted(got) == sorted(want)
    kept = [r.doc_id for r in near_duplicates.keep_first(df).collect()]
    assert len(kept) == len(classes)


def star_rows(n=1000):
    """A base and copies of it: each is similar to the base, hardly any to another copy."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        words = list(base)
        for at in rng.sample(range(0, 400, 5), 7):
            words[at] = rng.choice(base)  # as frequent as the others: all shingles weigh the same
        rows.append((i, " ".join(words)))
    return rows


def test_a_star_of_copies_is_one_class(spark):
    rows = star_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    weights = near_duplicates.word_weights(df)
    sets = [near_duplicates.shingles(t.encode(), weights) for _, t in rows]
    # Brute force: all pairs that share a bucket.
    sampler = near_duplicates.WeightedSampler(near_duplicates.BANDS * near_duplicates.ROWS)
    keys = np.stack([near_duplicates.band_keys(sampler.draw(*s), near_duplicates.BANDS, near_duplicates.ROWS) for s in sets])
    whole = near_duplicates.Block(sets)
    pairs = [(a, b) for a, s in enumerate(sets) for b in whole.similar(s, 0.8) if a < b and (keys[a] == keys[b]).any()]
    assert all(near_duplicates.weighted_jaccard(sets[a], sets[b]) >= 0.8 for a, b in pairs[::10])
    near_base = sum(a == 0 for a, _ in pairs)
    assert near_base > 900 and len(pairs) < 0.05 * len(rows) ** 2
    root = components(range(len(rows)), pairs)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
    assert got == root
    assert len(near_duplicates.keep_first(df).collect()) == len(set(root.values()))


def test_blocks_equal_single_comparisons():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = []
    for _ in range(80):
        keys = np.sort(rng.choice(pool, rng.integers(40, 58), replace=False))
        sets.append((keys, rng.integers(1, 3, len(keys)).astype(np.float32)))
    for limit in (0.5, 0.6, 2 / 3, 0.8):
        for one in sets[:20]:
            want = [i for i, s in enumerate(sets) if near_duplicates.weighted_jaccard(one, s) >= limit]
            assert near_duplicates.Block(sets).similar(one, limit) == want


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    df = spark.createDataFrame(star_rows(60), "doc_id bigint, text string").repartition(3)
    want = sorted(map(str, near_duplicates.near_duplicates(df).collect()))
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 7)
    assert sorted(map(str, near_duplicates.near_duplicates(df).collect())) == want


def test_weighted_draws_follow_similarity():
    rng = np.random.default_rng(6)
    sampler = near_duplicates.WeightedSampler(600)
    for share in (0.3, 0.6, 0.9):
        keys = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        weights = rng.gamma(2, 1, len(keys)).astype(np.float32)
        other = weights.copy()
        other[rng.random(len(keys)) > share] *= 0.2
        true = near_duplicates.weighted_jaccard((keys, weights), (keys, other))
        a, b = sampler.draw(keys, weights), sampler.draw(keys, other, width=64)
        assert (sampler.draw(keys, weights, width=50) == a).all()
        assert abs((a == b).mean() - true) < 0.08


def test_near_duplicates_of_odd_tables(clashing, corpus, empty):
    assert near_duplicates.near_duplicates(empty).collect() == []
    assert near_duplicates.keep_first(empty).collect() == []
    kept = near_duplicates.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 105 not in ids and ids.count(107) == 0 and 7 in ids and 8 in ids
    assert {100, 101, 102} <= set(ids) and len(ids) == len(set(i for i in ids if i is not None)) + ids.count(None)


def test_weights_follow_the_share_of_documents(docs):
    small = near_duplicates.word_weights(docs, rare_share=0.1)
    full = near_duplicates.word_weights(docs)
    assert 0 < len(small.head) < len(full.head)
    assert small.rare < full.rare and (small.weights <= small.rare).all()
    many = near_duplicates.word_weights(docs.union(docs).union(docs).union(docs), rare_share=0.1)
    assert (many.head == small.head).all()
    assert np.allclose(many.weights, small.weights, atol=0.1) and abs(many.rare - small.rare) < 0.1
    assert near_duplicates.near_duplicate_classes(docs, rare_share=0.1)[0].count() == docs.count()


# Lines


def plain_dedup(rows):
    """Runs of lines as tuples of text, and blocks of patience-aligned lines, all by hand."""
    lines = {(i, t): [x.strip(" \t\r\x0b\x0c\n") for x in t.split("\n")] for i, t in rows if i is not None and t is not None}
    runs = defaultdict(set)
    for key, ls in lines.items():
        for k, x in enumerate(ls):
            for end in range(k + 1, len(ls) + 1):
                if x and sum(len(y.split()) for y in ls[k:end]) >= 8:
                    runs[key].add(tuple(ls[k:end]))
                    break
    first = {}
    for key, own in runs.items():
        for run in own:
            first[run] = min(first.get(run, key[0]), key[0])
    out = {}
    for key, ls in lines.items():
        drop = set()
        for partner in {first[r] for r in runs[key] if first[r] < key[0]}:
            for other in [k for k in lines if k[0] == partner]:
                pairs = set(line_dedup.patience(ls, lines[other]))
                for i, j in pairs:
                    if (i - 1, j - 1) in pairs:
                        continue
                    block = []
                    while (i + len(block), j + len(block)) in pairs:
                        block.append(i + len(block))
                    if sum(len(ls[k].split()) for k in block) >= 8:
                        drop |= set(block)
        out[key] = "\n".join(x for k, x in enumerate(key[1].split("\n")) if k not in drop)
    return out


def line_table():
    rng = random.Random(2)
    stock = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 14))) for _ in range(40)]
    rows = []
    for i in range(60):
        at = rng.randint(0, 30)
        own = [prose(rng, "en", rng.randint(2, 20)).replace("\n", " ") for _ in range(rng.randint(0, 3))]
        rows.append((i, "\n".join([*own[:1], *stock[at : at + rng.randint(0, 7)], *own[1:]])))
    rows += [(70, rows[4][1]), (70, rows[4][1]), (70, rows[5][1]), (71, None), (None, rows[6][1]), (72, ""), (73, "\n\n")]
    return rows


def test_lines_equal_a_plain_search(spark):
    rows = line_table()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_dedup(rows)
    expected = sorted(str((i, want.get((i, t), t))) for i, t in rows)
    got = line_dedup.dedup_lines(df).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == expected
    assert any(r.n_deleted for r in got) and all(s < r.doc_id for r in got for s in r.sources)
    left = line_dedup.keep_new(df).collect()
    gone = [(i, t) for i, t in rows if t and t.split() and not (want.get((i, t), t)).split()]
    assert len(left) == len(rows) - len(gone)


@pytest.mark.parametrize("copies", [2, 10, 11, 1000])
def test_short_lines_are_cut_whatever_the_number_of_copies(spark, copies):
    verse = "\n".join(f"five little words of {k}" for k in range(6))
    rows = [(f"d{i:04}", f"Beginning number {i}\n{verse}") for i in range(copies)] + [("x", "not a copy")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got["d0000"].n_deleted == 0 and got["x"].n_deleted == 0
    assert all(got[f"d{i:04}"].text == f"Beginning number {i}" and got[f"d{i:04}"].sources == ["d0000"] for i in range(1, copies))


def test_a_block_whose_lines_begin_elsewhere(spark):
    block = [f"line number {k} here" for k in range(5)]
    rows = [(k, f"alone {k}\n{x}\nafter {k}") for k, x in enumerate(block)]
    rows += [(10, "\n".join(block)), (11, "Own words\n" + "\n".join(block))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[11].text == "Own words" and got[11].sources == [10] and got[10].n_deleted == 0


def test_runs_do_not_depend_on_their_place():
    rng = np.random.default_rng(3)
    hashes, sizes = rng.integers(0, 1 << 63, 50).astype(np.uint64), rng.integers(0, 12, 50).astype(np.int32)
    whole, tail = line_dedup.runs(hashes, sizes), line_dedup.runs(hashes[20:], sizes[20:])
    assert set(tail) <= set(whole) and len(set(whole)) == len(whole) and (whole[-len(tail):] == tail).all()
    assert len(line_dedup.runs(hashes[:1], np.array([7], np.int32))) == 0 and len(line_dedup.runs(hashes[:1], np.array([8], np.int32))) == 1


def test_patience():
    a, b = [1, 2, 3, 9, 4, 5], [0, 1, 2, 7, 3, 4, 5]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)]
    assert line_dedup.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert line_dedup.patience([], [1]) == []
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_lines_of_odd_tables(clashing, empty):
    assert line_dedup.dedup_lines(empty).collect() == []
    kept = line_dedup.keep_new(clashing)
    assert kept.columns == clashing.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert 105 not in rows and 107 not in rows and rows[7].own == "kept"


# Passages


def test_chain_matches_a_quadratic_search():
    rng = random.Random(12)
    for _ in range(150):
        n = rng.randint(1, 25)
        a = sorted(rng.sample(range(120), n))
        b = [rng.randint(0, 120) for _ in range(n)]
        best = []
        for i in range(n):
            before = [best[j] - 0.1 * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if b[j] < b[i]]
            best.append(5 + max([0.0, *before]))
        chains = passages.chain(a, b)
        links_ = chains[0]
        score = 5 * len(links_) - sum(0.1 * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(links_, links_[1:]))
        assert abs(score - max(best)) < 1e-9
        assert sorted(i for c in chains for i in c) == list(range(n))


def passage_rows():
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.choice(["en", "de", "fr"]), rng.randint(20, 260))) for i in range(40)]
    planted = {}
    for k in range(20):
        passage = prose(rng, "en", rng.randint(60, 90)).split()
        first = 100 + 3 * k
        rows.append((first, prose(rng, "de", 30) + " " + " ".join(passage) + " " + prose(rng, "fr", 30)))
        for later in (first + 1, first + 2):
            changed = list(passage)
            for at in rng.sample(range(len(passage)), k % 4):
                changed[at] = "other"
            rows.append((later, prose(rng, "fr", rng.randint(0, 50)) + " " + " ".join(changed) + " " + prose(rng, "en", 20)))
            planted[later] = (first, len(passage))
    rows += [(300, None), (301, ""), (302, "a b"), (None, rows[41][1]), (303, rows[41][1]), (303, rows[41][1])]
    return rows, planted


def test_planted_passages_are_found(spark):
    rows, planted = passage_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    words = {i: words_of(t.encode()) for i, t in rows if t and i is not None}
    got = passages.find_passages(df).collect()
    found = defaultdict(list)
    for r in got:
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        own, other = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        same = passages.common_words(own, other)
        assert 0.8 * max(len(own), len(other)) <= r.n_same <= same
        found[r.doc_id].append(r)
    for later, (first, size) in planted.items():
        best = max((r for r in found[later] if r.source_id == first), key=lambda r: r.n_same, default=None)
        assert best is not None and best.end - best.start >= 0.9 * size
    clean = {i for i, _ in rows if i is not None} - set(planted) - {303}
    assert not clean & set(found)
    assert any((r.start, r.end, r.source_id) == (0, len(words[303]), 101) for r in found[303])
    assert len(found[303]) == len({(r.start, r.source_id) for r in found[303]})


def test_passages_of_odd_tables(clashing, empty):
    assert passages.find_passages(empty).collect() == []
    assert {r.doc_id for r in passages.find_passages(clashing).collect()} >= {105}


@pytest.mark.parametrize(("size", "share"), [(50, 0.05), (50, 0.08), (60, 0.1), (100, 0.15), (200, 0.15)])
def test_fuzzy_passages_are_found(spark, size, share):
    """Recall against what the similarity asks for: passages in random text with randomly replaced words."""
    rng = random.Random(size)
    word = lambda: f"v{rng.randrange(20000)}"
    rows, planted = [], 0
    for k in range(60):
        own = [word() for _ in range(size)]
        copy = [word() if rng.random() < share else w for w in own]
        same = sum(a == b for a, b in zip(own, copy))
        planted += same >= 0.82 * size
        for i, passage in ((2 * k, own), (2 * k + 1, copy if same >= 0.82 * size else [])):
            rows.append((i, " ".join([*(word() for _ in range(120)), *passage, *(word() for _ in range(120))])))
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=min(50, int(0.9 * size))).collect()
    assert all(r.source_id == r.doc_id - 1 for r in found)
    assert len({r.doc_id for r in found}) >= 0.9 * planted > 30


def random_words(rng, n):
    return [f"v{rng.randrange(50000)}" for _ in range(n)]


def around(rng, passage, n=70):
    return " ".join([*random_words(rng, n), *passage, *random_words(rng, n)])


def passages_by_document(spark, texts, repartition=4):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(repartition)
    found = defaultdict(dict)
    for r in passages.find_passages(df).collect():
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        found[r.doc_id][r.source_id] = (r.start, r.end, r.source_start, r.source_end)
    return found


def test_a_passage_whose_parts_stand_first_elsewhere(spark):
    rng = random.Random(41)
    texts, wanted = {}, {}
    for k in range(0, 200, 10):
        passage = random_words(rng, 60)
        for i, part in enumerate((passage[:20], passage[20:40], passage[40:], passage, passage, passage)):
            texts[k + i] = around(rng, part)
        texts[k + 6] = texts[k + 5]
        wanted[k] = {k + 4, k + 5, k + 6}
    found = passages_by_document(spark, texts)
    assert set(found) == set().union(*wanted.values())
    for k, later in wanted.items():
        for i in later:
            assert found[i][k + 3] == (70, 130, 70, 130)
        assert found[k + 6][k + 5] == (0, 200, 0, 200)


def test_a_passage_held_twice(spark):
    rng = random.Random(42)
    passage, other = random_words(rng, 60), random_words(rng, 60)
    texts = {
        1: around(rng, passage), 2: around(rng, passage + random_words(rng, 90) + passage),
        3: around(rng, other[:30] + random_words(rng, 90) + other[30:] + random_words(rng, 90) + other), 4: around(rng, other),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {(r.doc_id, r.start, r.end, r.source_id, r.source_start, r.source_end) for r in passages.find_passages(df).collect()}
    assert found == {(2, 70, 130, 1, 70, 130), (2, 220, 280, 1, 70, 130), (4, 70, 130, 3, 310, 370)}


@pytest.mark.parametrize(("hot", "block"), [(64, 512), (10, 16), (10, 512)])
def test_a_common_line_hides_no_passage(spark, monkeypatch, hot, block):
    """Hundred documents share a line; the only passage has its other words changed one in five, so no other seed tells of it."""
    monkeypatch.setattr(passages, "HOT_GROUP", hot)
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(43)
    line = random_words(rng, 14)
    texts = {i: around(rng, line) for i in range(100)}
    own = random_words(rng, 23), random_words(rng, 23)
    for i in (57, 83):
        changed = [[f"c{i}" if at % 5 == 0 else w for at, w in enumerate(part)] for part in own]
        texts[i] = around(rng, changed[0][::-1] + line + changed[1])
    found = passages_by_document(spark, texts)
    assert set(found) == {83} and set(found[83]) == {57}


def test_word_maps_bound_the_words_in_common():
    rng = random.Random(44)
    for _ in range(50):
        a, b = ([b"%d" % rng.randrange(60) for _ in range(rng.randint(0, 180))] for _ in range(2))
        (x, taken_x), (y, taken_y) = passages.word_map(a), passages.word_map(b)
        both = bin(int.from_bytes(x) & int.from_bytes(y)).count("1")
        shared = sum(min(a.count(w), b.count(w)) for w in set(a))
        assert both + min(taken_x, taken_y) >= shared >= passages.common_words(a, b)


def test_a_common_line_pairs_only_what_goes_on_beyond_it(spark):
    """Few words make all bit maps alike; one pair has the words around in common too, on one side three words further off."""
    rng = random.Random(45)
    line, before, after = random_words(rng, 14), random_words(rng, 20), random_words(rng, 25)
    few = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    texts = {i: few(70) + line + few(70) for i in range(250)}
    texts[300] = few(50) + before + line + after + few(45)
    texts[301] = few(50) + before + line + few(3) + after + few(42)
    texts |= {i: [*few(74 - i % 7), *(["the"] * (52 + i % 9)), *few(60)] for i in range(400, 520)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string").repartition(4)
    places = [(i // 400, i, 73 if i < 400 else 80 - i % 7, True, 252 if i < 400 else 120) for i in texts]
    hot = spark.createDataFrame(places, "seed bigint, id bigint, pos int, open boolean, n bigint")
    pairs = {(r.id, r.src) for r in passages.alike(hot, df, 50, 0.8).collect()}
    assert (301, 300) in pairs and len({p for p in pairs if p[0] < 400}) < 500
    run = {p for p in pairs if p[0] >= 400}
    assert {x for x, _ in run} == set(range(401, 520)) and {(x, 400) for x in range(401, 520)} <= run and len(run) < 1000


def hot_places(spark, texts):
    """Places of seeds that more than 64 of the texts have, as open ones, and the texts as a table."""
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string").repartition(4)
    seeds = passages.document_seeds(df).filter("pos >= 0")
    sizes = seeds.groupBy("seed").count().filter("count > 64")
    return df, seeds.join(sizes, "seed").selectExpr("seed", "id", "pos", "true as open", "count as n").cache()


def test_places_of_one_stretch_are_met_together(spark):
    """A stretch of one word has a seed at nearly every place; a pair of texts that goes on alike behind it is a row for
    some eight of them, and the row tells all."""
    rng = random.Random(46)
    tail = random_words(rng, 30)
    texts = {i: [*random_words(rng, 70 + i % 5), *["the"] * (24 + i % 3), *random_words(rng, 70)] for i in range(100)}
    for i, before in ((200, 60), (201, 75)):
        texts[i] = [*random_words(rng, before), *["the"] * 25, *tail, *random_words(rng, 40)]
    df, hot = hot_places(spark, texts)
    places = defaultdict(dict)
    for r in hot.collect():
        places[r.id][r.seed] = r.pos
    shared = {(places[201][seed], pos) for seed, pos in places[200].items() if seed in places[201]}
    rows = [r for r in passages.alike(hot, df, 50, 0.8).collect() if (r.id, r.src) == (201, 200)]
    assert len(shared) > 12
    assert {(r.a + k * r.step, r.b + k * r.step) for r in rows for k in range(8) if r.bits >> k & 1} == shared
    assert len(rows) <= 2 + len(shared) / 4


def test_places_of_a_stretch_that_begins_anew_are_kept(spark):
    """The numbers go on in the second stretch of a text; what isn't at the same distance there is met by itself."""
    rng = random.Random(47)
    tail = random_words(rng, 30)
    texts = {i: [*random_words(rng, 70), *["the"] * 30, *random_words(rng, 70)] for i in range(100)}
    texts[200] = [*random_words(rng, 60), *["the"] * 30, *tail, *random_words(rng, 40)]
    texts[201] = [*random_words(rng, 60), *["the"] * 12, *random_words(rng, 80), *["the"] * 20, *tail, *random_words(rng, 40)]
    df, hot = hot_places(spark, texts)
    found = {(r.a + k * r.step, r.b + k * r.step)
             for r in passages.alike(hot, df, 50, 0.8).collect() if (r.id, r.src) == (201, 200)
             for k in range(8) if r.bits >> k & 1}
    places = {(r.id, r.seed): r.pos for r in hot.collect()}
    assert {a for a, _ in found} >= {pos for (i, seed), pos in places.items() if i == 201 and pos >= 152 and (200, seed) in places}


def test_words_on_other_sides_are_no_passage(spark):
    rng = random.Random(48)
    line, one, other = random_words(rng, 14), random_words(rng, 45), random_words(rng, 45)
    texts = {i: [*random_words(rng, 70), *line, *random_words(rng, 70)] for i in range(100)}
    texts |= {200: one + line + other, 201: other + line + one, 202: [*random_words(rng, 9), *one, *line, *random_words(rng, 30)]}
    df, hot = hot_places(spark, texts)
    assert {(r.id, r.src) for r in passages.alike(hot, df, 50, 0.8).collect()} == {(202, 200)}


def test_chains_of_many_groups_are_those_of_each():
    rng = random.Random(49)
    groups, matches = {}, []
    for g in range(400):
        a, b, at = rng.randrange(100), rng.randrange(100), 0
        steady = rng.random() < 0.5
        for _ in range(rng.randint(1, 30)):
            matches.append((g // 3, g, a + at, b + at if steady else rng.randrange(200)))
            at += rng.randint(1, rng.choice([3, 8, 30]))
    rng.shuffle(matches)
    for i, src, a, b in sorted(matches):
        groups.setdefault((i, src), []).append((a, b))
    wanted = set()
    for key, pairs in groups.items():
        p, q = zip(*pairs)
        for links_ in passages.chain(list(p), list(q)):
            if len(links_) > 1 and p[links_[-1]] - p[links_[0]] + 5 >= 8:
                wanted.add((*key, tuple(p[k] for k in links_), tuple(q[k] for k in links_)))
    columns = [np.asarray(c, np.int64) for c in zip(*matches)]
    got = [(r["id"], r["src"], tuple(r["at"]), tuple(r["source_at"])) for b in passages.chains_of(columns) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_many_alignments_are_those_of_each():
    rng = random.Random(50)
    rows = []
    while len(rows) < 400:
        a = [rng.randrange(v) for v in [rng.choice([2, 5, 50, 1000])] for _ in range(rng.randint(8, 150))]
        b = [rng.randrange(50) for _ in range(rng.randint(0, 20))]
        for w in a:
            b += rng.choice([[w]] * 12 + [[rng.randrange(50)], [], [w, rng.randrange(50)]])
        pairs = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if abs(i - j) < 40 and a[i : i + 5] == b[j : j + 5]]
        pairs = sorted(p for p in pairs if rng.random() < 0.5)
        if pairs:
            links_ = passages.chain([i for i, _ in pairs], [j for _, j in pairs])[0]
            rows.append((a, b, [pairs[k][0] for k in links_], [pairs[k][1] for k in links_]))
    words = [np.concatenate([np.asarray(r[k], np.uint32) for r in rows]) for k in (0, 1)]
    ends = [np.append(0, np.cumsum([len(r[k]) for r in rows])) for k in (0, 1)]
    number = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    p, q = (np.concatenate([r[k + 2] for r in rows]) + ends[k][number] for k in (0, 1))
    got = passages.align_all(*words, ends, np.arange(len(rows)), number, p, q)
    assert [tuple(r) for r in np.stack(got, 1).tolist()] == [passages.align(*r) for r in rows]


# Pipeline


def test_pipeline_stages_equal_their_operators(spark, tmp_path, corpus):
    rng = random.Random(31)
    item = prose(rng, "en", 30)
    rows = [r for r in corpus if r[0] is not None] + [(400, prose(rng, "de", 60) + "\n" + item, "de", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "decontamination":
            assert item.split("\n")[1] not in docs.filter("doc_id = 400").first().text
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(*key).collect())) == sorted(map(str, docs.select(*key).collect()))
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {100, 101, 102, 103, 105, 107} and set(range(20)) <= kept


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_of_an_empty_table(spark, tmp_path, empty, name):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path)).collect() == []

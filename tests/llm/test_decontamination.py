"""Hits and cut texts against a plain search."""

import hashlib
import random
import re

from ledgerhop.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    words = plain_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = plain_words(item)
        k = min(len(w), window)
        for p in range(len(w) - k + 1 if w else 0):
            for q in range(len(words) - k + 1):
                if words[q : q + k] == w[p : p + k]:
                    hit |= set(range(q, q + k))
                    found.add(item_id)
    return words, hit, found


def table(spark):
    rng = random.Random(1)
    alphabet = ["a", "b", "c", "d", "E", "é"]
    def text(n):
        return "".join(rng.choice(alphabet) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(3, text(6)), (20, None), (21, "..."), (None, "b a b a c c")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(90, None), (None, items[0][1]), (91, ""), (91, "")]
    return items, rows, spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string")


def test_hits(spark):
    items, rows, items_df, docs_df = table(spark)
    for window in (3, 5, 10):
        got = sorted((tuple(r) for r in dc.find_hits(docs_df, items_df, window).collect()), key=str)
        want = []
        for i, text in rows:
            words, hit, found = brute(text, items, window)
            names = sorted(str(x) for x in found if x is not None)
            want.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want, key=str)


def test_blocks_agree(spark):
    items, rows, items_df, docs_df = table(spark)
    assert dc.item_blocks(items_df, 5).count() == 1
    assert dc.item_blocks(items_df, 5, block_words=10).count() > 3
    one, many = (sorted(map(str, dc.find_hits(docs_df, items_df, 5, block_words=n).collect())) for n in (500_000, 10))
    assert one == many
    one, many = (sorted(map(str, dc.decontaminate(docs_df, items_df, 5, block_words=n).collect())) for n in (500_000, 10))
    assert one == many and len(one) < len(rows)


def test_spans_are_cut_and_the_rest_kept(spark, clashing, empty):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string")
    rows = [
        (1, "Start of text, " + "w " * 30 + passage.title() + "! The end."), (2, passage), (3, "clean é"), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "doc_id as bytes")
    got = {r.doc_id: r for r in dc.decontaminate(docs, items).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].text == "Start of text, " + "w " * 30 + "! The end."
    assert got[3].text == "clean é" and got[4].text is None and got[5].text == ""
    assert all(r.bytes == r.doc_id for r in got.values())
    assert dc.decontaminate(empty, items).collect() == []
    same = dc.decontaminate(clashing, items)
    assert same.columns == clashing.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, clashing.collect()))
    none = dc.find_hits(docs, items.limit(0))
    assert not any(r.contaminated for r in none.collect())

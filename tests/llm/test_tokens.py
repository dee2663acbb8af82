"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerhop.llm import packing, token_counts
from ledgerhop.llm.common import WordTokens, vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    return Tokenizer.from_file(vocabulary_path(token_counts.WORD_BPE))


def ids(encoder, text):
    return encoder.encode(text or "", add_special_tokens=False).ids


def test_word_cache_equals_library(encoder):
    rng = random.Random(5)
    alphabet = [*"abXYZ 09'st.,!éÉ́̇\x00\x1c\x85\t\nΣ<|>_-…漢🙂İıß", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "\r\n"]
    tokens = WordTokens(token_counts.WORD_BPE, words=40, parts=60, longest=6)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(next(tokens.ids([text.encode()])), "<u4").tolist() == ids(encoder, text), repr(text)


def test_counts(docs, corpus, encoder):
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, limit=300).fillna(-1, "doc_id").collect())
    want = sorted(
        (-1 if i is None else i, len((t or "").encode()), n := len(ids(encoder, t)), n > 300) for i, t, *_ in corpus
    )
    assert got == want


def test_cache_encodes_only_what_is_new(spark, docs, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(docs.filter("doc_id < 50"), cache=cache).count()
    seen = []
    real = token_counts.encoded
    monkeypatch.setattr(token_counts, "encoded", lambda texts, v: seen.append(texts.count()) or real(texts, v))
    all_rows = token_counts.count_tokens(docs, cache=cache).count()
    again = token_counts.count_tokens(docs, cache=cache).count()
    assert all_rows == again == docs.count()
    distinct = docs.select(token_counts.normalised(docs.text)).distinct().count()
    old = docs.filter("doc_id < 50").select(token_counts.normalised(docs.text)).distinct().count()
    assert seen == [distinct - old, 0]
    # Another tokenizer version has counts of its own.
    other = token_counts.count_tokens(docs.filter("doc_id < 5"), vocabulary="byte_bpe_50k.json", cache=cache)
    assert other.count() == 5 and seen[-1] == 5


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty).collect() == []
    assert packing.pack(empty).collect() == []


def check_packing(rows, want, capacity, encoder):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(pieces, key=str) == sorted({i for i, _ in want}, key=str)
    expected = []
    for i, text in want:
        all_ids = [*ids(encoder, text), 1]
        for k, at in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[at : at + capacity]
            expected.append((str(i), k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    return len(sequences), sum(e[3] for e in expected)


@pytest.mark.parametrize("capacity", [64, 300, 4096])
def test_packing(docs, corpus, encoder, capacity):
    rows = packing.pack(docs, capacity=capacity).collect()
    n, tokens = check_packing(rows, [(r[0], r[1]) for r in corpus], capacity, encoder)
    assert n <= -(-tokens // capacity) + 1


def test_plan_fills_gaps_exactly():
    rng = random.Random(3)
    counts = defaultdict(int)
    for _ in range(3000):
        counts[min(256, max(1, int(rng.lognormvariate(4, 1))))] += 1
    slots = packing.packing_plan(dict(counts), 256)
    used = defaultdict(int)
    for length, first, end, *_ in sorted(slots):
        assert used[length] == first  # ranks are dealt once, in order
        used[length] = end
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert max(s[4] + (s[2] - s[1]) // s[3] for s in slots) <= -(-total // 256) + 1


@pytest.mark.parametrize(
    ("counts", "gap", "want"),
    [({5: 1, 3: 1, 2: 1}, 5, [5]), ({3: 1, 2: 1}, 5, [3, 2]), ({2: 1}, 4, []), ({2: 2}, 4, [2, 2]),
     ({4: 1, 2: 2}, 8, [4, 2, 2]), ({3: 2}, 9, []), ({3: 3}, 9, [3, 3, 3])],
)
def test_complements(counts, gap, want):
    left = np.zeros(11, np.int64)
    for k, n in counts.items():
        left[k] = n
    assert packing.fill_gap(left, gap) == want


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_equal_their_library(docs, corpus, vocabulary):
    """Tokenizers that keep white space and case are not cut into words."""
    path = vocabulary_path(vocabulary)
    if path.endswith(".model"):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        library = Tokenizer.from_file(path)
        read = lambda t: library.encode(t, add_special_tokens=False).ids
    got = sorted(tuple(r)[:3] for r in token_counts.count_tokens(docs, vocabulary=vocabulary).fillna(-1, "doc_id").collect())
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), len(read(t or ""))) for i, t, *_ in corpus)


def test_long_texts_in_pieces(encoder):
    text = "Some Words, and 123 more!\n" * 400 + "é" * 50
    tokens = WordTokens(token_counts.WORD_BPE)
    import ledgerhop.llm.common as common

    assert b"".join(common.cut_at_blanks(text.encode(), 100)) == text.encode()
    assert len(list(common.cut_at_blanks(text.encode(), 100))) > 50
    assert np.frombuffer(next(tokens.ids([text.encode()])), "<u4").tolist() == ids(encoder, text)

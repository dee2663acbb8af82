"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. Training words are streamed
through it: the state and the length of the longest match that ends at each word follow from the
word before. A match of ``window`` words or more means that a window of an item ends there; short
items are windows as a whole. Runs of words that no pair of neighbouring item words allows are
skipped before (the root's transitions two deep), which changes no match.

Items are dealt into blocks of at most ``block_words`` words (or one item); tasks build the automaton of
each and write it to a table. One automaton at a time is broadcast and goes over all documents; what
earlier ones have hit travels with the documents as one bit per word and a list of items. So neither
the driver nor a worker holds more than a block, however large the benchmark is.

Defined cases: a null text has no words and stays null; items without words are no windows; items
with a null id still mark words but are not listed; repeated ids count once; very long texts are
whole. Without items nothing is hit. All other columns are passed through.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerhop.llm.common import as_bytes, fresh, map_batches
from ledgerhop.operators.ordering import running_sum
from ledgerhop.staging import stage, stage_counted

WINDOW = 10
#: A document loses everything when more than this share of its words is hit.
MAX_COVERAGE = 0.5
BLOCK_WORDS = 500_000
#: Lower case for A-Z, a blank for what separates words; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of the items of one block, over word numbers."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.longest, self.link = [0], [-1]
        numbered = []
        for item_id, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                numbered.append((item_id, ids))
                last = 0
                for w in ids:
                    last = self.extend(last, w)
        self.shortest = min((min(len(ids), window) for _, ids in numbered), default=0)
        self.mark_windows(numbered)
        pairs = sorted({a << 32 | b for _, ids in numbered for a, b in zip(ids, ids[1:])})
        self.pairs = np.asarray(pairs, np.int64)

    def extend(self, last: int, w: int) -> int:
        """Append one word behind state ``last``; states of other items are shared."""
        moves, longest, link = self.moves, self.longest, self.link
        if w in moves[last]:
            at = moves[last][w]
            return at if longest[at] == longest[last] + 1 else self.split(last, w, at)
        new = self.add({}, longest[last] + 1, 0)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            at = moves[p][w]
            link[new] = at if longest[at] == longest[p] + 1 else self.split(p, w, at)
        return new

    def split(self, p: int, w: int, at: int) -> int:
        """A copy of state ``at`` for its matches no longer than those of ``p`` and ``w``."""
        copy = self.add(dict(self.moves[at]), self.longest[p] + 1, self.link[at])
        self.link[at] = copy
        while p >= 0 and self.moves[p].get(w) == at:
            self.moves[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, moves: dict[int, int], longest: int, link: int) -> int:
        self.moves.append(moves)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.moves) - 1

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match at ``state``."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    def mark_windows(self, numbered: list[tuple[str | None, list[int]]]) -> None:
        """Items by the state of each window, and for every state the windows that end with it."""
        own: dict[int, dict[int, set]] = {}
        for item_id, ids in numbered:
            size, state = min(len(ids), self.window), 0
            for n, w in enumerate(ids, 1):
                state = self.moves[state][w]
                if n >= size:
                    own.setdefault(self.holding(state, size), {}).setdefault(size, set()).add(item_id)
        #: State -> [(length of the window, items)], from its own and all shorter suffixes.
        self.windows: list[list[tuple[int, tuple]]] = [[] for _ in self.moves]
        for state in sorted(range(1, len(self.moves)), key=self.longest.__getitem__):
            mine = [(n, tuple(items)) for n, items in own.get(state, {}).items()]
            self.windows[state] = sorted(mine, key=lambda x: -x[0]) + self.windows[self.link[state]]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        mask = np.zeros(len(words), bool)
        found: set = set()
        if len(words) < self.shortest or not self.shortest:
            return mask, found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        for begin, end in self.candidate_runs(ids):
            state = length = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and w not in self.moves[state]:
                    state = self.link[state]
                    length = self.longest[state]
                if w in self.moves[state]:
                    state = self.moves[state][w]
                    length += 1
                for size, items in self.windows[state]:
                    if size <= length:
                        mask[i - size : i] = True
                        found.update(items)
        return mask, found

    def candidate_runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of item words, all neighbours being neighbours in an item, long enough for a window."""
        known = ids > 0
        key = ids[:-1] << 32 | ids[1:]
        at = np.searchsorted(self.pairs, key)
        follows = np.zeros(len(ids), bool)
        if len(self.pairs):
            follows[1:] = known[1:] & known[:-1] & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key)
        starts = np.flatnonzero(known & ~follows)
        if not len(starts):
            return
        ends = np.append(starts[1:], len(ids))
        breaks = np.flatnonzero(~known)
        cut = np.append(breaks, len(ids))
        ends = np.minimum(ends, cut[np.searchsorted(breaks, starts)])
        long = ends - starts >= self.shortest
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def item_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block of items with its pickled automaton, written."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), as_bytes()).distinct()

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(words_of(t)) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, n], ["item_id", "text", "n"]).filter(pc.greater(n, 0))

    staged, total = stage_counted(map_batches(rows, measure, "item_id string, text binary, n bigint"), "items", F.sum("n"))
    if total <= block_words:
        dealt = staged.withColumn("block", F.lit(0).cast("bigint"))
    else:
        numbered = staged.withColumns({"every": F.lit(0), "key": F.xxhash64("item_id", "text"), "row": F.monotonically_increasing_id()})
        upto = running_sum(numbered, ["every"], ["key", "row"], "n", "upto")
        dealt = upto.withColumn("block", F.floor((F.col("upto") - F.col("n")) / block_words).cast("bigint"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_by_block(batches):
            automaton = ItemAutomaton([(i, words_of(t)) for i, t in block], window)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(automaton)], pa.binary())], ["automaton"])

    by_block = dealt.select("block", "item_id", "text").repartition("block").sortWithinPartitions("block")
    return stage(by_block.mapInArrow(build, "automaton binary"), "automata")


def rows_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """(item_id, text) of each block, of rows sorted by block."""
    held, block = None, []
    for batch in batches:
        for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block and number != held:
                yield block
                block = []
            held = number
            block.append(tuple(row))
    if block:
        yield block


def scan(automaton: ItemAutomaton | None, words: list[bytes], mask: bytes | None = None,
         items: list | None = None) -> tuple[np.ndarray, set]:
    """Hit words and items of a text: those known from earlier blocks and those of this one."""
    hit, found = automaton.hits(words) if automaton else (np.zeros(len(words), bool), set())
    if mask:
        hit |= np.unpackbits(np.frombuffer(mask, np.uint8), count=len(words)).astype(bool)
    return hit, found.union(items or ())


def through_blocks(rows: DataFrame, blocks: DataFrame, text: str, mask: str, items: str):
    """``rows`` with the hits of all blocks but the last in ``mask`` and ``items``, and the broadcast last one."""
    context = rows.sparkSession.sparkContext
    held = None
    rows = rows.withColumns({mask: F.lit(None).cast("binary"), items: F.lit(None).cast("array<string>")})
    for row in blocks.toLocalIterator():  # one block in the driver at a time
        if held is not None:
            rows = stage(with_hits(rows, held, text, mask, items), "hits")
            held.destroy()
        held = context.broadcast(pickle.loads(bytes(row["automaton"])))
    return rows, context.broadcast(None) if held is None else held


def with_hits(rows: DataFrame, shared, text: str, mask: str, items: str) -> DataFrame:
    names, at = rows.columns, rows.columns.index(text)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, lists = [], []
        known = (batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1))
        for body, before, seen in zip(*known, strict=True):
            hit, found = scan(shared.value, words_of(body), before, seen)
            masks.append(np.packbits(hit).tobytes() if hit.any() else None)
            lists.append(sorted(found, key=lambda x: (x is None, x)) if found else None)
        columns = [*batch.columns[:-2], pa.array(masks, pa.binary()), pa.array(lists, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(rows, mark, rows.schema)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    rows = docs.select("doc_id", as_bytes())
    rows, last = through_blocks(rows, item_blocks(items, window, block_words), "text", "mask", "items")

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, n_items, digest = [], [], [], []
        for text, before, seen in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = words_of(text)
            mask, found = scan(last.value, words, before, seen)
            names = sorted(x for x in found if x is not None)
            n_words.append(len(words))
            n_hit.append(int(mask.sum()))
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        hit = pa.array(n_hit, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), hit, pa.array(n_items, pa.int64()),
             pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
              "contaminated boolean")  # fmt: skip
    return map_batches(rows, search, schema)


def without_spans(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the bytes from the first to the last word of each hit run."""
    spans = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    out, at = [], 0
    for first, last in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True):
        out.append(text[at : spans[first][0]])
        at = spans[last][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``, and without the rows of which more than
    ``max_coverage`` of the words are hit. Untouched texts stay as they are, byte for byte."""
    body, mask_name, items_name = fresh(docs.columns, "bytes", "mask", "items")
    names, at = docs.columns, docs.columns.index("text")
    # The text itself travels once, as bytes; its column holds a null until it is filled again.
    hollow = [F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*hollow, as_bytes().alias(body))
    rows, last = through_blocks(rows, item_blocks(items, window, block_words), body, mask_name, items_name)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, masks = (batch.column(batch.num_columns - i).to_pylist() for i in (3, 2))
        keep = []
        for row, (text, before) in enumerate(zip(texts, masks, strict=True)):
            words = words_of(text)
            mask, _ = scan(last.value, words, before)
            hit = int(mask.sum())
            if hit:
                texts[row] = without_spans(text, mask)
            keep.append(hit <= max_coverage * len(words))
        columns = [*batch.columns[:-3]]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return map_batches(rows, clean, schema)

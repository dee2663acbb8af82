"""Ranked lexical search of many items at once, sharing the work of their common terms.

Scores are sums over the terms of an item, so items that share a set of terms share its partial sum.
Items are dealt into blocks of at most ``block_terms`` terms, alike ones (by their least term hash) next
to each other, and each block is mined in a task for shared term sets: terms that the same items hold
become one leaf, then pairs of nodes that follow each other in the items' common order are merged, most
frequent first, as long as two items share a pair. The merges are a DAG. A document's accumulators of
all nodes are computed once, level by level, and the items only add up the few nodes they end in.

Each block passes the corpus once: documents are tokenized, their counts of the block's terms written;
document frequencies follow from that table; then every task ranks its documents against all items of
the block and sends on the ``top`` best of each. What is broadcast is a block: bounded by ``block_terms``
(or by a single item, if that is larger). Items never meet in the driver beyond one block.

Defined cases: null and empty texts, and texts without a term, are no documents and no items; equal
(item_id, text) rows are one item, other rows with an equal id are items of their own; every document
row is a document, repeated or not; equal scores go by ascending doc_id, null ids last (as the id of an
item null is a value). Texts are read whole, long ones in pieces cut between terms. Other columns
are ignored. Score and counts are exact 64-bit integers.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.llm.common import LOWER, as_bytes, map_batches
from ledgerhop.llm.decontamination import rows_by_block
from ledgerhop.operators.ordering import running_sum
from ledgerhop.staging import stage, stage_counted

TOP = 10
BLOCK_TERMS = 200_000
#: Numbers in one table of accumulators (nodes x documents).
CELLS = 4_000_000
PIECE = 1 << 22
#: Every byte that is no digit, letter or part of a wider character becomes a blank, A-Z a-z.
TERMS = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: In the table of counts: documents with a term, and terms of all documents.
N_DOCS, N_TERMS = -1, -2


def term_runs(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists of a few MB."""
    clean = (text or b"").translate(TERMS)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE) if len(clean) - at > PIECE else -1
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_set(text: bytes | None) -> set[bytes]:
    return {t for run in term_runs(text) for t in run}


@dataclass
class Plan:
    """Sharing plan of a block: terms and their leaves, merges by level, and the nodes of each item."""

    terms: list[bytes]
    leaf: np.ndarray
    leaves: int
    nodes: int
    #: For each level (node, left, right) arrays.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: The nodes of all items one after the other, and where each item begins.
    ends: np.ndarray
    begins: np.ndarray
    item_ids: list

    def additions(self) -> int:
        """Additions a document costs with the plan, leaves aside."""
        return sum(len(n) for n, _, _ in self.levels) + len(self.ends)


def mine(items: list[tuple[object, set[bytes]]]) -> Plan:
    """Plan of items with at least one term each."""
    holders: dict[bytes, list[int]] = {}
    for i, (_, terms) in enumerate(items):
        for t in sorted(terms):
            holders.setdefault(t, []).append(i)
    by_items: dict[tuple, int] = {}
    leaf = np.array([by_items.setdefault(tuple(h), len(by_items)) for h in holders.values()], np.int32)
    nodes = len(by_items)
    rows: list[list[int]] = [[] for _ in items]
    for held, node in sorted(by_items.items(), key=lambda x: (-len(x[0]), x[1])):
        for i in held:
            rows[i].append(node)
    depth = [0] * nodes
    merges: list[tuple[int, int, int]] = []
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:]))
        taken: set[int] = set()
        chosen: dict[tuple[int, int], int] = {}
        for pair, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if n >= 2 and taken.isdisjoint(pair):
                taken.update(pair)
                chosen[pair] = nodes
                merges.append((nodes, *pair))
                depth.append(1 + max(depth[pair[0]], depth[pair[1]]))
                nodes += 1
        if not chosen:
            break
        rows = [merged(row, chosen) for row in rows]
    levels = []
    for level in range(1, max(depth, default=0) + 1):
        at = [m for m in merges if depth[m[0]] == level]
        levels.append(tuple(np.array([m[k] for m in at], np.int64) for k in range(3)))
    begins = np.cumsum([0, *(len(r) for r in rows)])[:-1]
    ends = np.array([n for r in rows for n in r], np.int64)
    return Plan(list(holders), leaf, len(by_items), nodes, levels, ends, begins, [i for i, _ in items])


def merged(row: list[int], chosen: dict[tuple[int, int], int]) -> list[int]:
    """The row with each chosen pair of neighbours as its node; no node is in two chosen pairs."""
    out, i = [], 0
    while i < len(row):
        node = chosen.get((row[i], row[i + 1])) if i + 1 < len(row) else None
        out.append(row[i] if node is None else node)
        i += 1 if node is None else 2
    return out


def plans(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per block with its pickled plan."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [sorted(term_set(t)) for t in batch.column(1).to_pylist()]
        least = [min((hash_of(t) for t in s), default=0) for s in sets]
        rows = pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.binary())), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.int64())],
            ["item_id", "terms", "n", "least"],
        )
        return rows.filter(pc.greater(rows.column(2), 0))

    rows = map_batches(items.select("item_id", as_bytes()).distinct(), cut, f"item_id {kind}, terms array<binary>, n bigint, least bigint")
    staged, total = stage_counted(rows, "search-items", F.sum("n"))
    if total <= block_terms:
        dealt = staged.withColumn("block", F.lit(0).cast("bigint"))
    else:
        numbered = staged.withColumn("every", F.lit(0)).withColumn("key", F.xxhash64("terms", "item_id")).withColumn("row", F.monotonically_increasing_id())
        upto = running_sum(numbered, ["every"], ["least", "key", "row"], "n", "upto")
        dealt = upto.withColumn("block", F.floor((F.col("upto") - F.col("n")) / block_terms).cast("bigint"))
    sorted_blocks = dealt.select("block", "item_id", "terms").repartition("block").sortWithinPartitions("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_by_block(batches):
            plan = mine([(item_id, set(terms)) for item_id, terms in block])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plan)], pa.binary())], ["plan"])

    return stage(sorted_blocks.mapInArrow(pack, "plan binary"), "search-plans")


def hash_of(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term) >> 1


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the document), terms (numbers in the vocabulary) and tfs, of documents with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary.value
        n, numbers, rows = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            total = 0
            for run in term_runs(text):
                found = np.fromiter(map(known.get, run, repeat(-1)), np.int64, len(run))
                found = found[found >= 0]
                numbers.append(found)
                rows.append(np.full(len(found), row, np.int64))
                total += len(run)
            n.append(total)
        keys = np.concatenate([np.zeros(0, np.int64), *rows]) * max(1, len(known)) + np.concatenate([np.zeros(0, np.int64), *numbers])
        keys, tfs = np.unique(keys, return_counts=True)
        of, term = np.divmod(keys, max(1, len(known)))
        offsets = pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32))
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int64)))],
            ["doc_id", "n", "terms", "tfs"],
        )
        return out.filter(pc.greater(out.column(1), 0))

    return map_batches(docs.select("doc_id", as_bytes()), count, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def totals(counted: DataFrame, size: int) -> dict[int, int]:
    """Document frequency by number of term, with N_DOCS and N_TERMS; each task sends its sums only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            n_docs += batch.num_rows
            n_terms += pc.sum(batch.column(0)).as_py() or 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([N_DOCS, N_TERMS, *at.tolist()], pa.int32()), pa.array([n_docs, n_terms, *df[at].tolist()], pa.int64())],
            ["term", "n"],
        )

    sums = counted.select("n", "terms").mapInArrow(add, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in sums.collect()}  # at most the terms of a block


def term_weights(found: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of each term."""
    n = found.get(N_DOCS, 0)
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(size)], np.int64)


def accumulate(plan: Plan, leaf: np.ndarray, row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Scores, items x documents, of contributions (leaf, document, value)."""
    table = np.zeros((plan.nodes, n_rows), np.int64)
    np.add.at(table, (leaf, row), value)
    for node, left, right in plan.levels:
        table[node] = table[left] + table[right]
    return np.add.reduceat(table[plan.ends], plan.begins, axis=0)


class Best:
    """The ``top`` best documents of each item among those seen."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.lists: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """Scores (items x documents) of documents in the order of their ids, null last."""
        if scores.shape[1] > self.top:
            kth = np.partition(scores, scores.shape[1] - self.top, axis=1)[:, scores.shape[1] - self.top]
            np.maximum(kth, self.floor, out=kth)
        else:
            kth = self.floor
        item, at = np.nonzero(scores >= kth[:, None])
        found = scores[item, at]
        order = np.lexsort((at, -found, item))
        item, at, found = item[order], at[order], found[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        for i, a, s in zip(item[keep].tolist(), at[keep].tolist(), found[keep].tolist(), strict=True):
            self.lists[i].append((-s, ids[a] is None, "" if ids[a] is None else ids[a]))
        for i in set(item.tolist()):
            best = self.lists[i] = sorted(self.lists[i])[: self.top]
            if len(best) == self.top:
                self.floor[i] = -best[-1][0]

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for i, best in enumerate(self.lists):
            for negative, null, doc_id in best:
                yield i, None if null else doc_id, -negative


def search_block(docs: DataFrame, plan: Plan, item_kind: str, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block."""
    context, size = docs.sparkSession.sparkContext, len(plan.terms)
    vocabulary = context.broadcast({t: i for i, t in enumerate(plan.terms)})
    counted = stage(count_terms(docs, vocabulary), "search-counts")
    found = totals(counted, size)
    shared = context.broadcast((plan, term_weights(found, size), found.get(N_DOCS, 0), max(1, found.get(N_TERMS, 0))))
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type, item_type = (arrow_type(k) for k in (doc_kind, item_kind))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, n_docs, n_terms = shared.value
        best = Best(len(plan.item_ids), top)
        step = max(1, CELLS // plan.nodes)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, tfs = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                if not len(terms):
                    continue
                sizes = pc.list_value_length(part.column(2)).to_numpy()
                row = np.repeat(np.arange(part.num_rows), sizes)
                m = 10 + 90 * part.column(1).to_numpy() * n_docs // n_terms
                value = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[row]))
                best.offer(accumulate(plan, plan.leaf[terms], row, value, part.num_rows), part.column(0).to_pylist())
        found = list(best.rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in found], pa.int32()), pa.array([plan.item_ids[i] for i, _, _ in found], item_type),
             pa.array([d for _, d, _ in found], doc_type), pa.array([s for _, _, s in found], pa.int64())],
            ["item", "item_id", "doc_id", "score"],
        )

    ranked = counted.mapInArrow(rank, f"item int, item_id {item_kind}, doc_id {doc_kind}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` best documents of each item, scores above 0."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    found = []
    for row in plans(items, block_terms).toLocalIterator():
        if found:  # all but the last one to be read are written, so that their blocks can go
            found[-1] = stage(found[-1], "search-found")
        found.append(search_block(docs, pickle.loads(bytes(row["plan"])), kind, top))
    if not found:
        doc_kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score bigint")
    return reduce(DataFrame.union, found)

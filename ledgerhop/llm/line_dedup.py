"""Line deduplication by pairwise alignment.

Every text is a row of line hashes (white space at the ends of a line aside). Its keys are runs of
lines: from every line with a word, as few lines on as hold ``block_words`` words together. So a long
line is a key by itself, and lines of verse, lists or dialogue are keys with their neighbours; such runs
are rare, only copying explains a second one, and any block of ``block_words`` words that two documents
share holds one. A document is aligned with the first document (least id) of each of its runs: so there
are as many pairs as shared runs at most, and none between two copies of a third, however many copies
there are. Patience diff aligns the two rows of hashes; runs of aligned lines of ``block_words`` words
or more are deleted from the later document.

Only hashes are compared; texts move once, to be cut.

Defined cases: null and empty texts stay as they are; rows with a null id are left alone and are
nobody's source; rows with one id are not compared with each other, and each is cut by itself;
ids are of any type with an order (numbers, strings); ties are broken by the id; a document can lose all its lines (``keep_new`` drops it then). Texts
of any length are whole. Extra columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerhop.llm.common import as_bytes, fresh, map_batches, mix64
from ledgerhop.staging import stage

BLOCK_WORDS = 8
#: An odd base for hashes of runs, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def runs(hashes: np.ndarray, sizes: np.ndarray, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """Hashes of the shortest runs of ``block_words`` words or more from every line with a word."""
    words = np.cumsum(sizes, dtype=np.int64)
    begin = np.flatnonzero(sizes)
    end = np.searchsorted(words, words[begin] - sizes[begin] + block_words) + 1
    begin, end = begin[end <= len(sizes)], end[end <= len(sizes)]
    with np.errstate(over="ignore"):
        def powers(x):
            return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(hashes), x, np.uint64))))

        # Differences of a polynomial's prefixes, moved back to the first power.
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.uint64) * powers(BASE)[:-1])))
        return mix64((prefix[end] - prefix[begin]) * powers(INVERSE)[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def line_rows(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, node, hashes, sizes, runs) of each distinct id and text; sizes are words per line."""
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), F.xxhash64(F.md5(as_bytes())).alias("node"), as_bytes()
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = ([], [], [])
        for text in batch.column(2).to_pylist():
            lines = [x.strip() for x in text.split(b"\n")]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
            sizes = np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))
            for column, values in zip(found, (hashes.view(np.int64), sizes, np.unique(runs(hashes, sizes, block_words))), strict=True):
                column.append(values)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32)), pa.array(np.concatenate(c))) for c in found
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "node", "hashes", "sizes", "runs"])

    rows = map_batches(keyed, cut, f"id {kind}, node bigint, hashes array<bigint>, sizes array<int>, runs array<bigint>")
    return rows.dropDuplicates(["id", "node"])


def first_pairs(rows: DataFrame) -> DataFrame:
    """(id, node, partner): the first documents of the runs of a document."""
    held = rows.select("id", "node", F.explode("runs").alias("run"))
    firsts = held.groupBy("run").agg(F.min("id").alias("partner"), F.max("id").alias("last")).filter("partner < last")
    return held.join(firsts.select("run", "partner"), "run").filter("partner < id").select("id", "node", "partner").distinct()


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two rows: equal beginnings and ends, then the longest rising row of lines
    that are single in both (if there are none, of lines numbered by occurrence), and so on between
    these."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        anchors = rising(single_matches(a, i, m, b, j, n) or numbered_matches(a, i, m, b, j, n))
        if not anchors:
            continue
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        out.extend(anchors)
        todo.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]))
    return sorted(out)


def single_matches(a: list[int], i: int, m: int, b: list[int], j: int, n: int) -> list[tuple[int, int]]:
    left, right = Counter(a[i:m]), Counter(b[j:n])
    at = {x: k for k, x in enumerate(b[j:n], j) if right[x] == 1}
    return [(k, at[x]) for k, x in enumerate(a[i:m], i) if left[x] == 1 and x in at]


def numbered_matches(a: list[int], i: int, m: int, b: list[int], j: int, n: int) -> list[tuple[int, int]]:
    seen: Counter = Counter()
    at = {}
    for k, x in enumerate(b[j:n], j):
        at[x, seen[x]] = k
        seen[x] += 1
    seen, out = Counter(), []
    for k, x in enumerate(a[i:m], i):
        if (x, seen[x]) in at:
            out.append((k, at[x, seen[x]]))
        seen[x] += 1
    return out


def rising(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of the matches whose second places rise (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    before = []
    for k, (_, q) in enumerate(matches):
        pile = bisect_left(tops, q)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(q)
            ends.append(k)
        else:
            tops[pile], ends[pile] = q, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(matches[k])
        k = before[k]
    return out[::-1]


def repeated_lines(a: list[int], sizes: list[int], b: list[int], block_words: int = BLOCK_WORDS) -> list[int]:
    """Lines of ``a`` in aligned blocks that are long enough."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-2, -2)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= block_words:
                out.extend(block)
            block = []
        block.append(i)
        last = (i, j)
    return out


def deletions(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, node, lines, sources): lines to delete (from 0) of each document that
    has any, and the documents that have them before."""
    rows = stage(line_rows(docs, block_words), "line-rows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    earlier = rows.select(F.col("id").alias("partner"), F.col("hashes").alias("earlier"))
    both = first_pairs(rows).join(earlier, "partner").join(rows, ["id", "node"])

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        earlier, hashes, sizes = (c.to_pylist() for c in batch.columns[3:])
        found = [repeated_lines(a, s, b, block_words) for b, a, s in zip(earlier, hashes, sizes, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["id", "node", "partner", "found"]
        ).filter(pa.array([bool(f) for f in found], pa.bool_()))

    found = map_batches(
        both.select("id", "node", "partner", "earlier", "hashes", "sizes"), align,
        f"id {kind}, node bigint, partner {kind}, found array<int>",
    )
    # At most a list of its own lines for each shared run of one document.
    return found.groupBy("id", "node").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("lines"),
        F.array_sort(F.collect_set("partner")).alias("sources"),
    )


def without_lines(docs: DataFrame, found: DataFrame, extra: list[str]) -> DataFrame:
    """``docs`` with the lines cut, the columns ``extra`` of ``found`` behind them, and the number of
    lines with a word that are left."""
    a, b, name = fresh(docs.columns, "own", "node_key", "bytes")
    keyed = docs.withColumn(a, F.col("doc_id")).withColumn(b, F.xxhash64(F.md5(as_bytes())))
    cut, *named, left_name = fresh([*docs.columns, a, b, name], "cut", *extra, "lines_left")
    marks = found.select(F.col("id").alias(a), F.col("node").alias(b), F.col("lines").alias(cut),
                         *(F.col(c).alias(n) for c, n in zip(extra, named, strict=True)))
    joined = keyed.join(marks, [a, b], "left")
    at, n_cut = docs.columns.index("text"), len(docs.columns)

    def delete(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cuts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(n_cut).to_pylist()
        left = [None] * len(texts)
        for k, (text, gone) in enumerate(zip(texts, cuts, strict=True)):
            if gone:
                drop = set(gone)
                kept = [x for i, x in enumerate(text.split(b"\n")) if i not in drop]
                texts[k] = b"\n".join(kept)
                left[k] = sum(1 for x in kept if x.strip())
        columns = [*batch.columns[:-1]]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.int64())], schema.names)

    hollow = [F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    fields = [*docs.schema, *(marks.schema[c] for c in (cut, *named)), T.StructField(left_name, T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    return map_batches(joined.select(*hollow, cut, *named, as_bytes().alias(name)), delete, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` cut: doc_id, n_deleted (lines), sources, text."""
    cut = without_lines(docs.select("doc_id", "text"), deletions(docs), ["sources"])
    deleted = F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("bigint")
    kind = cut.schema["sources"].dataType
    return cut.select(
        "doc_id", deleted.alias("n_deleted"), F.coalesce("sources", F.array().cast(kind)).alias("sources"), "text"
    )


def keep_new(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated blocks of lines cut, without the rows of which no words are left.
    Columns stay as they are."""
    cut = without_lines(docs, deletions(docs), [])
    left = F.col(f"`{cut.columns[-1]}`")
    return cut.filter(left.isNull() | (left > 0)).select(*(f"`{c}`" for c in docs.columns))

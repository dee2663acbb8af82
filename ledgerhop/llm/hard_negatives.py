"""Hard negatives by an R-tree of embeddings, packed with sort-tile-recursive tiling.

Vectors become integers (256 times the component, rounded down), so every score is an exact inner
product. The index is a table of pages: rows of one label are dealt into parts by slabs of the
coordinate that varies most and by the next one inside a slab, and each part packs its rows, tile by
tile over the following coordinates, into pages with their minimum bounding boxes. A box bounds the
inner product with a query from both sides, one interval per coordinate.

A search sends every anchor to every part (a stated query set against all rows), sorted behind the
pages of the part, so a task holds one part and one anchor at a time. Boxes wait in a queue, best bound
first. First the anchors meet the trees of their own label and keep their best ``positives``; a box
goes when its upper bound is strictly below the last one kept. Then they meet the trees of all
other labels with the score windows of their positives; a box goes when it lies outside of all
windows or strictly below the last negative kept of each. Each part sends its few best on, and a
window over the anchor ranks them.

The work is quadratic where boxes overlap, as they do in many dimensions without clusters. Nothing
grows with the data in the driver or in a task: a part holds about ``part_rows`` rows, also of equal
vectors, as the row number splits them.

Defined cases: rows with a null label or vector, or with a null or non-finite component, or one beyond
2**18 (its products could overflow), take no part. Vectors shorter than the longest one end in zeros,
empty ones are all zero. A null id is never an anchor and comes last among equal scores. Repeated rows
are rows of their own: a copy of an anchor is one of its other rows, and an anchor itself. Columns
of the input with clashing names are ignored. Where nothing qualifies there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.llm.common import map_batches
from ledgerhop.staging import stage, stage_counted

PAGE_ROWS = 256
PART_ROWS = 50_000
FANOUT = 16
#: Largest integer component: products of two, 2048 of them, still fit 64 bits.
LARGEST = 1 << 26
POINT = "row bigint, id bigint, label bigint, anchor boolean, vec binary, dim int, peak bigint"
PAGE = "part int, kind int, label bigint, seq bigint, vec binary, low binary, high binary, rows binary, ids binary, nulls binary"
ASKED = "id bigint, positives array<struct<row bigint, id bigint, score bigint>>"


def points(embeddings: DataFrame, anchor: Column, vec_id: str, vector: str, label: str) -> DataFrame:
    """Integer vectors of the rows that take part, with a number for each row."""
    given = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(anchor & F.col(vec_id).isNotNull(), F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"),
    ).filter("label is not null and vector is not null")

    def quantise(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.list_value_length(batch.column(4)).to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):  # a null component reads as nan
            x = np.floor(256 * batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float))
            wrong = ~(np.abs(x) <= LARGEST)
        of = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.bincount(of[wrong], minlength=len(sizes)) == 0
        whole = np.where(wrong, 0, x).astype("<i4")
        peaks = np.zeros(len(sizes), np.int64)
        np.maximum.at(peaks, of, np.abs(whole))
        cuts = np.cumsum([0, *sizes.tolist()]).tolist()
        vec = [whole[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        out = pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(vec, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(peaks)],
            ["row", "id", "label", "anchor", "vec", "dim", "peak"],
        )
        return out.filter(pa.array(keep))

    return map_batches(given, quantise, POINT)


def matrix(vecs: Sequence[bytes], dim: int) -> np.ndarray:
    """Vectors as rows, ended with zeros."""
    out = np.zeros((len(vecs), dim), np.int32)
    for row, v in zip(out, vecs, strict=True):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def coordinates(found: DataFrame, dim: int) -> list[int]:
    """Coordinates, those that vary most first; each task sends its sums only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), dim).astype(float)
            total += x.sum(0)
            squares += (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array(squares)], ["c", "s", "q"])

    sums = found.select("vec").mapInArrow(add, "c int, s double, q double").groupBy("c").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    rows, n = sums.collect(), max(1, found.count())
    return [r["c"] for r in sorted(rows, key=lambda r: (-round(r["q"] / n - (r["s"] / n) ** 2, 6), r["c"]))]


def tiles(x: np.ndarray, order: Sequence[int], page_rows: int) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of each page, neighbours next to each other."""

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // page_rows)
        if pages <= 1:
            return [rows]
        rows = rows[np.argsort(x[rows, order[min(depth, len(order) - 1)]], kind="stable")]
        slabs = pages if depth >= len(order) - 1 else max(2, int(np.ceil(pages ** (1 / (len(order) - depth)))))
        size = page_rows * -(-pages // slabs)
        return [page for at in range(0, len(rows), size) for page in cut(rows[at : at + size], depth + 1)]

    return cut(np.arange(len(x)), 0)


def pages(found: DataFrame, n: int, dim: int, peak: int, page_rows: int = PAGE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The index: pages of all points by part and label, written."""
    spark, kind = found.sparkSession, small_type(peak)
    order = coordinates(found, dim)
    parts = max(1, -(-n // part_rows), min(spark.sparkContext.defaultParallelism, n // page_rows))
    slabs = int(np.ceil(parts**0.5))
    first, second = order[0], order[min(1, dim - 1)]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column(3).to_pylist(), dim)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, first]), pa.array(x[:, second])], ["row", "id", "label", "vec", "a", "b"])

    placed = stage(map_batches(found.select("row", "id", "label", "vec"), place, "row bigint, id bigint, label bigint, vec binary, a int, b int"), "negatives-placed")
    cuts = []
    if slabs > 1:
        shares = [i / slabs for i in range(1, slabs)]
        cuts = sorted(set(placed.select(F.percentile_approx("a", shares, 10_000).alias("cuts")).first()["cuts"]))
    slab = sum((F.when(F.col("a") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = placed.withColumn("slab", slab).repartitionByRange(parts, "label", "slab", "b", "row").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        for label in sorted(rows.column("label").unique().to_pylist()) if rows else []:
            own = rows.filter(pc.equal(rows.column("label"), label))
            x = matrix(own.column("vec").to_pylist(), dim).astype(kind)
            number = own.column("row").to_numpy()
            null = pc.is_null(own.column("id")).to_numpy().astype(np.uint8)
            ids = pc.fill_null(own.column("id"), 0).to_numpy()
            part = own.column("part")[0].as_py()
            out = []
            for seq, page in enumerate(tiles(x, order, page_rows)):
                v = x[page]
                out.append((part, 0, label, seq, v.tobytes(), v.min(0).tobytes(), v.max(0).tobytes(), number[page].tobytes(), ids[page].tobytes(), null[page].tobytes()))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], [f.split()[0] for f in PAGE.split(", ")])

    return stage(dealt.select("row", "id", "label", "vec", "part").mapInArrow(pack, PAGE), "negatives-pages")


def small_type(peak: int) -> str:
    return "<i2" if peak < 1 << 15 else "<i4"


class Forest:
    """R-trees of one part: boxes of all levels, the rows of the pages, and the root of each label."""

    def __init__(self, found: list[dict], dim: int, peak: int):
        stored = small_type(peak)
        # Products of up to dim pairs are exact in doubles, which are faster, below 2**53.
        self.kind = np.float64 if dim * peak * peak < 1 << 53 else np.int64
        read = lambda name, t: [np.frombuffer(p[name], t) for p in found]
        self.rows, self.ids, self.nulls = (np.concatenate(read(c, t)) for c, t in (("rows", np.int64), ("ids", np.int64), ("nulls", np.uint8)))
        self.vectors = np.concatenate(read("vec", stored)).reshape(-1, dim).astype(self.kind)
        low, high = (np.stack(read(c, stored)).astype(self.kind) for c in ("low", "high"))
        ends = np.cumsum([len(p["rows"]) // 8 for p in found])
        begin, end = [np.concatenate([[0], ends[:-1]])], [ends]
        leaf = [np.ones(len(found), bool)]
        lows, highs = [low], [high]
        labels = np.array([p["label"] for p in found])
        self.roots: dict[int, int] = {}
        nodes = len(found)
        for label in np.unique(labels).tolist():
            level = np.flatnonzero(labels == label)
            at, box_low, box_high = int(level[0]), low[level], high[level]
            while len(box_low) > 1:
                starts = np.arange(0, len(box_low), FANOUT)
                begin.append(at + starts)
                end.append(at + np.minimum(starts + FANOUT, len(box_low)))
                leaf.append(np.zeros(len(starts), bool))
                box_low, box_high = np.minimum.reduceat(box_low, starts), np.maximum.reduceat(box_high, starts)
                lows.append(box_low)
                highs.append(box_high)
                at, nodes = nodes, nodes + len(starts)
            self.roots[label] = at
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.begin, self.end, self.leaf = np.concatenate(begin).tolist(), np.concatenate(end).tolist(), np.concatenate(leaf).tolist()

    def search(self, query: np.ndarray, own: int, roots: list[int], windows: list[tuple[int, int | None]], k: int) -> list[list[tuple]]:
        """For each window of scores (least, most or None) the first ``k`` rows but ``own``: (-score, null, id, row)."""
        query = query.astype(self.kind)
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        best: list[list[tuple]] = [[] for _ in windows]
        far = np.array([np.inf if most is None else most for _, most in windows])
        least = np.array([low for low, _ in windows], float)  # of each window, or the last row kept, if higher

        def push(at: int, to: int) -> None:
            upper = self.high[at:to] @ plus + self.low[at:to] @ minus
            lower = self.low[at:to] @ plus + self.high[at:to] @ minus
            needed = (upper[:, None] >= least) & (lower[:, None] <= far)
            value = np.where(needed, np.minimum(upper[:, None], far), -np.inf).max(1)
            for i in np.flatnonzero(needed.any(1)).tolist():
                heapq.heappush(queue, (-value[i], at + i, upper[i], lower[i]))

        queue: list[tuple] = []
        for root in roots:
            push(root, root + 1)
        while queue:
            _, node, upper, lower = heapq.heappop(queue)
            if not ((upper >= least) & (lower <= far)).any():
                continue
            at, to = self.begin[node], self.end[node]
            if not self.leaf[node]:
                push(at, to)
                continue
            scores = self.vectors[at:to] @ query
            for w in range(len(windows)):
                fits = at + np.flatnonzero((scores >= least[w]) & (scores <= far[w]))
                fits = fits[self.rows[fits] != own]
                if not len(fits):
                    continue
                found = scores[fits - at]
                fits = fits[np.lexsort((self.rows[fits], self.ids[fits], self.nulls[fits], -found))[:k]]
                new = zip((-scores[fits - at]).tolist(), self.nulls[fits].tolist(), self.ids[fits].tolist(), self.rows[fits].tolist(), strict=True)
                best[w] = sorted([*best[w], *new])[:k]
                if len(best[w]) == k:
                    least[w] = max(least[w], -best[w][-1][0])
        return best


def least_score(dim: int, peak: int) -> int:
    return -dim * peak * peak - 1


def searched(index: DataFrame, asked: DataFrame, dim: int, peak: int, k: int, negatives: bool, low: int = 0, high: int = 0) -> DataFrame:
    """Sends each asked row (row, id, label, vec, positives) to every part; the best ``k`` of each part and
    window as (row, id, positive, found)."""
    parts = index.agg(F.max("part")).first()[0]
    last = -1 if parts is None else parts
    blank = lambda name, t: F.lit(None).cast(t).alias(name)
    trees = index.select("*", blank("id", "bigint"), blank("positives", "array<struct<row:bigint,id:bigint,score:bigint>>"))
    sent = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(0, last)))).alias("part"), F.lit(1).alias("kind"), "label", F.col("row").alias("seq"), "vec",
        *[blank(c, "binary") for c in ("low", "high", "rows", "ids", "nulls")], "id", "positives",
    )
    dealt = trees.unionByName(sent).repartition(max(1, last + 1), "part").sortWithinPartitions("part", "kind", "label", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, forest = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, held, forest = r["part"], [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if forest is None and held:
                    forest, held = Forest(held, dim, peak), []
                if forest is None:
                    continue
                query = matrix([r["vec"]], dim)[0]
                if negatives:
                    roots = [n for label, n in forest.roots.items() if label != r["label"]]
                    windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in r["positives"]]
                else:
                    roots = [n for label, n in forest.roots.items() if label == r["label"]]
                    windows = [(least_score(dim, peak), None)]
                use = [w for w, (a, b) in enumerate(windows) if b is None or a <= b]
                for w, best in zip(use, forest.search(query, r["seq"], roots, [windows[w] for w in use], k), strict=True):
                    p = r["positives"][w] if negatives else {"row": None, "id": None, "score": None}
                    out += [(r["seq"], r["id"], p["row"], p["id"], p["score"], b[3], None if b[1] else b[2], int(-b[0])) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in range(8)],
                ["row", "id", "p_row", "p_id", "p_score", "f_row", "f_id", "f_score"],
            )

    return dealt.mapInArrow(run, "row bigint, id bigint, p_row bigint, p_id bigint, p_score bigint, f_row bigint, f_id bigint, f_score bigint")


def first_found(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("f_score"), F.asc_nulls_last("f_id"), "f_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         page_rows: int = PAGE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row with ``anchor``
    and each of its best ``positives`` of the same label, the best ``negatives`` of other labels that
    score between ``low`` and ``high`` hundredths of the positive."""
    found, n = stage_counted(points(embeddings, anchor, vec_id, vector, label), "negatives-points")
    size = found.agg(F.max("dim").alias("dim"), F.max("peak").alias("peak")).first()
    dim, peak = max(1, size["dim"] or 0), max(1, size["peak"] or 0)
    index = pages(found, n, dim, peak, page_rows, part_rows)
    anchors = found.filter("anchor").select("row", "id", "label", "vec")
    none = F.array().cast("array<struct<row:bigint,id:bigint,score:bigint>>")
    near = first_found(searched(index, anchors.withColumn("positives", none), dim, peak, positives, False), ["row"], positives)
    best = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("f_row").alias("row"), F.col("f_id").alias("id"), F.col("f_score").alias("score")))).alias("positives"))
    asked = stage(anchors.join(best, "row"), "negatives-asked")
    far = first_found(searched(index, asked, dim, peak, negatives, True, low, high), ["row", "p_row"], negatives)
    return far.select(
        F.col("id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("f_id").alias("negative_id"),
        F.col("p_score").alias("positive_score"), F.col("f_score").alias("negative_score"),
    )

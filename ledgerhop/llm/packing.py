"""Best-fit packing with exact complements.

Only the number of pieces of each length matters for a plan, so the pieces are counted by length
(at most ``capacity`` rows, whatever the input), a plan over these counts is made once, and each
piece finds its place by its rank among the pieces of its length. Per sequence the plan takes the
longest length left and asks an index of the sums of single lengths, pairs and triples, with their counts,
for what fills the gap exactly; if nothing does, the longest that fits goes in and the search goes on. A
pattern is used as often as the counts allow, so there are at most a few patterns per length.

Defined cases: a null text is empty and gives one piece of the end token; repeated rows are packed
as separate pieces; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.llm.common import as_bytes, map_batches, word_tokens
from ledgerhop.llm.token_counts import WORD_BPE
from ledgerhop.staging import stage

CAPACITY = 4096
END = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SLOTS = ("length bigint, from_rank bigint, to_rank bigint, uses bigint, first_sequence bigint, "
         "first_offset bigint")  # fmt: skip
#: Pieces of one length and bucket are ranked together.
BUCKET_ROWS = 100_000


def cut_pieces(docs: DataFrame, vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, the end id included."""
    width, tail = 4 * capacity, np.asarray([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, piece, length, crc = [], [], [], []
        for row, ids in enumerate(word_tokens(vocabulary).ids(batch.column(1).to_pylist())):
            ids += tail
            for k, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                of.append(row)
                piece.append(k)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        numbers = np.asarray(piece, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of, pa.int64())), pa.array(numbers.astype(np.int32)),
             pa.array(numbers * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(docs.select("doc_id", as_bytes()), cut, PIECES.replace("bigint", kind, 1))


class SumIndex:
    """Which one, two or three lengths of the pieces left add up to a sum.

    ``left`` holds the counts of pieces by length. Counts only fall, so what has run out never comes back: for
    every sum that was asked for, a cursor stands at the longest first part that may still fill it and never
    goes up again, and lengths without pieces are skipped by links. ``used`` are pieces that a pattern in the
    making holds; they are spoken for, not gone, so no cursor moves because of them.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.links = list(range(len(left)))
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def longest(self, most: int) -> int:
        """The longest length with pieces left, at most ``most``; 0 if there is none."""
        at = min(most, len(self.left) - 1)
        path = []
        while at > 0 and not self.left[at]:
            path.append(at)
            at = self.links[at] if self.links[at] < at else at - 1
        for x in path:
            self.links[x] = at
        return max(at, 0)

    def fits(self, parts: list[int], used: Counter) -> bool:
        need = Counter(parts)
        return all(self.left[x] - used[x] >= n for x, n in need.items())

    def pair(self, total: int, used: Counter, most: int) -> list[int]:
        """Two lengths, none above ``most``, the longest first; none if no two are left."""
        at = self.longest(self.pairs.get(total, total - 1))
        while at and 2 * at >= total and not self.fits([at, total - at], Counter()):
            at = self.longest(at - 1)
        self.pairs[total] = at
        at = self.longest(min(at, most))
        while at and 2 * at >= total:
            if self.fits([at, total - at], used):
                return [at, total - at]
            at = self.longest(at - 1)
        return []

    def triple(self, total: int, used: Counter) -> list[int]:
        at = self.longest(self.triples.get(total, total - 2))
        dead = True
        while at and 3 * at >= total:
            found = self.pair(total - at, used + Counter([at]), at) if self.fits([at], used) else []
            if found:
                return [at, *found]
            dead = dead and not (self.fits([at], Counter()) and self.pair(total - at, Counter([at]), at))
            at = self.longest(at - 1)
            if dead:
                self.triples[total] = at
        return []

    def fill(self, gap: int, used: Counter) -> list[int]:
        """Lengths filling ``gap`` exactly: one, else two, else three; else none."""
        if gap < len(self.left) and self.fits([gap], used):
            return [gap]
        return self.pair(gap, used, len(self.left) - 1) or self.triple(gap, used)

    def best(self, gap: int, used: Counter) -> list[int]:
        """The longest piece that goes into ``gap``."""
        at = self.longest(gap)
        while at and not self.fits([at], used):
            at = self.longest(at - 1)
        return [at] if at else []


def fill_gap(left: np.ndarray, gap: int) -> list[int]:
    """What fills a gap exactly with pieces of these counts."""
    return SumIndex([int(n) for n in left]).fill(gap, Counter())


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, from_rank, to_rank, uses, first_sequence, first_offset): the pieces of that
    length with ranks in [from, to) go to sequences first_sequence + (rank - from) // uses, each
    taking ``uses`` of them one after another from ``first_offset``."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    index, rank = SumIndex(left), [0] * (capacity + 1)
    slots, sequence = [], 0
    for longest in range(capacity, 0, -1):
        while left[longest]:
            used, gap = Counter([longest]), capacity - longest
            while gap:
                more = index.fill(gap, used) or index.best(gap, used)
                if not more:
                    break
                used.update(more)
                gap -= sum(more)
            times = min(left[length] // n for length, n in used.items())
            offset = 0
            for length, n in sorted(used.items()):
                left[length] -= times * n
                first = rank[length]
                slots.append((length, first, first + times * n, n, sequence, offset))
                rank[length] = first + times * n
                offset += length * n
            sequence += times
    return slots


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, vocabulary, capacity, end), "pieces")
    by_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(packing_plan(by_length, capacity), SLOTS)

    # Ranks within a length without gathering a common length: rank in a bucket, plus the pieces
    # of the buckets before it.
    buckets = 8 + sum(by_length.values()) // BUCKET_ROWS
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = bucketed.withColumn("nth", F.row_number().over(in_bucket) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "bucket")
    # At most a few slots per length of the plan, whatever the input: safe to broadcast.
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (
        F.col("rank") < F.col("to_rank")
    )
    nth = F.col("rank") - F.col("from_rank")
    return ranked.join(s, inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("uses"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("uses") * F.col("length")).cast("bigint").alias("offset"),
    )

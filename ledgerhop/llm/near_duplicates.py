"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (words lower-cased A-Z; a shorter text is one
shingle). The weight of a shingle is its count in the text times the mean inverse document frequency
of its words: document frequencies are counted over all documents for words, whose number is far
smaller than that of shingles. A word counts as in ``rare_share`` of the documents at least, so its weight
follows from its share of the documents and from nothing else, at every size of the corpus. Only words
above that share are broadcast with their frequency: no more than the mean number of different words of
a document divided by the share, whatever the number of documents.

Improved consistent weighted sampling draws (shingle, level) pairs that two texts share with the
probability of their weighted Jaccard similarity. Draws are grouped in bands. Rows with the same text
are one node. Within a bucket of a band every node is compared with the least one, by the exact
weighted Jaccard similarity of the whole texts; all nodes of a bucket where somebody was unlike it are
compared again with the least node of each finer bucket, of two bands together. These links make classes,
and in the buckets that still hold several of them every pair of nodes of two classes is decided by the same
exact similarity, block against block through an inverted index. So each pair that shares a bucket is
either verified or in one class already; what can be missed are pairs that share none (of a pair at
0.8, 1 - (1 - 0.8^3)^8 = 99.7 % share one).

Defined cases: ids are integers, or text of integers (any other text is an error); null texts and texts
without words are classes of their own; rows with the same text
and id are one class like other copies; a null id belongs to a class but never names it unless
nothing else can (the class is then null); an empty table gives no rows. Extra columns are ignored,
and kept by ``keep_first``. Node numbers are 64-bit hashes of the texts' MD5 digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.llm.common import LOWER, as_bytes, fresh, map_batches, mix64
from ledgerhop.llm.links import classes
from ledgerhop.staging import stage, stage_counted

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
#: Distances of the two bands that make a finer bucket.
FINE_STEPS = (1, 2)
#: Nodes of a block that is compared as a whole, and the weight of their shingles that starts another one.
BLOCK_NODES, BLOCK_WEIGHT = 256, 1e7
#: Words in fewer documents than this share weigh the same.
RARE_SHARE = 1 / 2000
#: Sizes of the table of random numbers that all draws share, and of a task's word counts.
TABLE_BITS = 16
CHUNK_WORDS = 1_000_000
WORD_FACTORS = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)
NO_ID = -(1 << 63)


def lower_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class WordWeights:
    """Sorted hashes of the frequent words with their weight; ``rare`` is the weight of all others."""

    head: np.ndarray
    weights: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.full(len(hashes), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.weights[at], np.float32(self.rare))


def word_weights(docs: DataFrame, rare_share: float = RARE_SHARE) -> WordWeights:
    """Inverse document frequencies, log((1 + N) / (1 + df)) + 0.1, over all of ``docs(text)``; df is 1 and
    ``rare_share`` of N at least."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in set(lower_words(text)):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= CHUNK_WORDS:
                    yield from counted(counts, 0)
                    counts = {}
        yield from counted(counts, n)

    def counted(counts: dict[bytes, int], n: int) -> Iterator[pa.RecordBatch]:
        keys, values = hashed(list(counts)).view(np.int64), np.fromiter(counts.values(), np.int64, len(counts))
        for at in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 200_000]), pa.array(values[at : at + 200_000])], ["word", "df"]
            )
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["word", "df"])

    found = docs.select(as_bytes()).mapInArrow(partial, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    found = stage(found.filter("word is null or df > 1"), "word-frequencies")
    total = found.filter("word is null").agg(F.max("df")).first()[0] or 0
    words = found.filter("word is not null")
    least = max(1.0, rare_share * total)
    head = words.filter(F.col("df") > least).toArrow()
    keys = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    df = head.column("df").to_numpy()[order]
    weight = np.log((1 + total) / (1 + df)) + 0.1
    return WordWeights(keys[order], weight.astype(np.float32), float(np.log((1 + total) / (1 + least)) + 0.1))


def shingles(text: bytes | None, weights: WordWeights) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text with their weights."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    h = hashed(words)
    return weighted_shingles(h, weights.of(h))


def weighted_shingles(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingles`, from the hashes of the words and their weights."""
    k = min(SHINGLE_WORDS, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    mean = np.zeros(n, np.float32)
    with np.errstate(over="ignore"):
        for i in range(k):
            s += h[i : i + n] * WORD_FACTORS[i]
            mean += w[i : i + n]
    keys, first, counts = np.unique(mix64(s), return_index=True, return_counts=True)
    return keys, counts.astype(np.float32) * mean[first] / np.float32(k)


class WeightedSampler:
    """Improved consistent weighted sampling: (shingle, level) draws of a weighted set."""

    def __init__(self, draws: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << TABLE_BITS
        # Per place of the table: r and log c from Gamma(2, 1), beta from U(0, 1).
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32) - self.r
        self.beta = rng.random(size).astype(np.float32)
        self.factor = rng.integers(0, 1 << 32, draws, np.uint64)[:, None].astype(np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, draws, np.uint64)[:, None].astype(np.uint32)

    def draw(self, keys: np.ndarray, weights: np.ndarray, width: int = 8192) -> np.ndarray:
        """One number for each draw; the shingles are taken ``width`` at a time."""
        best = level = None
        chosen = np.zeros(len(self.factor), np.int64)
        for at in range(0, len(keys), width):
            low = (keys[at : at + width] >> np.uint64(20)).astype(np.uint32)
            log_w = np.log(weights[at : at + width])
            with np.errstate(over="ignore"):
                place = (low * self.factor + self.shift) >> np.uint32(32 - TABLE_BITS)
            t = np.floor(log_w * self.inverse[place] + self.beta[place])
            a = self.log_c[place] - self.r[place] * (t - self.beta[place])
            arg = a.argmin(1)
            rows = np.arange(len(a))
            if best is None:
                best, chosen, level = a[rows, arg], arg, t[rows, arg]
            else:
                better = a[rows, arg] < best
                best = np.where(better, a[rows, arg], best)
                chosen = np.where(better, arg + at, chosen)
                level = np.where(better, t[rows, arg], level)
        return mix64(keys[chosen] ^ mix64(level.astype(np.int64).view(np.uint64)))


def band_keys(draws: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band of ``rows`` draws."""
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mix64(out ^ draws[i::rows])
    return out.view(np.int64)


def node_of(text: str = "text") -> Column:
    return F.xxhash64(F.md5(F.col(text).cast("binary")))


def own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def signatures(docs: DataFrame, weights, bands: int, rows: int) -> DataFrame:
    """(id, node, weight, keys) of every row: total weight of its shingles and a key for each band;
    keys is empty for a text without words."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sampler, keys, sizes, total = WeightedSampler(bands * rows), [], [], []
        texts = [lower_words(t) for t in batch.column(2).to_pylist()]
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            index: dict[bytes, int] = {}
            ids = [index.setdefault(w, len(index)) for words in part for w in words]
            h = hashed(list(index))
            w = weights.value.of(h)[ids] if ids else np.zeros(0, np.float32)
            h, begin = h[ids] if ids else h, 0
            for words in part:
                end = begin + len(words)
                if words:
                    weighted = weighted_shingles(h[begin:end], w[begin:end])
                    keys.append(band_keys(sampler.draw(*weighted), bands, rows))
                sizes.append(bands if words else 0)
                total.append(float(weighted[1].sum(dtype=np.float64)) if words else 0.0)
                begin = end
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(total, pa.float64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "node", "weight", "keys"]
        )

    columns = docs.select(own_id().alias("id"), node_of().alias("node"), as_bytes())
    return map_batches(columns, sign, "id bigint, node bigint, weight double, keys array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose texts are similar enough, by exact comparison."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            _, b, own, other = (c.to_pylist() for c in batch.columns)
            similar = []
            for node, text, text_b in zip(b, own, other, strict=True):
                if node != hub:
                    hub, hub_set = node, shingles(text_b, weights.value)
                similar.append(weighted_jaccard(shingles(text, weights.value), hub_set) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("own")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return both.select("a", "b", "own", "other").mapInArrow(compare, "a bigint, b bigint")


def against_first(members: DataFrame, similarity: float) -> DataFrame:
    """Every node of a bucket with the least node of it, which is its hub.

    Weighted Jaccard similarity is never over the quotient of the total weights; ``possible`` tells
    the pairs that may be similar.
    """
    bucket = ["band", "key"]
    hubs = members.groupBy(*bucket).agg(
        F.min("node").alias("hub"), F.min_by("id", "node").alias("hub_id"),
        F.min_by("weight", "node").alias("hub_weight"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 1").drop("n")
    possible = F.least("weight", "hub_weight") >= F.greatest("weight", "hub_weight") * (similarity - 1e-6)
    return members.join(hubs, bucket).filter("node != hub").withColumn("possible", possible)


def linked_classes(nodes: DataFrame, docs: DataFrame, weights, similarity: float, bands: int) -> DataFrame:
    """(node, root) of every linked node of ``nodes(node, id, weight, keys)``.

    First every node is compared with the hub of each of its buckets. Nodes of a bucket in which
    somebody was not like the hub are then compared with the hubs of finer buckets, those of two
    bands together: hardly anybody shares such a bucket without being similar. The pairs of a bucket
    that are in different classes after that are all compared.
    """
    narrow = ["node", "id", "weight"]
    coarse = against_first(nodes.select(*narrow, F.posexplode("keys").alias("band", "key")), similarity)
    against = stage(coarse, "members")
    texts = stage(candidate_texts(against, docs), "texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.filter("possible").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        return stage(verified(wanted, texts, weights, similarity), "found")

    links = links_of(against)
    mixed = against.join(links.toDF("node", "hub"), ["node", "hub"], "left_anti").select("band", "key").distinct()
    inside = against.join(mixed, ["band", "key"], "left_semi")
    open_nodes, left = stage_counted(
        nodes.join(inside.select("node").union(inside.select("hub")).distinct(), "node", "left_semi"), "open"
    )
    for step in FINE_STEPS if left else ():
        both = F.transform("keys", lambda key, i: F.xxhash64(key, F.get("keys", (i + step) % bands), F.lit(step)))
        fine = against_first(open_nodes.select(*narrow, F.posexplode(both).alias("band", "key")), similarity)
        seen = links.toDF("node", "hub")
        links = links.unionByName(links_of(fine.join(seen, ["node", "hub"], "left_anti")))
    roots = classes(links)
    if not left:
        return roots
    roots = stage(roots, "roots")
    places = blocks(open_nodes.select(*narrow, F.posexplode("keys").alias("band", "key")).join(roots, "node", "left"))
    more, left = stage_counted(between_classes(places, texts, weights, similarity).distinct(), "between")
    if not left:
        return roots
    merged = classes(more).toDF("root", "least")
    known = roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    single = merged.join(roots, merged.root == roots.node, "left_anti").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return known.unionByName(single)


def blocks(members: DataFrame) -> DataFrame:
    """(band, key, i, j, side, node, root) of ``members(band, key, node, weight, root)``: every node once for
    each two blocks of its bucket that are compared, with its own block's side.

    The nodes of the bucket's largest class (side 1) are not compared with each other, all others (side 0)
    also among themselves. A bucket of two has been decided with its hub, and one of a single class needs
    nothing.
    """
    bucket = ["band", "key"]
    members = stage(members.withColumn("root", F.coalesce("root", "node")), "open-members")
    sizes = members.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    n_blocks = lambda n, weight: F.ceil(F.greatest(n / BLOCK_NODES, weight / BLOCK_WEIGHT))
    found = sizes.groupBy(*bucket).agg(
        F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("roots"),
        F.max(F.struct("n", "weight", "root")).alias("top"),
    ).filter("n > 2 and roots > 1").select(
        *bucket, F.col("top.root").alias("top"), n_blocks(F.col("top.n"), F.col("top.weight")).alias("large"),
        n_blocks(F.col("n") - F.col("top.n"), F.col("weight") - F.col("top.weight")).alias("others"),
    )
    side = (F.col("root") == F.col("top")).cast("int")
    placed = members.join(found, bucket).withColumn("side", side).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("side") == 1, F.col("large")).otherwise(F.col("others")))
    )
    # Blocks of the others are numbered from 0, those of the large class on from there.
    behind = F.sequence(F.col("own"), F.col("others") + F.col("large") - 1).cast("array<bigint>")
    before = F.sequence(F.lit(0).cast("bigint"), F.col("own"))
    others = placed.filter("side = 0")
    first = others.select(*bucket, F.col("own").alias("i"), F.explode(behind).alias("j"), F.lit(0).alias("side"), "node", "root")
    second = others.filter("own > 0").select(
        *bucket, F.explode(before).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "root"
    ).filter("i < j")
    large = placed.filter("side = 1").select(
        *bucket, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("i"),
        (F.col("others") + F.col("own")).alias("j"), F.lit(1).alias("side"), "node", "root",
    )
    return first.unionByName(second).unionByName(large)


class Block:
    """Shingle sets with an inverted index: exact weighted Jaccard similarity with all of them at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets = sets
        owners = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
        keys, values = (np.concatenate(c) for c in zip(*sets, strict=True))
        order = np.argsort(keys, kind="stable")
        self.owners, self.values = owners[order], values[order]
        self.keys, self.start = np.unique(keys[order], return_index=True)
        self.end = np.append(self.start[1:], len(keys))
        self.totals = np.asarray([w.sum(dtype=np.float64) for _, w in sets])

    def similar(self, one: tuple[np.ndarray, np.ndarray], similarity: float, near: float = 1e-6) -> list[int]:
        """Numbers of the sets that are similar to ``one``."""
        keys, values = one
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        at, values = at[hit], values[hit]
        n = self.end[at] - self.start[at]
        places = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        least = np.minimum(np.repeat(values, n), self.values[places])
        shared = np.bincount(self.owners[places], least, len(self.sets))
        union = self.totals + one[1].sum(dtype=np.float64) - shared
        likely = np.flatnonzero(shared >= (similarity - near) * union).tolist()
        # The sums above are in another order: close to the limit the plain comparison decides.
        return [i for i in likely if shared[i] > (similarity + near) * union[i] or weighted_jaccard(one, self.sets[i]) >= similarity]


def between_classes(places: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """(a, b): roots of classes that a similar pair of nodes of ``places`` links."""
    unit = ["band", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, waiting, to = None, None, [], {}

        def top(root: int) -> int:
            while root in to:
                root = to[root]
            return root

        def link(root: int, one: tuple[np.ndarray, np.ndarray], block: Block, roots: list[int]) -> Iterator[tuple[int, int]]:
            for k in block.similar(one, similarity):
                a, b = sorted((top(root), top(roots[k])))
                if a != b:
                    to[b] = a
                    yield a, b

        def among() -> Iterator[tuple[int, int]]:
            """Links within the first block, which is compared with itself."""
            roots = [r for r, _ in waiting]
            whole = Block([s for _, s in waiting])
            for root, one in waiting:
                yield from link(root, one, whole, roots)

        for batch in batches:
            *key, side, root, text = (c.to_pylist() for c in batch.columns)
            found: list[tuple[int, int]] = []
            for own, second, r, t in zip(zip(*key, strict=True), side, root, text, strict=True):
                if own != now:
                    if now is not None and now[2] == now[3]:
                        found.extend(among())
                    now, block, waiting, to = own, None, [], {}
                one = shingles(t, weights.value)
                if not second:
                    waiting.append((r, one))
                elif waiting:
                    if block is None:
                        block, roots = Block([s for _, s in waiting]), [r for r, _ in waiting]
                    found.extend(link(r, one, block, roots))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
        if now is not None and now[2] == now[3] and (found := list(among())):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = places.join(texts, "node").select(*unit, "side", "root", "text")
    sorted_rows = rows.repartition(*unit).sortWithinPartitions(*unit, "side")
    return sorted_rows.mapInArrow(compare, "a bigint, b bigint")


def candidate_texts(against: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of every node in a pair, from the row of its least id."""
    nodes = against.select("node", F.col("id").alias("own_id")).union(against.select("hub", "hub_id")).distinct()
    texts = docs.select(node_of().alias("node"), own_id().alias("own_id"), as_bytes())
    # Repeated rows of the same id and text pass more than once: one of them is enough.
    return texts.join(nodes, ["node", "own_id"], "left_semi").dropDuplicates(["node"]).drop("own_id")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                           rare_share: float = RARE_SHARE) -> tuple[DataFrame, DataFrame]:
    """(id, node, root) of every row, and (root, class_id, class_size) of every class."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(word_weights(docs, rare_share))
    signed = stage(signatures(docs, weights, bands, rows), "signatures")
    nodes = signed.filter(F.size("keys") > 0).groupBy("node").agg(
        F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("keys").alias("keys")
    )
    roots = linked_classes(stage(nodes, "nodes"), docs, weights, similarity, bands)
    placed = stage(
        signed.select("id", "node", (F.size("keys") == 0).alias("alone")).join(roots, "node", "left").select(
            "id", "node", "alone", F.when(~F.col("alone"), F.coalesce("root", "node")).alias("root"),
        ),
        "placed",
    )
    found = placed.filter("not alone").groupBy("root").agg(
        F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("class_id"),
        F.count(F.lit(1)).alias("class_size"),
    )
    return placed, found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size, keep (the row's id names its class)."""
    placed, found = near_duplicate_classes(docs, similarity)
    alone = placed.filter("alone").select("id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    grouped = placed.filter("not alone").join(found, "root").select("id", "class_id", "class_size")
    named = F.nullif(F.col("id"), F.lit(NO_ID))
    return alone.unionByName(grouped).select(
        named.alias("doc_id"), F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), "class_size",
        F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("keep"),
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``docs``: of the least id that names it. Columns stay as they are."""
    placed, found = near_duplicate_classes(docs, similarity)
    # Per class the least (id, node): two texts of one id may be in it.
    rows = placed.filter("not alone").groupBy("root", "id", "node").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id") == NO_ID, "id", "node")).alias("m"))
    first = first.select("root", F.col("m.id").alias("id"), F.col("m.node").alias("node"))
    wanted = rows.join(first, ["root", "id", "node"], "left_semi").select("id", "node", "n")
    a, b, c = fresh(docs.columns, "own", "node_key", "copies")
    marked = docs.withColumn(a, own_id()).withColumn(b, node_of())
    kept = marked.join(wanted.toDF(a, b, c), [a, b])
    once = kept.filter(F.col(c) == 1)
    repeated = kept.filter(F.col(c) > 1).dropDuplicates([a, b])
    wordless = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(repeated).select(*docs.columns).unionByName(wordless)

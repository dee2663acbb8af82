"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every whole text. Only the number of documents of
each pattern of votes matters to the label model, and there are at most 3 ** labellers patterns: these
counts, over all documents, go through expectation-maximisation, which estimates how often each
labeller gives each vote to good and to bad texts, and so the probability that a pattern is good.
A hashed linear scorer is then fitted to these posterior labels on at most ``fit_rows`` distinct texts
(chosen by the hash of the text, the same number with good and with bad posterior as far as they go),
and scores every whole text by its byte n-grams.

A second label model of the same kind finds toxic texts. Its labellers look for words, and for
beginnings of words, that mark texts labelled toxic; these lists have at most ``lexicon`` entries,
learned on at most ``lexicon_rows`` labelled texts.

Defined cases: a null text is empty; an empty text has the votes of a text without words; without
toxic labels nothing is toxic; with one pattern only its majority decides; repeated rows each get a
result; rows with a null id are judged, and are not used for the word lists. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.llm.common import as_bytes, lowest_keys, map_batches
from ledgerhop.llm.decontamination import words_of
from ledgerhop.staging import stage

FIT_ROWS = 3000
FEATURES = 4096
LEXICON, LEXICON_ROWS = 400, 8000
PREFIX = 5
GOOD, BAD, NOTHING = 2, 1, 0
SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(65, 91))
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
PIECE = 1 << 20


def vote(value: float, bad_from: float, good_to: float) -> int:
    """Bad from one limit on, good up to another, nothing between."""
    return BAD if value >= bad_from else GOOD if value <= good_to else NOTHING


def quality_votes(text: bytes) -> tuple[int, ...]:
    """Signs, capitals, tables and repetition, each seen by two or three labellers."""
    words = text.split()
    n = max(1, len(words))
    chars = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = (len(text) - len(text.translate(None, SYMBOLS))) / n
    signs = (len(text) - len(text.translate(None, SIGNS))) / chars
    upper = (len(text) - len(text.translate(None, UPPER))) / chars
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    long = len(words) >= 30
    return (
        vote(symbols, 0.15, 0.02),
        vote(signs, 0.1, 0.05),
        vote(upper, 0.3, 0.1),
        vote((text.count(b"!") + text.count(b"?")) / n, 0.2, 0.03),
        vote(text.count(b"|") / n, 0.1, 0.0),
        vote(1 - len(set(words)) / n, 0.8, 0.6) if long else NOTHING,
        vote(1 - pairs, 0.5, 0.3) if long else NOTHING,
        vote(chars / len(zlib.compress(text, 1)), 6, 4) if long else NOTHING,
        vote(1 - len(set(lines)) / max(1, len(lines)), 0.3, 0.05),
    )


def toxic_votes(text: bytes, lexicon: tuple[frozenset, frozenset]) -> tuple[int, ...]:
    """BAD stands for toxic."""
    words = words_of(text)
    exact = [w for w in words if w in lexicon[0]]
    begun = [w for w in words if w[:PREFIX] in lexicon[1]]
    hits = max(len(exact), len(begun))
    return (
        BAD if len(set(exact)) >= 2 else GOOD if not exact else NOTHING,
        BAD if len(set(begun)) >= 2 else GOOD if not begun else NOTHING,
        vote(hits / max(1, len(words)), 0.008, 0.0) if hits > 1 or not hits else NOTHING,
    )


def pattern(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


def unpacked(number: int, width: int) -> list[int]:
    out = []
    for _ in range(width):
        out.append(number % 3)
        number //= 3
    return out[::-1]


def label_model(counts: dict[int, int], width: int, rounds: int = 500, strength: float = 10.0) -> dict[int, float]:
    """Probability that each pattern is of the class GOOD, by expectation-maximisation.

    A labeller that says nothing tells nothing. The first guess is that a text with a bad vote is
    bad; a belief worth ``strength`` texts of each class, that labellers rarely call good texts bad,
    keeps the classes from changing places in small data and fades as the texts grow in number.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    votes = np.asarray([unpacked(k, width) for k in keys])
    n = np.asarray([counts[k] for k in keys], float)
    q = np.where((votes == BAD).any(1), 0.1, 0.9)
    belief = np.asarray([[0.6, 0.4], [0.98, 0.02]]) * strength  # bad and good texts; good, bad votes
    for _ in range(rounds):
        weight = np.stack([(1 - q) * n, q * n])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        log_p = np.log(prior)[:, None].repeat(len(keys), 1)
        for j in range(width):
            table = belief + np.stack([weight[:, votes[:, j] == v].sum(1) for v in (GOOD, BAD)], 1)
            table /= table.sum(1, keepdims=True)
            for column, v in enumerate((GOOD, BAD)):
                log_p += np.log(table[:, column])[:, None] * (votes[:, j] == v)
        new = 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -500, 500)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return dict(zip(keys, q.tolist(), strict=True))


def features(text: bytes, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams, scaled to length 1; case and signs count."""
    counts = np.zeros(size)
    shift = np.uint32(32 - int(size).bit_length() + 1)
    for at in range(0, max(1, len(text)), PIECE):
        skip = 2 if at else 0
        c = np.frombuffer(text[max(0, at - 2) : at + PIECE], np.uint8).astype(np.uint32)
        with np.errstate(over="ignore"):
            one = (c + np.uint32(1)) * np.uint32(2654435761)
            two = (one[:-1] ^ (c[1:] + np.uint32(7)) * np.uint32(2246822519)) * np.uint32(3266489917)
            three = (two[:-1] ^ (c[2:] + np.uint32(13)) * np.uint32(2654435761)) * np.uint32(2246822519)
        for gram, seen in ((one, skip), (two, max(0, skip - 1)), (three, 0)):
            counts += np.bincount(gram[seen:] >> shift, minlength=size)
    x = np.sqrt(counts)
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-4 * (x @ self.weights + self.offset)))


def fit_scorer(x: np.ndarray, good: np.ndarray, ridge: float = 0.1) -> Scorer:
    """Regularised least squares to 2 * posterior - 1, the two classes with equal weight."""
    y = 2 * good - 1
    up = y > 0
    w = np.where(up, 0.5 / max(1, up.sum()), 0.5 / max(1, (~up).sum())) * len(y)
    offset = float((w * y).sum() / w.sum())
    kernel = x @ x.T
    alpha = np.linalg.solve(kernel + np.diag(ridge / w), y - offset)
    return Scorer((x.T @ alpha).astype(np.float32), offset)


def toxic_lexicon(docs: DataFrame, labels: DataFrame, size: int = LEXICON,
                  rows: int = LEXICON_ROWS) -> tuple[frozenset, frozenset]:
    """Words, and beginnings of words, that stand in texts labelled toxic and hardly elsewhere."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = marks.filter("toxic in (0, 1)").withColumn("key", F.xxhash64("doc_id"))
    chosen = lowest_keys(keyed, "toxic", "key", rows // 2).drop("nth", "key")
    # At most `rows` ids: safe to broadcast.
    texts = docs.select("doc_id", as_bytes()).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, entry, before = [], [], []
        for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = words_of(text)
            pairs = {(w, zlib.crc32(p)) for p, w in zip([b"", *found], found) if len(w) <= 64}
            both = {(b"=" + w, p) for w, p in pairs} | {(b"^" + w[:PREFIX], p) for w, p in pairs if len(w) >= PREFIX}
            toxic += [mark] * len(both)
            entry += [e for e, _ in both]
            before += [p for _, p in both]
        return pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array(entry, pa.binary()), pa.array(before, pa.int64())],
            ["toxic", "entry", "before"],
        )

    # Counted by the different words before an entry: copies of one toxic text are one witness.
    seen = map_batches(texts.withColumn("toxic", F.col("toxic").cast("int")), words, "toxic int, entry binary, before bigint")
    seen = seen.groupBy("entry", "before").agg(F.max("toxic").alias("t"), F.min("toxic").alias("u"))
    counts = stage(seen.groupBy("entry").agg(F.sum("t").alias("p"), F.sum(1 - F.col("u")).alias("n")), "marks")
    total = counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not total["p"]:
        return frozenset(), frozenset()
    rate = (F.col("n") + 0.5) / (total["n"] + 1) * (total["p"] + 1) / (F.col("p") + 0.5)
    # Twenty times as often in toxic texts, after five different words or more.
    found = counts.filter((rate < 0.05) & (F.col("p") >= 5))
    best = found.orderBy(F.desc("p"), "entry").limit(2 * size).collect()
    entries = [bytes(r["entry"]) for r in best]
    return frozenset(e[1:] for e in entries if e[:1] == b"="), frozenset(e[1:] for e in entries if e[:1] == b"^")


N_QUALITY, N_TOXIC = len(quality_votes(b"")), len(toxic_votes(b"", (frozenset(), frozenset())))


def votes(docs: DataFrame, lexicon) -> DataFrame:
    """(key, quality, toxic): hash of the text and patterns of votes of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pattern(quality_votes(t)) for t in texts], pa.int32()),
             pa.array([pattern(toxic_votes(t, lexicon)) for t in texts], pa.int32())], ["key", "quality", "toxic"]
        )

    return map_batches(docs.select(F.xxhash64("text").alias("key"), as_bytes()), run, "key bigint, quality int, toxic int")


def pattern_counts(voted: DataFrame, name: str) -> dict[int, int]:
    """At most 3 ** labellers rows."""
    return {r[name]: r["count"] for r in voted.groupBy(name).count().collect()}


def training_texts(docs: DataFrame, voted: DataFrame, quality: dict[int, float], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and posteriors of a bounded sample of distinct texts."""
    spark = docs.sparkSession
    posterior = spark.createDataFrame(list(quality.items()), "quality int, good double")
    # At most one row for each pattern: safe to broadcast.
    seen = voted.select("key", "quality").distinct().join(F.broadcast(posterior), "quality").filter("abs(good - 0.5) >= 0.2")
    chosen = lowest_keys(seen.withColumn("side", F.col("good") > 0.5), "side", "key", rows // 2).select("key", "good")
    texts = docs.select(F.xxhash64("text").alias("key"), as_bytes()).join(F.broadcast(chosen), "key")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t or b"").astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["key", "good", "x"])

    found = map_batches(texts.select("key", "good", "text"), extract, "key bigint, good double, x binary")
    got = sorted(found.groupBy("key").agg(F.first("good").alias("good"), F.first("x").alias("x")).collect(), key=lambda r: r["key"])
    if not got:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0)
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32)
    return x, np.asarray([r["good"] for r in got])


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, quality_posterior, quality_score, toxic_posterior, toxic, kept of every row."""
    context = docs.sparkSession.sparkContext
    lexicon = toxic_lexicon(docs, labels)
    voted = stage(votes(docs, lexicon), "votes")
    quality = label_model(pattern_counts(voted, "quality"), N_QUALITY)
    clean = label_model(pattern_counts(voted, "toxic"), N_TOXIC) if lexicon[0] or lexicon[1] else {}
    x, good = training_texts(docs, voted, quality, fit_rows)
    scorer = fit_scorer(x, good) if len(x) else Scorer(np.zeros(FEATURES, np.float32), 0.0)
    model = context.broadcast((lexicon, quality, clean, scorer))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, quality, clean, scorer = model.value
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        posterior = np.asarray([quality.get(pattern(quality_votes(t)), 0.5) for t in texts])
        toxic = np.asarray([1 - clean.get(pattern(toxic_votes(t, lexicon)), 1.0) for t in texts])
        score = np.concatenate(
            [scorer.probability(np.stack([features(t) for t in texts[at : at + 256]])) for at in range(0, len(texts), 256)]
        ).astype(float)
        kept = ((posterior + score) / 2 >= 0.5) & (toxic < 0.5)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v) for v in (posterior, score, toxic, toxic >= 0.5, kept))],
            ["doc_id", "quality_posterior", "quality_score", "toxic_posterior", "toxic", "kept"],
        )

    schema = (f"doc_id {kind}, quality_posterior double, quality_score double, toxic_posterior double, "
              "toxic boolean, kept boolean")  # fmt: skip
    return map_batches(docs.select("doc_id", as_bytes()), run, schema)

"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit, on hashed character n-grams of the
whole text, predicts that bit. A text gets the language of the codeword with the least loss, each
bit weighted by how well its classifier separates the training texts; the gap to the second
codeword says how sure that is.

The classifiers are fitted by regularised least squares on at most ``fit_rows`` distinct labelled
texts, the same number for each language as far as they go; the texts are chosen by their own hash.
Only text and label enter a fit, only text a prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled text
everything is ``und``; with one language that one is always chosen; equal losses go to the first
language in order; repeated rows each get a result; rows with a null id are never held out and
never learned from. Very long texts are read in pieces that overlap, so none of their n-grams is
lost. Other columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.llm.common import fresh, lowest_keys, map_batches, remainder

UNKNOWN = "und"
FIT_ROWS = 2000
FEATURES = 4096
LETTER = r"\p{L}"
PIECE = 1 << 20
#: A prediction is ambiguous when the two best languages are closer than this (share of the loss range).
MARGIN = 0.05
#: Multipliers that hash code points of 1-, 2- and 3-grams.
GRAM_HASH = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """n rows of -1/+1. Up to seven languages: the exhaustive code (every way to split them in
    two). More: the random code, of 64 tries, whose closest two rows are farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.asarray(columns, float).T
    width = bits or max(15, int(np.ceil(10 * np.log2(n))))
    best, far = None, -1.0
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if gap > far:
            best, far = code, gap
    return best


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams (lower case; all that is no letter by
    ASCII is one symbol), scaled to length 1."""
    counts = np.zeros(size)
    shift = np.uint32(32 - int(size).bit_length() + 1)
    for at in range(0, max(1, len(text)), PIECE):
        piece = text[max(0, at - 2) : at + PIECE].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        c = np.where(c < 97, np.uint32(32), c)
        first = 0 if at == 0 else 2
        a, b, d = GRAM_HASH
        with np.errstate(over="ignore"):
            one = (c + np.uint32(1)) * a
            two = (one[:-1] ^ (c[1:] + np.uint32(7)) * b) * d
            three = (two[:-1] ^ (c[2:] + np.uint32(13)) * a) * b
        for gram, skip in ((one, first), (two, max(0, first - 1)), (three, 0)):
            counts += np.bincount(gram[skip:] >> shift, minlength=size)
    x = np.sqrt(counts)
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


@dataclass
class Model:
    """Languages, their codewords, weights (features x bits), offsets, and the say of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    say: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and margin for rows of features."""
        margins = np.clip(x @ self.weights + self.offsets, -1, 1)
        loss = ((1 - margins[:, None, :] * self.code[None]) / 2 * self.say).sum(2) / self.say.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(loss)), order[:, 0]]
        second = loss[np.arange(len(loss)), order[:, 1]] if loss.shape[1] > 1 else best + 1
        odds = np.exp(-12 * (loss - best[:, None]))
        return order[:, 0], np.clip(1 / odds.sum(1), 0, 1), second - best


def fit_model(x: np.ndarray, labels: list[str], ridge: float = 0.1) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]]
    offsets = y.mean(0)
    kernel = x @ x.T
    alpha = np.linalg.solve(kernel + ridge * np.eye(len(x)), y - offsets)
    fitted = kernel @ alpha + offsets
    right = (np.sign(fitted) == y).mean(0)
    return Model(languages, code, (x.T @ alpha).astype(np.float32), offsets, np.maximum(right - 0.5, 1e-3))


def training_sample(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, features as bytes) of at most ``fit_rows`` distinct texts, taken in turn from each
    language by the hash of the text."""
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(
        "lang", F.xxhash64("text").alias("key"), "text"
    )
    keys = lowest_keys(usable.select("lang", "key").distinct(), "lang", "key", fit_rows)
    chosen = keys.orderBy("nth", "lang").limit(fit_rows).drop("nth")
    # At most fit_rows keys: safe to broadcast.
    texts = usable.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "key", "text")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "key", "x"]
        )

    found = map_batches(texts, extract, "lang string, key bigint, x binary")
    return found.groupBy("lang", "key").agg(F.first("x").alias("x"))


def train(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Model | None:
    rows = sorted(training_sample(docs, learn, fit_rows).collect(), key=lambda r: (r["lang"], r["key"]))
    if not rows:
        return None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in rows]).astype(np.float32)
    return fit_model(x, [r["lang"] for r in rows])


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and margin of each text; null stands for a text without letters."""
    names, scores, margins = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t is not None]
    if model is None:
        return names, scores, margins
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        best, score, margin = model.decode(np.stack([features(texts[i]) for i in part]))
        for i, b, s, m in zip(part, best.tolist(), score.tolist(), margin.tolist(), strict=True):
            names[i], scores[i], margins[i] = model.languages[b], s, m
    return names, scores, margins


def with_letters(text: str = "text") -> Column:
    return F.when(F.col(text).rlike(LETTER), F.col(text))


def predict(docs: DataFrame, model: Model | None, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, margins = predict_batch(shared.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
             pa.array([n != UNKNOWN and m < margin for n, m in zip(names, margins, strict=True)], pa.bool_())],
            ["doc_id", "lang_pred", "score", "ambiguous"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    return map_batches(docs.select("doc_id", with_letters().alias("text")), run, schema)


def held_out(modulus: int = 3) -> Column:
    return remainder("doc_id", modulus) == 1


def learnable(modulus: int = 3) -> Column:
    return ~held_out(modulus) & F.col("doc_id").isNotNull()


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from rows that are not held out."""
    found = predict(docs, train(docs, learnable(), fit_rows))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame, margin: float = MARGIN, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is decided: not ``und``, and with at least ``margin``
    between the two best languages. Columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learnable(), fit_rows))
    (name,) = fresh(docs.columns, "letters")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lettered = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        names, _, margins = predict_batch(shared.value, [t if ok else None for t, ok in zip(texts, lettered, strict=True)])
        keep = [n != UNKNOWN and m >= margin for n, m in zip(names, margins, strict=True)]
        return batch.select(columns).filter(pa.array(keep, pa.bool_()))

    columns, at = docs.columns, docs.columns.index("text")
    marked = docs.withColumn(name, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    return map_batches(marked, run, docs.schema)

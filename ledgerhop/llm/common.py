"""Helpers shared by the corpus operators: reading, words, batches, tokenizer access."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts of a few kB make batches of a few MB.
BATCH_ROWS = 1000
#: Bytes A-Z to a-z; bytes.split() without argument then cuts at \x20 and \x09-\x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null stays null."""
    return F.col(text).cast("binary")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id, which so belongs to no test fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until none (in any case) is a column already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lowest_keys(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The rows of each group with the ``n`` lowest keys, ``key`` being a 64-bit hash; with their place ``nth``.

    Keys are spread evenly, so four times the share that is wanted, from below, holds the lowest ``n``; only
    these rows meet in the task of a group, however large it is.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    share = F.least(F.lit(1.0), (4.0 * n + 100) / F.col("_size"))
    near = df.join(sizes, group).filter(F.col(key).cast("double") <= share * 2.0**64 - 2.0**63).drop("_size")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return near.withColumn("nth", nth).filter(F.col("nth") <= n)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads uint64 values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def vocabulary_path(name: str) -> str:
    """A bare name is one of the installed public vocabularies; anything else is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_digest(name: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(vocabulary_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: What a tokenizer file must say for its words to be encoded apart: it lower-cases, drops white space
#: and cuts between letters, digits and other signs. Fixed values of that file.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Parts of a lower-case plain text, as that pattern cuts it. Plain are ASCII and the precomposed Latin
#: letters U+00C0 to U+024F, without the two signs among them and the dotted capital I, whose lower case
#: ends in a mark; so a lead byte from C3 to C9 is a letter's.
PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xFF]+|[0-9]|[^a-z0-9\x80-\xFF\s]+")
PLAIN_BYTES = bytes([*range(0x00, 0xC0), *range(0xC3, 0xCA)])
NOT_PLAIN = (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def plain(text: bytes) -> bool:
    """Whether the parts of a text may be encoded apart: no other character, no beginning of a special token."""
    return not text.translate(None, PLAIN_BYTES) and not any(x in text for x in NOT_PLAIN)


def is_word_tokenizer(vocabulary: str) -> bool:
    """Whether a tokenizer file drops white space and cuts words as :class:`WordTokens` does."""
    path = vocabulary_path(vocabulary)
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    special = all(t["content"].startswith("<|") for t in found.get("added_tokens") or [])
    bytes_next = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return found.get("normalizer") == WORD_NORMALIZER and steps[0] == split and bytes_next and special


class WordTokens:
    """Token ids of whole texts through a cache of the parts of their words.

    For a tokenizer that drops white space, lower-cases and cuts between letters, digits and other
    signs, the ids of a plain text are the ids of these parts in order, so only parts seen for the
    first time are encoded, by the tokenizer's own byte-level merges without the normaliser and
    pattern that do nothing to them. Words that are not plain are encoded whole, and kept like parts.
    A cache is emptied when it is full; parts over ``longest`` bytes are not kept.
    """

    def __init__(self, vocabulary: str, words: int = 200_000, parts: int = 1_200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.merges = Tokenizer(self.encoder.model)
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.sizes, self.longest = (words, parts), longest
        #: Ids by part; words encoded whole have a blank in front.
        self.known: dict[bytes, bytes] = {}
        self.whole = 0

    def encode_whole(self, words: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each word, as the library gives them."""
        found = self.encoder.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The same for parts of plain words, all in one call."""
        found = self.merges.encode([p.decode().lower() for p in parts], is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4").tobytes()
        of = np.asarray(found.word_ids, np.int64)
        cuts = (4 * np.searchsorted(of, np.arange(len(parts) + 1))).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, missing: list[bytes]) -> None:
        whole, parts = [], []
        for k in missing:
            (whole if k[:1] == b" " else parts).append(k)
        if whole:
            self.known.update(zip(whole, self.encode_whole([w[1:] for w in whole]), strict=True))
            self.whole += len(whole)
        if parts:
            self.known.update(zip(parts, self.encode_parts(parts), strict=True))

    def keys(self, text: bytes) -> list[bytes]:
        """Parts of a text in order; a word that is not plain is one key, with a blank in front."""
        if plain(text):
            return PARTS.findall(text.translate(LOWER))
        found: list[bytes] = []
        for word in text.split():
            if plain(word):
                found += PARTS.findall(word.translate(LOWER))
            else:
                found.append(b" " + word)
        return found

    def ids(self, texts: list[bytes | None], together: int = 64) -> Iterator[bytes]:
        """For each text (null: empty) the bytes of its ids."""
        for at in range(0, len(texts), together):
            pieces, of = [], []
            for n, text in enumerate(texts[at : at + together]):
                for piece in cut_at_blanks(text or b""):
                    pieces.append(self.keys(piece))
                    of.append(n)
            found = [list(map(self.known.get, keys)) for keys in pieces]
            missing = {k for keys, ids in zip(pieces, found, strict=True) if None in ids for k, x in zip(keys, ids) if x is None}
            if missing:
                if self.whole > self.sizes[0] or len(self.known) + len(missing) > sum(self.sizes):
                    # Ids already found stay in their lists.
                    self.known, self.whole = {}, 0
                self.learn(list(missing))
            known, out = self.known, [b""] * (min(len(texts), at + together) - at)
            for n, keys, ids in zip(of, pieces, found, strict=True):
                if missing and None in ids:
                    ids = [known[k] if x is None else x for k, x in zip(keys, ids, strict=True)]
                out[n] += b"".join(ids)
            for k in missing:
                if len(k) > self.longest:
                    self.whole -= k[:1] == b" "
                    del self.known[k]
            yield from out


def cut_at_blanks(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in pieces of a few MB that end before a blank."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class WholeTokens:
    """Token ids of whole texts as the library gives them, for any other vocabulary."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(vocabulary)
        if path.endswith(".model"):
            import sentencepiece

            reader = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: reader.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            reader = Tokenizer.from_file(path)
            reader.no_truncation()
            reader.no_padding()
            self.encode = lambda texts: [e.ids for e in reader.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: list[bytes | None], together: int = 64) -> Iterator[bytes]:
        """For each text (null: empty) the bytes of its ids."""
        for at in range(0, len(texts), together):
            part = [(t or b"").decode("utf-8", "replace") for t in texts[at : at + together]]
            for found in self.encode(part):
                yield np.asarray(found, "<u4").tobytes()


_TOKENS: dict[str, WordTokens | WholeTokens] = {}


def word_tokens(vocabulary: str) -> WordTokens | WholeTokens:
    """One encoder per Python worker."""
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = (WordTokens if is_word_tokenizer(vocabulary) else WholeTokens)(vocabulary)
    return _TOKENS[vocabulary]

"""URL verdicts: fixed host and path rules first, a learned scorer for everything else.

The scorer is a logistic regression on hashed character n-grams (3 to 5 bytes) of host and path. It
is fitted on at most ``fit_rows`` distinct urls of a small labelled table, taken by the hash of the url;
a url that carries both labels counts with its share of them. Weights are a vector of ``FEATURES``
numbers, so what is sent to the tasks never grows with the data. Only the url is read, never the page.

A rule (host, path, verdict) fits its host and all subdomains where the path of the url starts with the
path of the rule; the longest rule wins (host and path together, then the longer host).

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed;
so is a url whose host and path are both empty. Repeated rows each get a verdict. Without labelled rows
(null urls and labels are no rows) the scorer allows everything; with labels of one kind only it says
that one. Very long urls are read whole, in pieces that overlap by a gram. Columns of the input with
clashing names are ignored; only the id and the url are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.llm.common import map_batches, mix64

FEATURES = 1 << 13
SIZES = (3, 4, 5)
PIECE = 1 << 20
FIT_ROWS = 2000
#: From this probability on a url is blocked.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith(f".{self.host}")
        return own & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        name = F.when(rule.fits(host, path), rule.name).otherwise(name)
        verdict = F.when(rule.fits(host, path), rule.verdict).otherwise(verdict)
    return name, verdict


def parts(hosts: Sequence[bytes], paths: Sequence[bytes]) -> list[tuple[int, int, bytes, int]]:
    """(row, salt, bytes, first starts) of host and path of each row; a long one comes in pieces,
    each with the bytes its last grams reach into, of which only the first starts count."""
    out = []
    for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for salt, text in ((1, b"^" + host + b"$" if host else b""), (2, path)):
            for at in range(0, len(text), PIECE):
                out.append((row, salt, text[at : at + PIECE + SIZES[-1] - 1], min(PIECE, len(text) - at)))
    return out


def grams(pieces: Sequence[tuple[int, int, bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every n-gram of the pieces."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8).astype(np.uint64)
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(data))
    starts = np.array([p[3] for p in pieces], np.int64)
    counts = at - (ends - sizes)[of] < starts[of]
    rows, salts = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.uint64)
    found_rows, found = [], []
    for n in SIZES:
        begin = np.flatnonzero(counts & (at + n <= ends[of]))
        key = salts[of[begin]] << np.uint64(4) | np.uint64(n)
        for step in range(n):
            key = key << np.uint64(8) | data[begin + step]
        found_rows.append(rows[of[begin]])
        found.append((mix64(key) % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(found_rows), np.concatenate(found)


def chunks(pieces: list) -> list[list]:
    """Pieces together up to about ``PIECE`` bytes."""
    out, size = [[]], 0
    for p in pieces:
        if out[-1] and size + len(p[2]) > PIECE:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p[2])
    return out


def lengths(hosts: Sequence[bytes], paths: Sequence[bytes]) -> np.ndarray:
    """Number of grams of each row."""
    framed = np.array([[len(h) + 2 if h else 0, len(p)] for h, p in zip(hosts, paths, strict=True)], np.int64).reshape(-1, 2)
    return sum(np.maximum(framed - n + 1, 0).sum(1) for n in SIZES)


def features(hosts: Sequence[bytes], paths: Sequence[bytes]) -> np.ndarray:
    """Counts of the hashed grams over the root of their number, one row per url."""
    x = np.zeros((len(hosts), FEATURES), np.float32)
    for part in chunks(parts(hosts, paths)):
        if part:
            np.add.at(x, grams(part), 1)
    return x / np.sqrt(np.maximum(lengths(hosts, paths), 1))[:, None].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def probabilities(self, hosts: Sequence[bytes], paths: Sequence[bytes]) -> np.ndarray:
        """Probability that each url is to be blocked; 0 for one without host and path."""
        total = np.zeros(len(hosts))
        for part in chunks(parts(hosts, paths)):
            if part:
                rows, cols = grams(part)
                total += np.bincount(rows, self.weights[cols], len(hosts))
        n = lengths(hosts, paths)
        logit = total / np.sqrt(np.maximum(n, 1)) + self.offset
        empty = np.array([not h and not p for h, p in zip(hosts, paths, strict=True)], bool)
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, steps: int = 400) -> Model:
    """Logistic regression by accelerated gradient steps; y holds shares between 0 and 1."""
    if not len(x) or y.min() == y.max() and y.min() in (0.0, 1.0):
        return Model(np.zeros(FEATURES), -20.0 if not len(x) or y.min() == 0.0 else 20.0)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    # The loss bends at most as the largest eigenvalue of x'x / 4n.
    rate = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * len(x)) + ridge)
    w = ahead = np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        gradient = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) / len(x) + ridge * ahead
        before, w = w, ahead - rate * gradient
        ahead = w + (step - 1) / (step + 2) * (w - before)
    return Model(w[:-1], float(w[-1]))


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", fit_rows: int = FIT_ROWS) -> Model:
    """The scorer of a labelled table; each distinct url counts once, with its mean label."""
    rows = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("blocked"))
    urls = rows.dropna().groupBy("url").agg(F.avg("blocked").alias("blocked"))
    chosen = urls.withColumn("key", F.xxhash64("url")).orderBy("key", "url").limit(fit_rows)
    pieces = chosen.select(host_of(F.col("url")).cast("binary").alias("h"), path_of(F.col("url")).cast("binary").alias("p"), "blocked")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0).to_pylist(), batch.column(1).to_pylist()).astype(np.float16)
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["x", "blocked"])

    found = map_batches(pieces, extract, "x binary, blocked double").collect()
    found.sort(key=lambda r: (bytes(r["x"]), r["blocked"]))
    x = np.array([np.frombuffer(bytes(r["x"]), np.float16) for r in found], np.float32).reshape(-1, FEATURES)
    return fit(x, np.array([r["blocked"] for r in found], float))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = (), page_id: str = "page_id", url: str = "url",
          threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the scorer's), p_blocked of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled, fit_rows=fit_rows))
    kind = pages.schema[page_id].dataType.simpleString()
    host, path = host_of(F.col(url)), path_of(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = (batch.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
        p = pa.array(shared.value.probabilities(hosts, paths), pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, p], ["page_id", "host", "path", "p_blocked"])

    scored = map_batches(split, score, f"page_id {kind}, host string, path string, p_blocked double")
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    learned = F.when(F.col("p_blocked") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "p_blocked")


#: A small labelled table, as a person marks it before a first crawl: names of hosts to block and to allow.
BLOCKED_HOSTS = """
royal-casino lucky-casino casino-online casinos slots-win win-cash big-win sportbets best-bets live-bets bets-now
free-spins free-money free-movies cheap-meds cheap-watches cheap-viagra cheap-bags pills-shop diet-pills buy-pills
spam-blog spam-links seo-spam spammers link-farm content-farm click-farm farm-links ads-server ads-click popup-ads
my-ads track-clicks pixel-track adtrack link-track adult-chat adult-video adults xxx-adult adult-cams x-rated hot-xxx
payday-loan fast-loans fake-bags replica-shop miracle-diet jackpot-win
"""
ALLOWED_HOSTS = """
library city-news garden school weather recipes open-science thomas history station nation theatre health other
thatcher north thebridge earth anderson another weather-map maths thread edition travel-notes reader motion thermal
method thing whether authors gathering nations stones rivers hotel-guide farmers winter tracks freedom cooking
hathaway thanet that-day thus lathe teatime blessed southend threads strand
"""


def labelled_urls() -> list[tuple[str, bool]]:
    """Urls of these hosts. Subdomain, domain, section and ending go round alike in both lists, so only
    the names can tell them apart."""
    out = []
    for names, blocked in ((BLOCKED_HOSTS, True), (ALLOWED_HOSTS, False)):
        for i, name in enumerate(names.split()):
            front, domain, section = ("", "www.", "blog.", "m.")[i % 4], ("com", "org", "net")[i % 3], ("en", "de", "fr", "es")[i // 4 % 4]
            out.append((f"http{'s' * (i % 2)}://{front}{name}.example.{domain}/{section}/{7 * i + 3}{('', '/', '?ref=x', '#top', '.html')[i % 5]}", blocked))
    return out

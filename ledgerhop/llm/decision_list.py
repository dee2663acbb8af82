"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of the whole text are built-in expressions within the row. From at most ``fit_rows``
labelled rows of these statistics (numbers, no texts) sequential covering learns rules against the
bad class: a rule grows by the threshold test with the best information gain, is then pruned on
rows it was not grown on, and is kept while it is precise there; the rows it covers are taken away
and the next one is grown. The ordered rules become one conditional expression.

Defined cases: a null text has no words; texts without words or lines have zero shares; rows
without a label or id are judged but not learned from; a text labelled twice counts twice; without
labels of both classes there are no rules and only the base rule drops. Repeated rows each get a
result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.staging import stage

FIT_ROWS = 20_000
#: Fixed by the query's contract: base rule of short and repetitive texts.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
            "marks_per_word", "distinct_share"]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the shares that rules test, of every row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("t")
    split = docs.select("doc_id", text).select(
        "doc_id", "t",
        F.filter(F.split("t", BLANK, -1), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    sized = split.select(
        "doc_id", "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", BLANK, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("t", "[^!?]+", "")).alias("n_marks"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    counted = sized.withColumn("n_repeat_words", repeated_words())
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id", *COUNTS,
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("n_marks") / words).alias("marks_per_word"),
        (F.col("n_distinct") / words).alias("distinct_share"),
    )


def repeated_words() -> Column:
    """Words in 3-word windows that a text has twice or more, in n log n within the row.

    Each window is one number: a hash above, its place in the lowest bits (as many as the number of
    words needs). Sorted, equal windows are neighbours; their places, sorted again, give the words
    covered. At 20,000 words 49 bits of hash remain: a false match once in some million such texts.
    """
    bits = "length(bin(n_words))"
    windows = (
        f"transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> shiftleft(shiftright("
        f"xxhash64(x, get(w, i + 1), get(w, i + 2)), {bits}), {bits}) | cast(i as bigint))"
    )
    places = (
        f"transform(s, (x, i) -> if(shiftright(x, {bits}) <=> shiftright(get(s, i - 1), {bits}) or "
        f"shiftright(x, {bits}) <=> shiftright(get(s, i + 1), {bits}), "
        f"x & (shiftleft(1L, {bits}) - 1), -1L))"
    )
    covered = (
        "aggregate(sort_array(filter(p, x -> x >= 0)), named_struct('last', -3L, 'n', 0L), "
        "(a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)"
    )
    # One-element arrays bind each step to a name, so that it is computed once.
    return F.expr(
        f"element_at(transform(transform(array(sort_array({windows})), s -> {places}), p -> {covered}), 1)"
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature < value."""

    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.at_least else c < self.value

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for test in rule:
        out &= test.mask(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4, cuts: int = 48) -> Rule:
    """Add the test with the best gain until only bad rows are covered or none gains."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for name in FEATURES:
            v, b = x[name][inside], bad[inside]
            for value in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="nearest")):
                above = v >= value
                for at_least, m in ((True, above), (False, ~above)):
                    p, n = (b & m).sum(), (~b & m).sum()
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Test(name, at_least, float(value)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on other rows; with p and n."""
    best, worth = ((), 0, 0), -2.0
    for k in range(1, len(rule) + 1):
        m = covers(rule[:k], x)
        p, n = int((bad & m).sum()), int((~bad & m).sum())
        w = (p - n) / (p + n) if p + n else -1.0
        if w > worth:
            best, worth = (rule[:k], p, n), w
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 3,
                most: int = 16) -> list[Rule]:
    """Ordered rules against the bad rows; every third row prunes, the others grow."""
    if not bad.any() or bad.all():
        return []
    pruning = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & ~pruning).any():
        g, h = left & ~pruning, left & pruning
        rule, p, n = prune(grow({k: v[g] for k, v in x.items()}, bad[g]), {k: v[h] for k, v in x.items()}, bad[h])
        if not rule or p < support or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """At most ``fit_rows`` labelled rows that the base rule lets through, by the hash of the id."""
    marks = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    known = stage(stats.filter(~base_failed()).join(marks, "doc_id").select(*FEATURES, "quality", "doc_id"), "labelled")
    # A share of the hashes that holds about as many rows as wanted, so tasks return no more than those.
    share = min(1.0, 1.2 * fit_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    order = [F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES]
    rows = chosen.orderBy(*order).limit(fit_rows).collect()
    x = {f: np.asarray([r[f] for r in rows], float) for f in FEATURES}
    return x, np.asarray([r["quality"] == 0 for r in rows], bool)


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (the first that fired; 0: none)."""
    stats = stage(text_statistics(docs), "text-statistics")
    rules = learn_rules(*labelled(stats, labels, fit_rows))
    judged = stats.withColumn("rule", rule_column(rules)).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "rule")

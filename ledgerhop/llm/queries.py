"""Registered queries of the corpus operators over the whole given tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerhop.llm import (
    decision_list,
    decontamination,
    hard_negatives,
    language,
    lexical_search,
    line_dedup,
    lm_scoring,
    near_duplicates,
    packing,
    passages,
    token_counts,
    url_filter,
    weak_labels,
)
from ledgerhop.llm.common import load

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


@query("op1_language_codes")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    return language.identify(load(spark, sf, "documents"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts through a digest cache that starts empty with each call."""
    return token_counts.count_tokens(load(spark, sf, "documents"))


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
    FROM b WHERE len(w) > 0) x),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k) x),
m AS (SELECT dw.rid, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM m) x GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) x GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN i ON i.rid = d.rid
"""


@query("op7_decontamination", DECONTAMINATION_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document inside benchmark windows, by suffix automaton."""
    return decontamination.find_hits(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query("op8_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(load(spark, sf, "documents"))


@query("op2_collinear_chains")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of every document that an earlier one has, by chained seeds."""
    return passages.find_passages(load(spark, sf, "documents"))


@query("op3_line_alignment")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut of the blocks of lines that an earlier one has; the text as a digest."""
    cut = line_dedup.dedup_lines(load(spark, sf, "documents"))
    return cut.select("doc_id", "n_deleted", "sources", F.sha2("text", 256).alias("text_sha256"))


@query("op4_decision_list")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics and the verdict of a learned decision list for every document."""
    return decision_list.judge(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query("op9_bloom_language_model")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram and filter-model log probabilities of every document."""
    return lm_scoring.score(load(spark, sf, "documents"))


@query("op10_weighted_near_duplicates")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document by weighted MinHash."""
    return near_duplicates.near_duplicates(load(spark, sf, "documents"))


@query("op6_weak_labels")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and toxicity of every document from weak labels."""
    return weak_labels.classify(load(spark, sf, "documents"), load(spark, sf, "labels"))


LEXICAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, terms FROM (SELECT DISTINCT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark) x),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) x GROUP BY rid, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(terms) AS term FROM q) x),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS wt
  FROM df, total),
m AS (SELECT rid, 10 + (90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
scores AS (SELECT qt.qid, tf.rid,
    CAST(sum(wt * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM qt JOIN tf ON tf.term = qt.term JOIN weights ON weights.term = qt.term JOIN m ON m.rid = tf.rid
  GROUP BY qt.qid, tf.rid),
ranked AS (SELECT qid, rid, score,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM (SELECT s.qid, s.rid, s.score, d.doc_id FROM scores s JOIN d ON d.rid = s.rid WHERE s.score > 0) x)
SELECT q.item_id, CAST(r.rank AS INTEGER) AS rank, d.doc_id, r.score
FROM ranked r JOIN q ON q.qid = r.qid JOIN d ON d.rid = r.rid WHERE r.rank <= 10
"""


@query("op11_lexical_search", LEXICAL_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


@query("op12_url_filter")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url: four rules, then the scorer fitted on the small labelled table."""
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, blocked boolean")
    return url_filter.judge(load(spark, sf, "pages"), labelled, URL_RULES)


NEGATIVES_SQL = r"""
WITH given AS (SELECT row_number() OVER () AS rid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS c FROM given),
scores AS (SELECT a.rid AS arid, b.rid AS brid, CAST(sum(a.x * b.x) AS BIGINT) AS s
  FROM parts a JOIN given g ON g.rid = a.rid AND g.vec_id % 50 = 0 JOIN parts b ON b.c = a.c AND b.rid <> a.rid
  GROUP BY a.rid, b.rid),
pairs AS (SELECT s.arid, s.brid, s.s, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same
  FROM scores s JOIN given a ON a.rid = s.arid JOIN given b ON b.rid = s.brid),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY s DESC, other_id ASC NULLS LAST) AS k
  FROM pairs WHERE same) x WHERE k <= 5),
neg AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
    row_number() OVER (PARTITION BY p.arid, p.brid ORDER BY n.s DESC, n.other_id ASC NULLS LAST) AS rank
  FROM pos p JOIN pairs n ON n.arid = p.arid AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding and its five positives; every seventh label is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = load(spark, sf, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(embeddings, F.col("vec_id") % 50 == 0)

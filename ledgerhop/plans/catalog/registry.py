"""Registered queries and their SQL twins.

A query is a callable ``(spark, sf_dir) -> DataFrame`` over the test tables; the SQL
states the same result for an independent engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


# Common table expressions shared by the SQL twins.
TR = """tr AS (
  SELECT event_id, 't' || event_id AS transfer_id, 'x' || (event_id // 2) AS tx_hash,
    'a' || user_id AS f, 'a' || regexp_extract(props, '"k": ([0-9]+)', 1) AS t,
    CASE WHEN event_type = 'view' THEN 'native' ELSE 'erc20' END AS asset_type,
    'id-' || event_type AS asset_id, upper(event_type) AS asset_symbol,
    CAST(value AS DECIMAL(18,2)) AS amount, event_id % 2 AS transfer_index, ts,
    event_id // 10 AS block_number
  FROM events)"""

# Wallets with their number, and the labels made from them.
WALLETS = """w AS (
  SELECT DISTINCT n FROM (SELECT user_id AS n FROM events UNION ALL
    SELECT CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) FROM events) u)"""
LABELS = f"""{WALLETS},
lb AS (
  SELECT 'a' || n AS node, n, n_name AS entity_name, n_regionkey,
    CASE n % 10 WHEN 0 THEN 'VASP_DEPOSIT' WHEN 1 THEN 'VASP_HOT' WHEN 2 THEN 'MIXER'
      ELSE 'BRIDGE' END AS entity_type
  FROM w JOIN nation ON n % 25 = n_nationkey WHERE n % 10 <= 3)"""

# All transfers, and the 3-hop forward trace of one case per nation.
TRACE = f"""{TR},
e AS (SELECT * FROM tr),
pairs AS (SELECT DISTINCT f AS node, t AS nxt FROM e),
cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
r(case_id, node, hop) AS (
  SELECT case_id, root, 0 FROM cases
  UNION
  SELECT r.case_id, p.nxt, r.hop + 1 FROM r JOIN pairs p ON p.node = r.node WHERE r.hop < 3),
traced AS (SELECT case_id, node, min(hop) AS hop FROM r GROUP BY case_id, node)"""

# Edges and nodes of those cases.
GRAPH = f"""{TRACE},
ce AS (
  SELECT n.case_id, c.root, e.*, far.hop AS hop
  FROM traced n JOIN cases c ON c.case_id = n.case_id
  JOIN e ON e.f = n.node
  JOIN traced far ON far.case_id = n.case_id AND far.node = e.t
  WHERE n.hop < 3),
{LABELS},
nd AS (
  SELECT t.case_id, t.node, t.hop, c.root, t.node = c.root AS is_root,
    CASE WHEN t.node = c.root THEN 'SUSPECT' ELSE coalesce(lb.entity_type, 'INTERMEDIARY') END AS node_type
  FROM traced t JOIN cases c ON c.case_id = t.case_id LEFT JOIN lb ON lb.node = t.node)"""

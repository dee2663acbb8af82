"""Queries: breakpoints, typologies, timed patterns, evidence and digests.

Events are sparse, so the timed rules run with windows of hours here; the library
defaults are the published minutes.
"""

from pyspark.sql import functions as F

from ledgerhop.operators import evidence, graph, risk, scoring
from ledgerhop.plans.catalog.registry import GRAPH, TR, query
from ledgerhop.plans.catalog.scores import SCORES
from ledgerhop.plans.catalog.shared import base_edges, traced_graph
from ledgerhop.plans.investigate import assess
from ledgerhop.sources import bench_tables as tables
from ledgerhop.sources import sinks
from ledgerhop.staging import stage, stage_path

_POINTS = f"""{GRAPH},
og AS (SELECT case_id, f AS node, count(*) AS n FROM ce GROUP BY case_id, f),
q AS (SELECT nd.*, coalesce(n, 0) AS n, coalesce(n, 0) >= 3 AND NOT is_root AS fan, node_type IN ('MIXER', 'BRIDGE') AS special
  FROM nd LEFT JOIN og ON og.case_id = nd.case_id AND og.node = nd.node),
bp AS (SELECT case_id, node, n AS transactions, CASE WHEN fan THEN 'ANOMALOUS_FAN_OUT' ELSE 'DIRECT_' || node_type || '_INTERACTION' END AS breakpoint_type,
  CASE WHEN node_type = 'MIXER' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  concat_ws('; ', CASE WHEN fan THEN 'Fans out into ' || n || ' transfers' END, CASE WHEN special THEN 'Flow meets a known ' || lower(node_type) END) AS reasoning
  FROM q WHERE fan OR special)"""


def _points(spark, sf):
    g = traced_graph(spark, sf)
    return g, risk.breakpoints(g.nodes, g.edges)


@query(
    "r1_r2_r3_breakpoints",
    f"WITH RECURSIVE {_POINTS} SELECT case_id, node, breakpoint_type, severity, reasoning, transactions FROM bp",
)
def _(spark, sf):
    return _points(spark, sf)[1].select(
        "case_id", "node", "breakpoint_type", "severity", "reasoning", "transactions"
    )


@query(
    "r1_breakpoint_transactions",
    f"""WITH RECURSIVE {_POINTS} SELECT ce.case_id, f AS node, count(*) AS transfers FROM ce JOIN bp ON bp.case_id = ce.case_id AND bp.node = f
GROUP BY ce.case_id, f""",
)
def _(spark, sf):
    g, points = _points(spark, sf)
    found = risk.breakpoint_transactions(points, g.edges)
    return found.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("transfers"))


@query(
    "r3_marked_nodes",
    f"""WITH RECURSIVE {_POINTS} SELECT nd.case_id, nd.node, bp.node IS NOT NULL AS is_breakpoint
FROM nd LEFT JOIN bp ON bp.case_id = nd.case_id AND bp.node = nd.node""",
)
def _(spark, sf):
    g, points = _points(spark, sf)
    return risk.mark_breakpoints(g.nodes, points).select("case_id", "node", "is_breakpoint")


_FINDINGS = f"""{GRAPH},
dep AS (SELECT case_id, max(CASE WHEN hop = 3 AND node IN (SELECT node FROM pairs) THEN 0 ELSE hop END) AS d FROM traced GROUP BY case_id),
fd AS (SELECT dep.case_id, 'TYP-01' AS typology_code, 'HIGH' AS severity, root AS affected_address, d AS measure FROM dep JOIN cases ON cases.case_id = dep.case_id WHERE d >= 2
  UNION ALL SELECT nd.case_id, CASE WHEN node_type = 'MIXER' THEN 'TYP-04' ELSE 'TYP-05' END, CASE WHEN node_type = 'MIXER' THEN 'CRITICAL' ELSE 'MEDIUM' END,
  nd.node, count(ce.transfer_id) FROM nd LEFT JOIN ce ON ce.case_id = nd.case_id AND (ce.f = nd.node OR ce.t = nd.node)
  WHERE node_type IN ('MIXER', 'BRIDGE') GROUP BY nd.case_id, nd.node, node_type)"""


@query(
    "r4_r5_r6_findings",
    f"WITH RECURSIVE {_FINDINGS} SELECT case_id, typology_code, severity, affected_address, measure FROM fd",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    totals = graph.graph_totals(g.nodes, g.edges)
    deep = risk.layering(totals, g.cases, g.edges, min_depth=2)
    found = deep.unionByName(risk.exposure(g.nodes, g.edges))
    return found.select("case_id", "typology_code", "severity", "affected_address", "measure")


@query(
    "r4_first_evidence",
    f"""WITH RECURSIVE {GRAPH}, x AS (SELECT case_id, tx_hash, row_number() OVER (PARTITION BY case_id ORDER BY ts, tx_hash, transfer_id) AS n FROM ce)
SELECT case_id, string_agg(tx_hash, ',' ORDER BY n) AS evidence FROM x WHERE n <= 4 GROUP BY case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    totals = graph.graph_totals(g.nodes, g.edges)
    found = risk.layering(totals, g.cases, g.edges, min_depth=1)
    return found.select("case_id", F.array_join("evidence_head", ",").alias("evidence"))


@query(
    "r5_exposure_transactions",
    f"""WITH RECURSIVE {GRAPH} SELECT nd.case_id, nd.node, node_type, ce.transfer_id FROM nd
JOIN ce ON ce.case_id = nd.case_id AND (ce.f = nd.node OR ce.t = nd.node) WHERE node_type IN ('MIXER', 'BRIDGE')""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    return risk.exposure_transactions(g.nodes, g.edges).select("case_id", "node", "node_type", "transfer_id")


@query(
    "r7_risk_summary",
    f"""WITH RECURSIVE {_FINDINGS}, f3 AS (SELECT * FROM fd WHERE typology_code <> 'TYP-01' OR measure >= 3)
SELECT c.case_id, count(f3.case_id) AS total_findings, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'HIGH') THEN 'HIGH'
  WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk_level
FROM cases c LEFT JOIN f3 ON f3.case_id = c.case_id GROUP BY c.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    return assess(g, g.labels).risk


@query(
    "r8_fan_out_bursts",
    f"""WITH {TR} SELECT f AS source, epoch_us(ts) AS ts_us, n AS transfers FROM (
  SELECT DISTINCT f, ts, count(*) OVER (PARTITION BY f ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS n FROM tr) x WHERE n >= 4""",
)
def _(spark, sf):
    found = risk.fan_out_bursts(base_edges(spark, sf), ["chain"], 4, 12 * 3600)
    return found.select("source", F.unix_micros("ts").alias("ts_us"), "transfers")


# Last inflow at or before each outflow.
_HELD = f"""{TR}, inflow AS (SELECT DISTINCT t AS node, ts FROM tr WHERE f <> t),
li AS (SELECT tr.transfer_id, tr.f, tr.t, tr.amount, tr.ts, i.ts AS inflow_ts FROM tr ASOF LEFT JOIN inflow i ON i.node = tr.f AND i.ts <= tr.ts)"""


@query(
    "r9_last_inflow",
    f"WITH {_HELD} SELECT transfer_id, epoch_us(ts) - epoch_us(inflow_ts) AS held_us FROM li",
)
def _(spark, sf):
    found = risk.last_inflow(base_edges(spark, sf), ["chain"])
    return found.select(
        "transfer_id", (F.unix_micros("ts") - F.unix_micros("inflow_ts")).alias("held_us")
    )


@query(
    "r9_rapid_relays",
    f"""WITH {_HELD}, m AS (SELECT f AS node, median(CAST(epoch_us(ts) - epoch_us(inflow_ts) AS DOUBLE) / 1000000.0) AS median_held
  FROM li WHERE inflow_ts IS NOT NULL GROUP BY f) SELECT node, round(median_held, 4) AS median_held FROM m WHERE median_held <= 4 * 3600""",
)
def _(spark, sf):
    edges = risk.last_inflow(base_edges(spark, sf), ["chain"])
    found = risk.rapid_relays(edges, ["chain"], 4 * 3600)
    return found.select("node", F.round("median_held", 4).alias("median_held"))


@query(
    "r10_fragmentation",
    f"""WITH {_HELD} SELECT f AS node, epoch_us(inflow_ts) AS inflow_us, count(*) AS parts, CAST(sum(amount) AS DOUBLE) AS total
FROM li WHERE inflow_ts IS NOT NULL GROUP BY f, inflow_ts
HAVING count(*) >= 3 AND sum(amount) > 0 AND (max(CAST(amount AS DOUBLE)) - min(CAST(amount AS DOUBLE))) * count(*) <= 1.5 * CAST(sum(amount) AS DOUBLE)""",
)
def _(spark, sf):
    edges = risk.last_inflow(base_edges(spark, sf), ["chain"])
    found = risk.fragmentation(edges, ["chain"], parts=3, spread=1.5)
    return found.select("node", F.unix_micros("inflow_ts").alias("inflow_us"), "parts", "total")


@query(
    "r11_rapid_layering",
    f"""WITH {TR}, k2 AS (SELECT b.transfer_id, b.t, b.ts, max(a.ts) AS s FROM tr b JOIN tr a ON a.t = b.f AND a.ts < b.ts GROUP BY b.transfer_id, b.t, b.ts),
k3 AS (SELECT c.transfer_id, c.ts, max(s) AS s FROM tr c JOIN k2 ON k2.t = c.f AND k2.ts < c.ts GROUP BY c.transfer_id, c.ts)
SELECT transfer_id, epoch_us(ts) - epoch_us(s) AS elapsed_us FROM k3 WHERE epoch_us(ts) - epoch_us(s) < 4 * 3600 * 1000000 :: BIGINT""",
)
def _(spark, sf):
    found = risk.rapid_layering(base_edges(spark, sf), ["chain"], 3, 4 * 3600)
    return found.select(
        "transfer_id", (F.unix_micros("ts") - F.unix_micros("started")).alias("elapsed_us")
    )


@query(
    "r12_smurfing",
    f"""WITH {TR}, x AS (SELECT DISTINCT f, ts, sum(CASE WHEN amount < 20 THEN 1 ELSE 0 END) OVER (
  PARTITION BY f ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS n FROM tr)
SELECT f AS node, epoch_us(ts) AS ts_us, CAST(n AS BIGINT) AS small FROM x WHERE n >= 3 AND f IN (SELECT t FROM tr)""",
)
def _(spark, sf):
    found = risk.smurfing(base_edges(spark, sf), ["chain"], "20", 3, 12 * 3600)
    return found.select("node", F.unix_micros("ts").alias("ts_us"), "small")


# Over all transfers no wallet has just two, so chains are looked for within each day and asset.
@query(
    "r13_peel_chains",
    f"""WITH {TR}, e AS (SELECT *, CAST(ts AS DATE) AS day FROM tr),
s AS (SELECT day, asset_id, f AS node, arg_max(t, (amount, t)) AS nxt FROM e GROUP BY day, asset_id, f
  HAVING count(*) = 2 AND CAST(max(amount) AS DOUBLE) >= 0.5 * CAST(sum(amount) AS DOUBLE))
SELECT a.day, a.asset_id, a.node AS head, b.node AS second, b.nxt AS change_address
FROM s a JOIN s b ON b.node = a.nxt AND b.day = a.day AND b.asset_id = a.asset_id WHERE b.node <> a.node""",
)
def _(spark, sf):
    edges = base_edges(spark, sf).withColumn("day", F.to_date("ts"))
    found = risk.peel_chains(edges, ["chain", "day", "asset_id"], steps=2, major=0.5)
    return found.select("day", "asset_id", "head", F.element_at("nodes", 2).alias("second"), "change_address")


_PEEL = f"""{TR}, e AS (SELECT *, CAST(ts AS DATE) AS day FROM tr),
s AS (SELECT asset_id, day, f AS node, arg_max(t, (amount, t)) AS nxt FROM e GROUP BY asset_id, day, f
  HAVING count(*) = 2 AND sum(amount) > 0 AND CAST(max(amount) AS DOUBLE) >= 0.9 * CAST(sum(amount) AS DOUBLE)),
l AS (SELECT a.asset_id || '|' || a.day || '|' || a.node AS id, a.nxt AS change_address,
    (SELECT a.asset_id || '|' || min(b.day) || '|' || a.nxt FROM s b WHERE b.asset_id = a.asset_id AND b.node = a.nxt AND b.day >= a.day) AS nxt FROM s a),
w(head, cur, n, path) AS (SELECT id, id, 1, [id] FROM l
  UNION ALL SELECT w.head, l.nxt, n + 1, list_append(path, l.nxt) FROM w JOIN l ON l.id = w.cur
    WHERE l.nxt IS NOT NULL AND NOT list_contains(path, l.nxt)),
walks AS (SELECT head, max(n) AS steps, arg_max(cur, n) AS last, arg_max(path, n) AS path FROM w GROUP BY head),
ended AS (SELECT walks.*, l.nxt AS onward, l.change_address FROM walks JOIN l ON l.id = last),
loops AS (SELECT head, path FROM ended WHERE onward = head),
heads AS (SELECT id AS head FROM l WHERE id NOT IN (SELECT nxt FROM l WHERE nxt IS NOT NULL)
  UNION SELECT head FROM loops WHERE head = list_min(path)
    AND NOT EXISTS (SELECT 1 FROM l WHERE list_contains(loops.path, l.nxt) AND NOT list_contains(loops.path, l.id)))"""


@query(
    "r13_maximal_peel_chains",
    f"""WITH RECURSIVE {_PEEL}
SELECT head, last, CAST(steps AS BIGINT) AS steps, onward IS NOT NULL AS looped, change_address
FROM ended WHERE head IN (SELECT head FROM heads) AND steps >= 3""",
)
def _(spark, sf):
    """Chains of three splits or more of 90 to 10, per asset, going on over the days."""
    edges = base_edges(spark, sf).withColumn("day", F.to_date("ts"))
    found = risk.maximal_peel_chains(edges, ["chain", "asset_id"], "day")
    names = [F.concat_ws("|", *[F.col(c)[k].cast("string") for k in ("asset_id", "day", "node")]).alias(c) for c in ("head", "last")]
    return found.select(*names, "steps", "looped", "change_address")


@query(
    "r14_reconvergence",
    f"""WITH {TR}, p AS (SELECT DISTINCT f, t FROM tr WHERE f <> t)
SELECT a.f AS source, b.t AS target, count(*) AS middles FROM p a JOIN p b ON b.f = a.t AND a.f <> b.t
GROUP BY 1, 2 HAVING count(*) > 3""",
)
def _(spark, sf):
    found = risk.reconvergence(base_edges(spark, sf), ["chain"], more_than=3)
    return found.select("source", "target", "middles")


@query(
    "r15_wallet_anomalies",
    f"""WITH {TR}, x AS (SELECT f AS node, CAST(count(*) AS DOUBLE) AS q, CAST(sum(amount) AS DOUBLE) / count(*) AS m FROM tr GROUP BY f),
c AS (SELECT median(q) AS mq, median(m) AS mm FROM x), d AS (SELECT median(abs(q - mq)) AS dq, median(abs(m - mm)) AS dm FROM x, c)
SELECT node, round(greatest(abs(0.6745 * (q - mq) / dq), abs(0.6745 * (m - mm) / dm)), 6) AS anomaly_score FROM x, c, d""",
)
def _(spark, sf):
    found = risk.wallet_anomalies(base_edges(spark, sf), ["chain"])
    return found.select("node", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(
    "a12_all_case_results",
    f"""WITH RECURSIVE {SCORES}{_FINDINGS.removeprefix(GRAPH)}
SELECT 'attributions' AS name, count(*) AS rows_stored, count(DISTINCT case_id) AS cases, count(*) FILTER (WHERE case_id IN ('case3', 'case7')) AS of_two FROM sc
UNION ALL SELECT 'risk_events', count(*), count(DISTINCT case_id), count(*) FILTER (WHERE case_id IN ('case3', 'case7')) FROM fd
UNION ALL SELECT 'snapshots', count(DISTINCT case_id), count(DISTINCT case_id), count(DISTINCT case_id) FILTER (WHERE case_id IN ('case3', 'case7')) FROM ce""",
)
def _(spark, sf):
    """Attributions, risk events and snapshots of all cases, written twice into buckets of the case; two
    cases are read from their buckets."""
    g = traced_graph(spark, sf)
    scores = scoring.score_cases(g.cases, g.nodes, g.edges, g.labels)
    deep = risk.layering(graph.graph_totals(g.nodes, g.edges), g.cases, g.edges, min_depth=2)
    snapshots = evidence.snapshot(g.edges.select("case_id", "transfer_id", "source", "target", "amount", "ts"))
    results = {
        "attributions": scores.select(
            "case_id", F.col("entity").alias("entity_name"), "rank", F.col("score").alias("confidence_score"),
            F.col("band").alias("confidence_band"), "terminal_address",
        ),
        "risk_events": deep.unionByName(risk.exposure(g.nodes, g.edges)),
        "snapshots": snapshots.withColumn("created_at", F.lit(None).cast("timestamp")),
    }
    root = stage_path(spark, "results-db")
    sinks.reset_tables(spark, root, list(results))
    results = {name: stage(rows, name) for name, rows in results.items()}
    for _round in range(2):
        sinks.persist_case_results(spark, root, **results)
    counted = []
    for name in results:
        stored = sinks.stored_table(spark, root, name)
        two = sinks.read_case_results(stored, ["case3", "case7"]).agg(F.count(F.lit(1)).alias("of_two"))
        whole = stored.agg(F.count(F.lit(1)).alias("rows_stored"), F.count_distinct("case_id").alias("cases"))
        counted.append(whole.select(F.lit(name).alias("name"), "rows_stored", "cases", two.scalar().alias("of_two")))
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _digest_of(parts: str, digits: int) -> str:
    """Twin of one step: digest of the digests that share the first digits of the bucket."""
    return f"""SELECT case_id, substr(b, 1, {digits}) AS b, sha256(string_agg(concat_ws(':', b, d, CAST(n AS VARCHAR)), '' ORDER BY concat_ws(':', b, d, CAST(n AS VARCHAR)))) AS d,
  CAST(sum(n) AS BIGINT) AS n FROM {parts} GROUP BY case_id, substr(b, 1, {digits})"""


@query(
    "i1_snapshot_digests",
    f"""WITH RECURSIVE {GRAPH},
texts AS (SELECT case_id, '{{"amount":' || CAST(CAST(amount AS DECIMAL(38,18)) AS VARCHAR) || ',"source":"' || f || '","target":"' || t
  || '","transfer_id":"' || transfer_id || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}' AS x FROM ce),
leaves AS (SELECT case_id, substr(sha256(x), 1, 6) AS b, sha256(x) AS d, count(*) AS n FROM texts GROUP BY case_id, sha256(x)),
six AS ({_digest_of('leaves', 6)}), three AS ({_digest_of('six', 3)}), whole AS ({_digest_of('three', 0)})
SELECT case_id, d AS digest, n AS records FROM whole""",
)
def _(spark, sf):
    """The digests themselves, built again from the rows by another engine."""
    return evidence.snapshot(traced_graph(spark, sf).edges.select("case_id", "transfer_id", "source", "target", "amount", "ts"))


@query(
    "i1_i2_snapshots",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, count(*) AS records, CASE WHEN case_id = 'case0' THEN 'TAMPERED' ELSE 'VALID' END AS integrity
FROM ce GROUP BY case_id""",
)
def _(spark, sf):
    columns = ["case_id", "transfer_id", "source", "target", "amount", "ts"]
    edges = traced_graph(spark, sf).edges.select(*columns)
    stored = evidence.snapshot(edges)
    altered = edges.withColumn(
        "amount",
        F.when(F.col("case_id") == "case0", F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(38,18)"),
    )
    checked = evidence.verify_snapshot(stored, altered)
    return checked.join(stored.select("case_id", "records"), "case_id").select("case_id", "records", "integrity")


@query(
    "i3_evidence_items",
    f"""WITH {TR} SELECT 'ev_' || substr(tr.tx_hash, 1, 10) AS evidence_id, transfer_id, b AS block_number, CAST(amount AS DOUBLE) AS amount, asset_symbol AS asset
FROM tr JOIN (SELECT tx_hash, min(block_number) AS b FROM tr GROUP BY tx_hash) x ON x.tx_hash = tr.tx_hash""",
)
def _(spark, sf):
    transactions = tables.event_transactions(spark, sf).withColumn("fee", F.lit(None).cast("decimal(38,18)"))
    found = evidence.evidence_items(tables.event_transfers(spark, sf), transactions)
    return found.select(
        "evidence_id", "transfer_id", "block_number", F.col("amount").cast("double").alias("amount"), "asset"
    )


@query(
    "d14_factor_evidence",
    f"""WITH RECURSIVE {SCORES}, s AS (SELECT DISTINCT mem.case_id, entity, tx_hash FROM mem JOIN ce ON ce.case_id = mem.case_id AND ce.t = mem.node)
SELECT case_id, entity, count(*) AS transfers FROM s JOIN tr ON tr.tx_hash = s.tx_hash GROUP BY case_id, entity""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    support = scoring.supporting_transactions(g.nodes, g.edges, g.labels)
    found = evidence.factor_evidence(support, tables.event_transfers(spark, sf))
    return found.groupBy("case_id", "entity").agg(F.count(F.lit(1)).alias("transfers"))


@query(
    "i4_case_dossiers",
    f"""WITH RECURSIVE {SCORES}, s AS (SELECT DISTINCT mem.case_id, mem.entity, tx_hash FROM mem JOIN ce ON ce.case_id = mem.case_id AND ce.t = mem.node
  JOIN sc ON sc.case_id = mem.case_id AND sc.entity = mem.entity AND sc.rank = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY tx_hash) AS n FROM s),
h AS (SELECT case_id, string_agg(tx_hash, ',' ORDER BY tx_hash) AS first_transactions FROM k WHERE n <= 5 GROUP BY case_id)
SELECT c.case_id, entity, CAST(score AS DOUBLE) AS score, first_transactions, TRUE AS has_digest
FROM cases c LEFT JOIN sc ON sc.case_id = c.case_id AND rank = 1 LEFT JOIN h ON h.case_id = c.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    result = assess(g, g.labels)
    support = scoring.supporting_transactions(g.nodes, g.edges, g.labels)
    digests = evidence.snapshot(g.edges.select("case_id", "transfer_id", "amount"))
    found = evidence.dossier(g.cases, result.scores, support, result.risk, digests)
    return found.select(
        "case_id",
        "entity",
        "score",
        F.array_join("first_transactions", ",").alias("first_transactions"),
        F.col("digest").isNotNull().alias("has_digest"),
    )

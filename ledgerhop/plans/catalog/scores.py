"""Queries: attribution scores, factors, what-if analysis, evaluation."""

from pyspark.sql import functions as F

from ledgerhop.operators import risk, scoring, sensitivity
from ledgerhop.plans.catalog.registry import GRAPH, LABELS, TR, query
from ledgerhop.plans.catalog.shared import base_edges, labels_table, traced_graph
from ledgerhop.plans.investigate import case_graph
from ledgerhop.sources import bench_tables as tables
from ledgerhop.staging import stage

# Score inputs and scores of the nation cases with the given edge hop.
def _score_sql(hop: str, extra: str = "", weights: str = "") -> str:
    w = dict(entity=30, sweep=25, near=20, volume=15, time=10, mixer=30, bridge=15)
    w.update(dict(kv.split("=") for kv in weights.split()) if weights else {})
    return f"""{GRAPH},
mem AS (SELECT nd.case_id, nd.node, nd.is_root, lb.entity_name AS entity, lb.entity_type AS kind FROM nd JOIN lb ON lb.node = nd.node
  WHERE lb.entity_type LIKE 'VASP%'),
flags AS (SELECT nd.case_id, bool_or(coalesce(lb.entity_type = 'MIXER', FALSE)) AS mix, bool_or(coalesce(lb.entity_type = 'BRIDGE', FALSE)) AS bri
  FROM nd LEFT JOIN lb ON lb.node = nd.node GROUP BY nd.case_id),
flow AS (SELECT c.case_id, coalesce(CAST(sum(amount) AS DOUBLE), 1.0) AS outflow FROM cases c LEFT JOIN ce ON ce.case_id = c.case_id AND ce.f = c.root GROUP BY c.case_id),
ent AS (SELECT case_id, entity, bool_or(kind = 'VASP_DEPOSIT') AS dep, bool_or(kind = 'VASP_HOT') AS hot,
  arg_min(node, (NOT is_root, node)) AS terminal FROM mem GROUP BY case_id, entity),
arr AS (SELECT mem.case_id, entity, min({hop}) AS near, CAST(sum(amount) AS DOUBLE) AS arrived, count(*) AS arrivals
  FROM mem JOIN ce ON ce.case_id = mem.case_id AND ce.t = mem.node GROUP BY mem.case_id, entity),
inp AS (SELECT ent.*, least(4, coalesce(near, 4)) AS min_hop, coalesce(arrived, 0.0) AS arrived, outflow, mix, bri,
  least(1.0, coalesce(arrived, 0.0) / outflow) AS ratio
  FROM ent LEFT JOIN arr ON arr.case_id = ent.case_id AND arr.entity = ent.entity
  JOIN flags ON flags.case_id = ent.case_id JOIN flow ON flow.case_id = ent.case_id),
pts AS (SELECT *, CASE WHEN dep THEN {w['entity']}.0 ELSE 0.0 END AS p1, CASE WHEN hot THEN {w['sweep']}.0 ELSE 0.0 END AS p2,
  greatest(5.0, {w['near']}.0 - 3.0 * min_hop) AS p3, round(ratio * {w['volume']}.0, 1) AS p4, {w['time']}.0 - 2.0 AS p5,
  CASE WHEN mix THEN {w['mixer']}.0 ELSE 0.0 END + CASE WHEN bri THEN {w['bridge']}.0 ELSE 0.0 END AS pen FROM inp),
raw AS (SELECT *, greatest(0.0, least(100.0, CAST(p1 + p2 + p3 + p4 + p5 - pen {extra} AS DOUBLE))) AS s FROM pts),
sc AS (SELECT *, round(s, 1) AS score, CASE WHEN s >= 75 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  row_number() OVER (PARTITION BY case_id ORDER BY round(s, 1) DESC, terminal = 'a' || substr(case_id, 5) DESC, terminal) AS rank FROM raw)"""


SCORES = _score_sql("ce.hop")
CONSTANT = _score_sql("1")

FACTORS = f"""{SCORES},
fac AS (
  SELECT case_id, entity, rank, score, 1 AS position, 'Known Deposit-Wallet Match' AS factor, CAST(p1 AS DOUBLE) AS points, 'POSITIVE' AS kind FROM sc WHERE dep
  UNION ALL SELECT case_id, entity, rank, score, 2, 'Consolidation Sweep Behavior', CAST(p2 AS DOUBLE), 'POSITIVE' FROM sc WHERE hot
  UNION ALL SELECT case_id, entity, rank, score, 3, 'Graph Proximity', CAST(p3 AS DOUBLE), 'POSITIVE' FROM sc
  UNION ALL SELECT case_id, entity, rank, score, 4, 'Flow Volume Strength', CAST(p4 AS DOUBLE), 'POSITIVE' FROM sc
  UNION ALL SELECT case_id, entity, rank, score, 5, 'Temporal Sequence Consistency', CAST(p5 AS DOUBLE), 'POSITIVE' FROM sc
  UNION ALL SELECT case_id, entity, rank, score, 6, 'Mixer Obfuscation Penalty', -30.0, 'PENALTY' FROM sc WHERE mix
  UNION ALL SELECT case_id, entity, rank, score, 7, 'Cross-Chain Bridge Penalty', -15.0, 'PENALTY' FROM sc WHERE bri)"""


def _scores(spark, sf, weights=None, constant=False):
    g = traced_graph(spark, sf, constant_hops=constant)
    return g, scoring.score_cases(g.cases, g.nodes, g.edges, g.labels, weights)


def _factors(spark, sf):
    return scoring.factor_rows(_scores(spark, sf)[1])


@query(
    "g1_entities_and_flags",
    f"""WITH RECURSIVE {SCORES} SELECT case_id, entity, dep AS has_deposit, hot AS has_hot, mix AS has_mixer, bri AS has_bridge FROM inp""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    found = scoring.score_inputs(g.cases, g.nodes, g.edges, g.labels)
    return found.select("case_id", "entity", "has_deposit", "has_hot", "has_mixer", "has_bridge")


@query("g2_root_outflow", f"WITH RECURSIVE {SCORES} SELECT case_id, outflow FROM flow")
def _(spark, sf):
    g = traced_graph(spark, sf)
    return scoring.case_flags(g.cases, g.nodes, g.edges, g.labels).select("case_id", "outflow")


@query(
    "g3_g4_deposit_and_sweep_points",
    f"WITH RECURSIVE {SCORES} SELECT case_id, entity, CAST(p1 AS DOUBLE) AS deposit_points, CAST(p2 AS DOUBLE) AS sweep_points FROM sc",
)
def _(spark, sf):
    return _scores(spark, sf)[1].select("case_id", "entity", "deposit_points", "sweep_points")


@query(
    "g3_supporting_transactions",
    f"""WITH RECURSIVE {SCORES} SELECT mem.case_id, entity, count(DISTINCT tx_hash) AS transactions
FROM mem JOIN ce ON ce.case_id = mem.case_id AND ce.t = mem.node GROUP BY mem.case_id, entity""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    found = scoring.supporting_transactions(g.nodes, g.edges, g.labels)
    return found.groupBy("case_id", "entity").agg(F.count(F.lit(1)).alias("transactions"))


@query(
    "g5_g6_g7_proximity_volume_temporal",
    f"""WITH RECURSIVE {SCORES} SELECT case_id, entity, CAST(min_hop AS INT) AS min_hop, CAST(p3 AS DOUBLE) AS proximity_points,
  CAST(p4 AS DOUBLE) AS volume_points, CAST(p5 AS DOUBLE) AS temporal_points FROM sc""",
)
def _(spark, sf):
    return _scores(spark, sf)[1].select(
        "case_id", "entity", "min_hop", "proximity_points", "volume_points", "temporal_points"
    )


@query(
    "g8_g9_g10_scores",
    f"""WITH RECURSIVE {SCORES} SELECT case_id, entity, CAST(pen AS DOUBLE) AS penalties, CAST(score AS DOUBLE) AS score, band,
  CAST(rank AS INT) AS rank FROM sc""",
)
def _(spark, sf):
    return _scores(spark, sf)[1].select("case_id", "entity", "penalties", "score", "band", "rank")


@query(
    "g9_scores_constant_hops",
    f"WITH RECURSIVE {CONSTANT} SELECT case_id, entity, CAST(score AS DOUBLE) AS score, band, CAST(rank AS INT) AS rank FROM sc",
)
def _(spark, sf):
    return _scores(spark, sf, constant=True)[1].select("case_id", "entity", "score", "band", "rank")


@query(
    "g11_terminal_address",
    f"WITH RECURSIVE {SCORES} SELECT case_id, entity, terminal AS terminal_address FROM sc WHERE rank = 1",
)
def _(spark, sf):
    return _scores(spark, sf)[1].filter("rank = 1").select("case_id", "entity", "terminal_address")


@query(
    "g12_custom_weights",
    f"""WITH RECURSIVE {_score_sql("ce.hop", weights="entity=40 mixer=10 volume=25")}
SELECT case_id, entity, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM sc""",
)
def _(spark, sf):
    weights = {"entity_match": 40.0, "mixer_penalty": 10.0, "flow_volume": 25.0}
    return _scores(spark, sf, weights)[1].select("case_id", "entity", "score", "rank")


@query(
    "g13_factors",
    f"WITH RECURSIVE {FACTORS} SELECT case_id, entity, position, factor, points, kind FROM fac",
)
def _(spark, sf):
    return _factors(spark, sf).select("case_id", "entity", "position", "factor", "points", "kind")


@query(
    "g14_ablation",
    f"""WITH RECURSIVE {FACTORS}, a AS (SELECT *, greatest(0.0, score - points) AS new_score FROM fac WHERE kind = 'POSITIVE' AND points > 0),
b AS (SELECT *, round(score - new_score, 1) AS score_delta FROM a)
SELECT case_id, entity, factor, round(new_score, 3) AS new_score, score_delta,
  CASE WHEN score_delta <= 15 THEN 'ROBUST' WHEN score_delta <= 28 THEN 'MODERATE_DEPENDENCY' ELSE 'HIGH_DEPENDENCY' END AS robustness FROM b""",
)
def _(spark, sf):
    return sensitivity.ablation(_factors(spark, sf)).select(
        "case_id", "entity", "factor", F.round("new_score", 3).alias("new_score"), "score_delta", "robustness"
    )


@query(
    "g15_ablate_set",
    f"""WITH RECURSIVE {SCORES}, x AS (SELECT *, greatest(0.0, CAST(score AS DOUBLE) - p1) AS s1 FROM sc),
y AS (SELECT *, greatest(0.0, s1 - p4) AS s2 FROM x)
SELECT case_id, entity, round(s2, 1) AS simulated_score,
  CASE WHEN s2 >= 80 THEN 'HIGH' WHEN s2 >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS simulated_band FROM y""",
)
def _(spark, sf):
    removed = ["Known Deposit-Wallet Match", "Flow Volume Strength"]
    return sensitivity.ablate_set(_factors(spark, sf), removed).select(
        "case_id", "entity", "simulated_score", "simulated_band"
    )


@query(
    "g16_explanation",
    f"""WITH RECURSIVE {FACTORS} SELECT case_id, entity, factor, points, 'NOT ESTABLISHED' AS beneficiary_identity FROM fac WHERE rank = 1""",
)
def _(spark, sf):
    return scoring.explanation(_scores(spark, sf)[1]).select(
        "case_id", "entity", "factor", "points", "beneficiary_identity"
    )


@query(
    "g17_timed_sweeps",
    f"""WITH {TR}, {LABELS}, o AS (SELECT tr.* FROM tr JOIN lb a ON a.node = f AND a.entity_type = 'VASP_DEPOSIT'
  JOIN lb b ON b.node = t AND b.entity_type = 'VASP_HOT'),
x AS (SELECT o.transfer_id, epoch_us(o.ts) - max(epoch_us(i.ts)) AS held FROM o JOIN tr i ON i.t = o.f AND i.f <> i.t AND i.ts <= o.ts
  GROUP BY o.transfer_id, o.ts)
SELECT transfer_id FROM x WHERE held < 6 * 3600 * 1000000 :: BIGINT""",
)
def _(spark, sf):
    edges = base_edges(spark, sf)
    labels = labels_table(spark, sf)
    found = scoring.sweep_edges_by_time(edges, labels, risk.last_inflow(edges, ["chain"]))
    return found.select("transfer_id")


_SWEPT = SCORES.replace(
    GRAPH,
    f"""{GRAPH},
o AS (SELECT tr.* FROM tr JOIN lb a ON a.node = f AND a.entity_type = 'VASP_DEPOSIT' JOIN lb b ON b.node = t AND b.entity_type = 'VASP_HOT'),
sw AS (SELECT o.transfer_id FROM o JOIN tr i ON i.t = o.f AND i.f <> i.t AND i.ts <= o.ts GROUP BY o.transfer_id, o.ts
  HAVING epoch_us(o.ts) - max(epoch_us(i.ts)) < 6 * 3600 * 1000000 :: BIGINT)""",
).replace("CASE WHEN hot THEN", "CASE WHEN hot OR case_id IN (SELECT ce.case_id FROM ce JOIN sw ON sw.transfer_id = ce.transfer_id) THEN")


@query(
    "g4_scores_with_timed_sweeps",
    f"WITH RECURSIVE {_SWEPT} SELECT case_id, entity, CAST(p2 AS DOUBLE) AS sweep_points, CAST(score AS DOUBLE) AS score FROM sc",
)
def _(spark, sf):
    """The timed rule marks sweep edges before the cases are traced, so every candidate of a swept case scores."""
    edges, labels = base_edges(spark, sf), labels_table(spark, sf)
    swept = stage(
        scoring.sweep_edges_by_time(edges, labels, risk.last_inflow(edges, ["chain"])).select("transfer_id", "is_sweep"), "sweeps"
    )
    marked = edges.join(swept, "transfer_id", "left").withColumn(
        "edge_type", F.when(F.col("is_sweep"), "SWEEP").otherwise(F.col("edge_type"))
    )
    g = case_graph(tables.nation_cases(spark, sf, 3), marked.drop("is_sweep").select(*edges.columns), labels, directions=("outgoing",))
    scores = scoring.score_cases(g.cases, g.nodes, g.edges, g.labels)
    return scores.select("case_id", "entity", "sweep_points", "score")


@query(
    "g18_fan_out_penalty",
    f"""WITH RECURSIVE {SCORES}, wide AS (SELECT case_id, max(n) AS b FROM (SELECT case_id, f, count(*) AS n FROM ce GROUP BY case_id, f) q GROUP BY case_id),
z AS (SELECT sc.case_id, entity, greatest(0.0, least(100.0, CAST(p1 + p2 + p3 + p4 + p5 - pen - CASE WHEN coalesce(b, 0) >= 15 THEN 10.0 ELSE 0.0 END AS DOUBLE))) AS s
  FROM sc LEFT JOIN wide ON wide.case_id = sc.case_id)
SELECT case_id, entity, round(s, 1) AS score FROM z""",
)
def _(spark, sf):
    g, scores = _scores(spark, sf)
    return scoring.fan_out_penalty(scores, g.edges, branches=15).select("case_id", "entity", "score")


@query(
    "g19_alternative_profile",
    f"""WITH RECURSIVE {SCORES}, o AS (SELECT ce.case_id, ce.transfer_id, epoch_us(ce.ts) - max(epoch_us(i.ts)) AS held
  FROM ce JOIN ce i ON i.case_id = ce.case_id AND i.t = ce.f AND i.f <> i.t AND i.ts <= ce.ts GROUP BY ce.case_id, ce.transfer_id, ce.ts),
q AS (SELECT case_id, min(held) / 1000000.0 AS held_seconds FROM o GROUP BY case_id),
z AS (SELECT inp.case_id, entity, CASE WHEN dep THEN 30.0 ELSE 0.0 END + CASE WHEN hot THEN 25.0 ELSE 0.0 END
  + CAST(15.0 AS DOUBLE) / greatest(min_hop, 1) + CASE WHEN held_seconds < 7200 THEN 10.0 ELSE 0.0 END
  + CASE WHEN ratio >= 0.75 THEN 10.0 ELSE 0.0 END AS s FROM inp LEFT JOIN q ON q.case_id = inp.case_id)
SELECT case_id, entity, round(CAST(s AS DOUBLE), 1) AS score FROM z""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    inputs = scoring.score_inputs(g.cases, g.nodes, g.edges, g.labels)
    relay = risk.last_inflow(g.edges, ["case_id"]).groupBy("case_id").agg(
        F.min(risk.held_seconds()).alias("held_seconds")
    )
    return scoring.alternative_profile(inputs, relay).select("case_id", "entity", "score")


@query(
    "g20_sensitivity_matrix",
    f"""WITH RECURSIVE {FACTORS}, rem AS (SELECT case_id, entity, factor AS removed, points FROM fac WHERE kind = 'POSITIVE' AND points > 0),
nm AS (SELECT DISTINCT case_id, removed FROM rem),
gr AS (SELECT sc.case_id, sc.entity, sc.rank, nm.removed, CAST(sc.score AS DOUBLE) AS score, greatest(0.0, CAST(sc.score AS DOUBLE) - coalesce(points, 0.0)) AS new_score
  FROM sc JOIN nm ON nm.case_id = sc.case_id LEFT JOIN rem ON rem.case_id = sc.case_id AND rem.entity = sc.entity AND rem.removed = nm.removed),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, removed ORDER BY new_score DESC, rank) AS new_rank, round(score - new_score, 1) AS d FROM gr)
SELECT case_id, entity, removed, round(new_score, 3) AS new_score, CAST(new_rank AS INT) AS new_rank,
  CASE WHEN d <= 25 AND new_rank = 1 THEN 'ROBUST' WHEN d > 40 AND new_rank > 1 THEN 'HIGHLY_SENSITIVE' ELSE 'MODERATE' END AS assessment FROM rk""",
)
def _(spark, sf):
    return sensitivity.sensitivity_matrix(_factors(spark, sf)).select(
        "case_id", "entity", "removed", F.round("new_score", 3).alias("new_score"), "new_rank", "assessment"
    )


@query(
    "g20_fragility_index",
    f"""WITH RECURSIVE {FACTORS}, a AS (SELECT case_id, entity, CAST(score AS DOUBLE) AS score,
  max(round(score - greatest(0.0, score - points), 1)) AS d FROM fac WHERE kind = 'POSITIVE' AND points > 0 GROUP BY case_id, entity, score)
SELECT case_id, entity, CASE WHEN score > 0 THEN round(d / score, 4) ELSE 0.0 END AS fragility_index FROM a""",
)
def _(spark, sf):
    return sensitivity.fragility(_factors(spark, sf)).select("case_id", "entity", "fragility_index")


# Truth for the evaluation: the nation's own name, minimum 40, a breakpoint for even keys.
def _truth(spark, sf):
    return tables.load(spark, sf, "nation").select(
        F.concat(F.lit("case"), "n_nationkey").alias("case_id"),
        F.col("n_name").alias("ground_truth_vasp"),
        F.lit(30.0).alias("expected_min_score"),
        (F.col("n_nationkey") % 2 == 0).alias("has_breakpoint"),
    )


_EVAL = f"""{SCORES},
og AS (SELECT case_id, f AS node, count(*) AS n FROM ce GROUP BY case_id, f),
bp AS (SELECT DISTINCT nd.case_id FROM nd LEFT JOIN og ON og.case_id = nd.case_id AND og.node = nd.node
  WHERE (coalesce(n, 0) >= 25 AND NOT is_root) OR node_type IN ('MIXER', 'BRIDGE')),
tr0 AS (SELECT 'case' || n_nationkey AS case_id, n_name, n_nationkey % 2 = 0 AS hb FROM nation)"""


@query(
    "g21_benchmark_evaluation",
    f"""WITH RECURSIVE {_EVAL}
SELECT tr0.case_id, entity AS top_entity, coalesce(entity = n_name, FALSE) AS name_match, coalesce(score >= 30, FALSE) AS score_match,
  bp.case_id IS NOT NULL OR NOT hb AS breakpoint_match,
  coalesce(entity = n_name, FALSE) AND coalesce(score >= 30, FALSE) AND (bp.case_id IS NOT NULL OR NOT hb) AS passed
FROM tr0 LEFT JOIN sc ON sc.case_id = tr0.case_id AND rank = 1 LEFT JOIN bp ON bp.case_id = tr0.case_id""",
)
def _(spark, sf):
    g, scores = _scores(spark, sf)
    points = risk.breakpoints(g.nodes, g.edges, fan_out=25)
    return sensitivity.evaluate_benchmark(_truth(spark, sf), scores, points).drop("score")


@query(
    "g22_benchmark_kpis",
    f"""WITH RECURSIVE {_EVAL}, h AS (SELECT sc.case_id, min(rank) AS k FROM sc JOIN tr0 ON tr0.case_id = sc.case_id AND entity = n_name GROUP BY sc.case_id)
SELECT count(*) AS cases, avg(CASE WHEN coalesce(k, 999) = 1 THEN 1.0 ELSE 0.0 END) AS top1_accuracy,
  avg(CASE WHEN coalesce(k, 999) <= 3 THEN 1.0 ELSE 0.0 END) AS top3_accuracy,
  avg(CASE WHEN hb THEN CASE WHEN bp.case_id IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS breakpoint_detection_rate
FROM tr0 LEFT JOIN h ON h.case_id = tr0.case_id LEFT JOIN bp ON bp.case_id = tr0.case_id""",
)
def _(spark, sf):
    g, scores = _scores(spark, sf)
    points = risk.breakpoints(g.nodes, g.edges, fan_out=25)
    return sensitivity.benchmark_kpis(_truth(spark, sf), scores, points)


"""Attribution score per (case, entity) with itemised factors.

Everything is an aggregate over (case, entity) or (case), joined once; edges are read
in one grouped pass for all entities of all cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {
    "entity_match": 30.0,
    "sweep_pattern": 25.0,
    "graph_proximity": 20.0,
    "flow_volume": 15.0,
    "temporal_consistency": 10.0,
    "mixer_penalty": 30.0,
    "bridge_penalty": 15.0,
}
DEPOSIT_TYPES = ["VASP_DEPOSIT", "DEPOSIT_WALLET"]
HOT_TYPES = ["VASP_HOT", "HOT_WALLET"]
SERVICE_TYPES = ["VASP", *DEPOSIT_TYPES, *HOT_TYPES]
HIGH_FROM, MEDIUM_FROM = 75.0, 50.0
FAR_HOP = 4


def band(score: Column, high: float = HIGH_FROM, medium: float = MEDIUM_FROM) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def entity_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Case nodes that belong to a named service; the label base decides, not the node type."""
    known = labels.select(
        "chain",
        "node",
        F.col("entity_name").alias("entity"),
        F.coalesce("entity_type", F.lit("VASP")).alias("label_type"),
    )
    return (
        nodes.select("case_id", "chain", "node", "address", "is_root")
        .join(known, ["chain", "node"])
        .drop("chain")
        .filter(F.col("entity").isNotNull() & F.col("label_type").isin(SERVICE_TYPES))
    )


def case_flags(cases: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per case: mixer and bridge contact, sweep edges, outflow of the root (0 becomes 1)."""
    kinds = (
        nodes.select("case_id", "chain", "node")
        .join(labels.select("chain", "node", "entity_type"), ["chain", "node"])
        .groupBy("case_id")
        .agg(
            F.bool_or(F.col("entity_type") == "MIXER").alias("has_mixer"),
            F.bool_or(F.col("entity_type") == "BRIDGE").alias("has_bridge"),
        )
    )
    flows = (
        edges.join(cases.select("case_id", "root"), "case_id")
        .groupBy("case_id")
        .agg(
            F.bool_or(F.col("edge_type") == "SWEEP").alias("has_sweep_edge"),
            F.sum(F.when(F.col("source") == F.col("root"), F.col("amount"))).alias("outflow"),
        )
    )
    joined = cases.select("case_id").join(kinds, "case_id", "left").join(flows, "case_id", "left")
    no = F.lit(False)
    outflow = F.coalesce(F.col("outflow").cast("double"), F.lit(0.0))
    return joined.select(
        "case_id",
        F.coalesce("has_mixer", no).alias("has_mixer"),
        F.coalesce("has_bridge", no).alias("has_bridge"),
        F.coalesce("has_sweep_edge", no).alias("has_sweep_edge"),
        F.when(outflow == 0, 1.0).otherwise(outflow).alias("outflow"),
    )


def score_inputs(cases: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (case, entity) with the measurements every weight profile uses."""
    members = entity_nodes(nodes, labels)
    order = F.struct(~F.col("is_root"), "node")
    entities = members.groupBy("case_id", "entity").agg(
        F.bool_or(F.col("label_type").isin(DEPOSIT_TYPES)).alias("has_deposit"),
        F.bool_or(F.col("label_type").isin(HOT_TYPES)).alias("has_hot"),
        F.min_by("address", order).alias("terminal_address"),
        F.min(order).alias("first_node"),
    )
    arrivals = (
        edges.join(
            members.select("case_id", F.col("node").alias("target"), "entity"), ["case_id", "target"]
        )
        .groupBy("case_id", "entity")
        .agg(
            F.min("hop").alias("near"),
            F.sum("amount").cast("double").alias("arrived"),
            F.count(F.lit(1)).alias("arrivals"),
        )
    )
    return (
        entities.join(arrivals, ["case_id", "entity"], "left")
        .join(case_flags(cases, nodes, edges, labels), "case_id")
        .withColumn("min_hop", F.least(F.lit(FAR_HOP), F.coalesce("near", F.lit(FAR_HOP))))
        .withColumn("arrived", F.coalesce("arrived", F.lit(0.0)))
        .withColumn("volume_ratio", F.least(F.lit(1.0), F.col("arrived") / F.col("outflow")))
        .drop("near")
    )


def apply_weights(inputs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Points, penalties, score, band and rank for one weight profile."""
    w = {**WEIGHTS, **(weights or {})}
    points = {
        "deposit_points": F.when(F.col("has_deposit"), w["entity_match"]).otherwise(0.0),
        "sweep_points": F.when(
            F.col("has_sweep_edge") | F.col("has_hot"), w["sweep_pattern"]
        ).otherwise(0.0),
        "proximity_points": F.greatest(
            F.lit(5.0), F.lit(w["graph_proximity"]) - F.col("min_hop") * 3.0
        ),
        "volume_points": F.round(F.col("volume_ratio") * w["flow_volume"], 1),
        "temporal_points": F.lit(w["temporal_consistency"] - 2.0),
        "mixer_points": F.when(F.col("has_mixer"), w["mixer_penalty"]).otherwise(0.0),
        "bridge_points": F.when(F.col("has_bridge"), w["bridge_penalty"]).otherwise(0.0),
    }
    scored = inputs.withColumns(points)
    positive = sum(
        (F.col(c) for c in list(points)[1:5]), F.col("deposit_points")
    )
    scored = scored.withColumn("penalties", F.col("mixer_points") + F.col("bridge_points"))
    return _ranked(scored, positive - F.col("penalties"))


def _ranked(scored: DataFrame, raw: Column) -> DataFrame:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    # The candidates of a case are entity names, a bounded list, so a plain window does.
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc("first_node"))
    return (
        scored.withColumn("_clamped", clamped)
        .withColumn("score", F.round("_clamped", 1))
        .withColumn("band", band(F.col("_clamped")))
        .drop("_clamped")
        .withColumn("rank", F.row_number().over(order))
    )


def score_cases(
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    return apply_weights(score_inputs(cases, nodes, edges, labels), weights)


def factor_rows(scores: DataFrame) -> DataFrame:
    """Ordered factor list in long form with points, kind and text."""
    pct = F.format_string("%.1f", F.round(F.col("volume_ratio") * 100, 1))

    def item(position: int, name: str, points: Column, kind: str, text: Column, shown: Column) -> Column:
        return F.when(
            shown,
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("factor"),
                points.alias("points"),
                F.lit(kind).alias("kind"),
                text.alias("description"),
            ),
        )

    always = F.lit(True)
    entity = F.col("entity")
    items = F.array(
        item(1, "Known Deposit-Wallet Match", F.col("deposit_points"), "POSITIVE",
             F.format_string("Destination is a known deposit wallet of %s.", entity), F.col("has_deposit")),
        item(2, "Consolidation Sweep Behavior", F.col("sweep_points"), "POSITIVE",
             F.format_string("Funds are swept into a pooling wallet of %s.", entity),
             F.col("has_sweep_edge") | F.col("has_hot")),
        item(3, "Graph Proximity", F.col("proximity_points"), "POSITIVE",
             F.format_string("Nearest wallet of %s is %d hops away.", entity, F.col("min_hop")), always),
        item(4, "Flow Volume Strength", F.col("volume_points"), "POSITIVE",
             F.format_string("%s%% of the outflow went to %s.", pct, entity), always),
        item(5, "Temporal Sequence Consistency", F.col("temporal_points"), "POSITIVE",
             F.lit("Transfers follow each other forward in time."), always),
        item(6, "Mixer Obfuscation Penalty", -F.col("mixer_points"), "PENALTY",
             F.lit("Funds pass a mixer."), F.col("has_mixer")),
        item(7, "Cross-Chain Bridge Penalty", -F.col("bridge_points"), "PENALTY",
             F.lit("Funds pass a bridge."), F.col("has_bridge")),
    )
    return scores.select(
        "case_id", "entity", "rank", "score", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("f")
    ).select("case_id", "entity", "rank", "score", "f.*")


def supporting_transactions(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct transactions behind the factors of each entity, in long form.

    A service can be reached by any number of transactions, so they are rows, not a list.
    """
    members = entity_nodes(nodes, labels)
    arriving = edges.join(
        members.select("case_id", F.col("node").alias("target"), "entity"), ["case_id", "target"]
    ).select("case_id", "entity", "chain", "tx_hash")
    swept = (
        edges.filter(F.col("edge_type") == "SWEEP")
        .select("case_id", "chain", "tx_hash")
        .distinct()
        .join(members.select("case_id", "entity").distinct(), "case_id")
        .select("case_id", "entity", "chain", "tx_hash")
    )
    return arriving.unionByName(swept).distinct()


def explanation(scores: DataFrame) -> DataFrame:
    """Factors of each case's top candidate, with the fixed operator statement."""
    return (
        factor_rows(scores.filter(F.col("rank") == 1))
        .withColumn("operator_role", F.lit("VASP-Controlled Deposit Infrastructure"))
        .withColumn("beneficiary_identity", F.lit("NOT ESTABLISHED"))
    )


def sweep_edges_by_time(
    edges: DataFrame, labels: DataFrame, last_inflow: DataFrame, hours: float = 6.0
) -> DataFrame:
    """Mark transfers from a deposit to a hot wallet within ``hours`` of the last inflow.

    ``last_inflow`` is the edge table with ``inflow_ts`` (see the risk module).
    """
    kinds = labels.select("chain", "node", "entity_type")
    deposits = kinds.filter(F.col("entity_type").isin(DEPOSIT_TYPES)).select("chain", F.col("node").alias("source"))
    hot = kinds.filter(F.col("entity_type").isin(HOT_TYPES)).select("chain", F.col("node").alias("target"))
    held = (F.unix_micros("ts") - F.unix_micros("inflow_ts")) / 1e6
    return (
        last_inflow.join(deposits, ["chain", "source"], "left_semi")
        .join(hot, ["chain", "target"], "left_semi")
        .filter(held < hours * 3600)
        .withColumn("is_sweep", F.lit(True))
    )


def fan_out_penalty(scores: DataFrame, edges: DataFrame, branches: int = 8, points: float = 10.0) -> DataFrame:
    """Rescore with a penalty for cases where some node has ``branches`` outgoing transfers."""
    wide = (
        edges.groupBy("case_id", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("case_id")
        .agg(F.max("n").alias("_branches"))
    )
    joined = scores.drop("score", "band", "rank").join(wide, "case_id", "left").withColumn(
        "fan_out_points",
        F.when(F.coalesce("_branches", F.lit(0)) >= branches, points).otherwise(0.0),
    )
    positive = (
        F.col("deposit_points")
        + F.col("sweep_points")
        + F.col("proximity_points")
        + F.col("volume_points")
        + F.col("temporal_points")
    )
    return _ranked(joined.drop("_branches"), positive - F.col("penalties") - F.col("fan_out_points"))


def alternative_profile(inputs: DataFrame, relay: DataFrame) -> DataFrame:
    """Second profile: 15 / hops, +10 for relays under two hours, +10 from 75 % of volume.

    ``relay(case_id, held_seconds)``: shortest holding time inside the case.
    """
    joined = inputs.join(relay, "case_id", "left").withColumns(
        {
            "deposit_points": F.when(F.col("has_deposit"), 30.0).otherwise(0.0),
            "sweep_points": F.when(F.col("has_sweep_edge") | F.col("has_hot"), 25.0).otherwise(0.0),
            "proximity_points": F.lit(15.0) / F.greatest(F.col("min_hop"), F.lit(1)),
            "velocity_points": F.when(F.col("held_seconds") < 7200, 10.0).otherwise(0.0),
            "volume_points": F.when(F.col("volume_ratio") >= 0.75, 10.0).otherwise(0.0),
        }
    )
    total = (
        F.col("deposit_points")
        + F.col("sweep_points")
        + F.col("proximity_points")
        + F.col("velocity_points")
        + F.col("volume_points")
    )
    return _ranked(joined, total)

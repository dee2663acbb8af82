"""Whole pipelines for a table of cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.text import address_key, key_chain, trace_direction
from ledgerhop.operators import entities, graph, paths, risk, scoring, trace
from ledgerhop.operators.ordering import top_rows
from ledgerhop.operators.trace import Neighbours
from ledgerhop.staging import stage


@dataclass(frozen=True)
class CaseGraph:
    """Tables of the traced graphs of all cases, written once."""

    cases: DataFrame
    traced: DataFrame
    edges: DataFrame
    nodes: DataFrame
    neighbours: Neighbours
    labels: DataFrame


def _directions(cases: DataFrame, directions: tuple[str, ...] | None) -> tuple[str, ...]:
    """Directions in use: there are three at most, whatever their spellings."""
    if directions is not None:
        return directions
    found = cases.select(trace_direction(F.col("direction"))).distinct().collect()
    return tuple(sorted(r[0] for r in found))


def case_graph(
    cases: DataFrame,
    edges: DataFrame,
    labels: DataFrame,
    max_transactions: int | None = None,
    max_nodes: int | None = None,
    directions: tuple[str, ...] | None = None,
    constant_hops: bool = False,
    with_paths: bool = False,
    max_edges: int | None = None,
) -> CaseGraph:
    """Trace all cases, then build their edge and node tables.

    ``edges`` is the shared edge table; it is read for the neighbour pairs and once more
    for the edges of the expanded nodes.  ``with_paths`` keeps the path of every node.
    ``max_edges`` keeps the first edges of each case by hop, then edge order.
    """
    ways = _directions(cases, directions)
    around = trace.neighbour_table(edges, ways, detail=True)
    traced = trace.trace_with_budget(cases, around, max_transactions, max_nodes, with_paths)
    hit = None
    if max_transactions is not None:
        spent = traced.groupBy("case_id").agg(F.count_distinct("first.tx_hash").alias("n"))
        hit = spent.filter(F.col("n") >= max_transactions).select("case_id")
    bounded = stage(trace.with_boundaries(traced, around, hit), "traced")
    found = trace.trace_edges(edges, bounded, around, ways)
    # Under a budget only edges between collected nodes belong to the case.
    if max_transactions is not None or max_nodes is not None:
        for end in ("source", "target"):
            kept = bounded.select("case_id", F.col("node").alias(end))
            found = found.join(kept, ["case_id", end], "left_semi")
    annotated = graph.annotate_edges(found, bounded, cases, constant_hops)
    if max_edges is not None:
        order = ["hop", *graph.EDGE_ORDER]
        annotated = top_rows(annotated, ["case_id"], order, max_edges, "_nth").drop("_nth")
    case_edges = stage(annotated, "case-edges")
    nodes = graph.node_table(cases, case_edges, labels, bounded)
    return CaseGraph(cases, bounded, case_edges, stage(nodes, "nodes"), around, labels)


def roots(cases: DataFrame) -> DataFrame:
    """Case table with chain, root and direction in the form that tables are joined on."""
    return cases.withColumns(
        {
            "root": address_key(F.col("chain"), F.col("root")),
            "chain": key_chain(F.col("chain")),
            "direction": trace_direction(F.col("direction")),
        }
    )


@dataclass(frozen=True)
class Investigation:
    graph: CaseGraph
    summary: DataFrame
    resolutions: DataFrame
    attributions: DataFrame
    annotated_nodes: DataFrame


def investigate(
    cases: DataFrame,
    transfers: DataFrame,
    labels: DataFrame,
    registry: DataFrame,
    max_transactions: int | None = None,
    max_nodes: int | None = None,
    directions: tuple[str, ...] | None = None,
    max_edges: int | None = None,
    transactions: DataFrame | None = None,
) -> Investigation:
    """Trace, graph, entity resolution and service attribution for every case.

    ``transactions(tx_hash, chain, sender, recipient)`` gives roots without an edge of their own
    the transfers of the transactions that name them.
    """
    keyed = transfers.withColumn("chain", key_chain(F.col("chain")))
    once = graph.distinct_transfers(keyed, ["chain", "transfer_id"], ["ts", "tx_hash"])
    edges = stage(graph.edge_table(once), "edges")
    wanted = roots(cases)
    if transactions is not None:
        keyed = transactions.withColumns(
            {
                "sender": address_key(F.col("chain"), F.col("sender")),
                "recipient": address_key(F.col("chain"), F.col("recipient")),
                "chain": key_chain(F.col("chain")),
            }
        )
        edges = stage(edges.unionByName(trace.fallback_edges(wanted, edges, keyed)), "edges-fallback")
    g = case_graph(
        wanted,
        edges,
        labels,
        max_transactions,
        max_nodes,
        directions=directions,
        with_paths=True,
        max_edges=max_edges,
    )
    summary = trace.trace_summary(g.cases, g.traced, g.edges, max_transactions, max_nodes)
    resolutions = entities.resolve_registry(g.nodes.select("case_id", "chain", "address"), registry)
    trees = paths.with_transfer_ids(g.traced)
    attributions = entities.attribute_services(g.nodes, registry, trees, g.cases)
    annotated = entities.annotate_nodes(g.nodes, registry)
    return Investigation(g, summary, resolutions, attributions, annotated)


@dataclass(frozen=True)
class Assessment:
    scores: DataFrame
    factors: DataFrame
    breakpoints: DataFrame
    findings: DataFrame
    risk: DataFrame


def assess(g: CaseGraph, labels: DataFrame, weights: dict[str, float] | None = None) -> Assessment:
    """Scores, factors, breakpoints and risk of traced cases."""
    scores = scoring.score_cases(g.cases, g.nodes, g.edges, labels, weights)
    totals = graph.graph_totals(g.nodes, g.edges)
    found = risk.findings(totals, g.cases, g.nodes, g.edges)
    return Assessment(
        scores,
        scoring.factor_rows(scores),
        risk.breakpoints(g.nodes, g.edges),
        found,
        risk.risk_summary(g.cases, found),
    )

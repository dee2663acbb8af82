"""Multi-hop tracing of many cases at once.

State is one row per (case, node) with its smallest hop.  Each round joins the newest
nodes with the neighbour table, keeps one row per new node and writes the round to
the shared folder.  A small round is broadcast because its written size is known, so the
neighbour table is scanned where it lies; a large round meets it in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.text import trace_direction
from ledgerhop.operators.graph import EDGE_ORDER
from ledgerhop.operators.ordering import LISTED, first_of_listed, top_rows
from ledgerhop.operators.skew import HOT_ROWS, SALT, SaltedTable, salt_hot_keys, salt_known_keys
from ledgerhop.staging import stage, stage_bucketed, stage_counted

CASE_COLUMNS = ["case_id", "chain", "direction", "max_hops"]
#: Nodes of a round above which the pairs they meet are looked at first.
WIDE_ROUND = 200_000
_EDGE = "struct<ts:timestamp,tx_hash:string,transfer_id:string>"


def _turned(edges: DataFrame, direction: str, any_expand: str) -> DataFrame:
    forward = edges.withColumn("node", F.col("source")).withColumn("nxt", F.col("target"))
    backward = edges.withColumn("node", F.col("target")).withColumn("nxt", F.col("source"))
    if direction == "incoming":
        turned = backward
    elif direction == "any" and any_expand == "both":
        turned = forward.unionByName(backward)
    else:
        turned = forward
    return turned.withColumn("direction", F.lit(direction))


def neighbours(
    edges: DataFrame,
    directions: Sequence[str] = ("outgoing",),
    scope: Sequence[str] = ("chain",),
    detail: bool = False,
    any_expand: str = "to",
) -> DataFrame:
    """Neighbour pairs ``(scope, direction, node, nxt)`` with their number of ``edges``.

    Parallel edges collapse before the shuffle.  ``detail`` adds ``first``, the earliest
    edge of the pair.  Direction ``any`` expands to recipients, or to both sides with
    ``any_expand="both"``.
    """
    turned = reduce(
        DataFrame.unionByName, [_turned(edges, d, any_expand) for d in directions]
    ).filter((F.col("node") != "") & (F.col("nxt") != ""))
    measures = [F.count(F.lit(1)).alias("edges")]
    if detail:
        measures.append(F.min(F.struct(*EDGE_ORDER)).alias("first"))
    return turned.groupBy(*scope, "direction", "node", "nxt").agg(*measures)


@dataclass(frozen=True)
class Neighbours:
    """Neighbour pairs ready to join, and the nodes with many edges.

    ``busy`` lists (scope, direction, node) with more than ``hot_rows`` edges, None when
    there are none; it salts the edge table without another pass over it.
    """

    pairs: SaltedTable
    busy: DataFrame | None


def neighbour_table(
    edges: DataFrame,
    directions: Sequence[str] = ("outgoing",),
    scope: Sequence[str] = ("chain",),
    detail: bool = False,
    any_expand: str = "to",
    hot_rows: int = HOT_ROWS,
    buckets: int | None = None,
) -> Neighbours:
    """The neighbour pairs written once, with hot nodes spread over salts.

    The number of edges is summed while writing.  No node can be hot when all edges
    together are fewer than ``hot_rows``; only then the search for hot nodes is skipped.

    ``buckets`` writes the pairs a second time, bucketed on the join keys.  It pays for
    deep traces of many cases: rounds too large to broadcast then shuffle only themselves,
    not the pairs.
    """
    keys = [*scope, "direction", "node"]
    pairs, total = stage_counted(
        neighbours(edges, directions, scope, detail, any_expand), "pairs", F.sum("edges")
    )
    busy = wide = None
    if total > hot_rows:
        loads = pairs.groupBy(*keys).agg(
            F.sum("edges").alias("_edges"), F.count(F.lit(1)).alias("_pairs")
        )
        found, rows = stage_counted(loads.filter(F.col("_edges") > hot_rows), "busy-nodes")
        if rows:
            busy = found.select(*keys, F.lit(True).alias("_hot"))
            wide = found.filter(F.col("_pairs") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    salted = salt_known_keys(pairs.drop("edges"), keys, ["nxt"], wide)
    if buckets is not None:
        joined_on = [*keys, SALT] if wide is not None else keys
        table = stage_bucketed(salted.table, "pairs-bucketed", joined_on, buckets)
        salted = replace(salted, table=table)
    return Neighbours(salted, busy)


def start_nodes(cases: DataFrame) -> DataFrame:
    """Roots with hop 0; directions in one spelling."""
    way = trace_direction(F.col("direction")).alias("direction")
    columns = [way if c == "direction" else F.col(c) for c in CASE_COLUMNS]
    return cases.select(*columns, F.col("root").alias("node"), F.lit(0).alias("hop"))


def trace_nodes(cases: DataFrame, neighbours: Neighbours) -> DataFrame:
    """Every node within ``max_hops`` of a case root with its smallest hop.

    ``cases(case_id, chain, root, direction, max_hops)``.  Runs as many rounds as the
    deepest case needs.
    """
    visited = frontier = stage(start_nodes(cases), "hop0")
    open_ends = 0
    for hop in count(1):
        probe, pairs = frontier.filter(F.col("max_hops") >= hop), neighbours.pairs
        if open_ends > WIDE_ROUND:
            probe, pairs = _by_case(probe, pairs)
        reached = pairs.join(probe).select(*CASE_COLUMNS, F.col("nxt").alias("node")).distinct()
        # The columns of a case hang on its id; joining on all of them keeps the partitioning of
        # the distinct rows, so a round has one shuffle.
        fresh = reached.join(visited.select(*CASE_COLUMNS, "node"), [*CASE_COLUMNS, "node"], "left_anti")
        frontier, open_ends = stage_counted(
            fresh.select(*CASE_COLUMNS, "node", F.lit(hop).alias("hop")),
            f"hop{hop}",
            F.count_if(F.col("max_hops") > hop),
        )
        visited = visited.unionByName(frontier)
        if open_ends == 0:
            break
    return visited


def _by_case(probe: DataFrame, pairs: SaltedTable) -> tuple[DataFrame, SaltedTable]:
    """The nodes of a large round dealt by case, if few pairs leave them.

    A join dealt by node has each new node of a case in as many tasks as lead to it, so no task can combine them.
    When many cases meet at few nodes, the pairs of those nodes are short enough to be broadcast, and the rows of
    a case stay together; large cases are split by size.
    """
    met = pairs.table.join(probe.select(*pairs.keys).distinct(), list(pairs.keys), "left_semi")
    onward, n = stage_counted(met, "met-pairs")
    if n > LISTED:
        return probe, pairs
    return probe.hint("rebalance", "case_id"), replace(pairs, table=onward)


def trace_with_budget(
    cases: DataFrame,
    neighbours: Neighbours,
    max_transactions: int | None = None,
    max_nodes: int | None = None,
    paths: bool = False,
) -> DataFrame:
    """As :func:`trace_nodes`, with the edge ``first`` that reached each node, and budgets.

    A transaction is spent for each unseen hash that reaches a new node.  Inside a hop
    the order is (time, hash, id), so a binding budget gives the same result every run.

    ``paths`` adds ``path`` and ``steps`` (its edges).  Among shortest paths the smallest
    sequence of edges wins, which equals visiting nodes in queue order and edges in edge
    order.  The arrays have one element per hop.
    """
    start = start_nodes(cases).withColumn("first", F.lit(None).cast(_EDGE))
    carried = []
    if paths:
        carried = ["path", "steps"]
        start = start.withColumn("path", F.array("node")).withColumn(
            "steps", F.array().cast(f"array<{_EDGE}>")
        )
    visited = frontier = stage(start, "hop0")
    best = F.min(
        F.struct(
            F.concat("steps", F.array("first")).alias("steps"),
            F.concat("path", F.array("nxt")).alias("path"),
        )
    ) if paths else None
    for hop in count(1):
        probe = frontier.filter(F.col("max_hops") >= hop).select(*CASE_COLUMNS, "node", *carried)
        measures = [F.min("first").alias("first")]
        if best is not None:
            measures.append(best.alias("_best"))
        reached = (
            neighbours.pairs.join(probe)
            .groupBy(*CASE_COLUMNS, F.col("nxt").alias("node"))
            .agg(*measures)
        )
        fresh = reached.join(visited.select(*CASE_COLUMNS, "node"), [*CASE_COLUMNS, "node"], "left_anti")
        fresh = fresh.withColumn("hop", F.lit(hop))
        if best is not None:
            fresh = fresh.select("*", "_best.path", "_best.steps").drop("_best")
        if max_transactions is not None:
            fresh = _within_transactions(stage(fresh, "reached"), visited, max_transactions)
        if max_nodes is not None:
            fresh = _within_nodes(fresh, visited, max_nodes)
        frontier, open_ends = stage_counted(
            fresh.select(*visited.columns), f"hop{hop}", F.count_if(F.col("max_hops") > hop)
        )
        visited = visited.unionByName(frontier)
        if open_ends == 0:
            break
    return visited


def _within_transactions(fresh: DataFrame, visited: DataFrame, budget: int) -> DataFrame:
    tx = F.col("first.tx_hash")
    spent = visited.filter(F.col("first").isNotNull()).select("case_id", tx.alias("tx")).distinct()
    used = spent.groupBy("case_id").agg(F.count(F.lit(1)).alias("_used"))
    wanted = (
        fresh.groupBy("case_id", tx.alias("tx"))
        .agg(F.min("first").alias("_at"))
        .join(spent, ["case_id", "tx"], "left_anti")
    )
    bought = (
        top_rows(wanted, ["case_id"], ["_at"], budget, "_rank")
        .join(used, "case_id", "left")
        .filter(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= budget)
        .select("case_id", "tx")
    )
    paid = bought.unionByName(spent)
    return fresh.withColumn("tx", tx).join(paid, ["case_id", "tx"], "left_semi").drop("tx")


def _within_nodes(fresh: DataFrame, visited: DataFrame, budget: int) -> DataFrame:
    held = visited.groupBy("case_id").agg(F.count(F.lit(1)).alias("_held"))
    return (
        top_rows(fresh, ["case_id"], ["first", "node"], budget, "_rank")
        .join(held, "case_id", "left")
        .filter(F.col("_rank") + F.coalesce("_held", F.lit(0)) <= budget)
        .drop("_rank", "_held")
    )


def trace_edges(
    edges: DataFrame,
    traced: DataFrame,
    neighbours: Neighbours,
    directions: Sequence[str] = ("outgoing", "incoming", "any"),
) -> DataFrame:
    """Edges leaving every expanded node (``hop < max_hops``) in its case's direction.

    In directed traces an edge has one near end, so it comes once per case.  Direction
    ``any`` looks at both ends and drops the second copy.  Naming the directions in use
    saves the reads for the others; ``neighbours`` knows the busy nodes of the edges.
    """
    columns = ["case_id", "chain", "direction", "node"]
    if "boundary_reason" in traced.columns and "any" not in directions:
        # The near end is the one that is joined here, so what annotate_edges wants of it comes along.
        traced = traced.withColumn("_near_cut", F.col("boundary_reason").isNotNull())
        columns.append("_near_cut")
    expanded = traced.filter(F.col("hop") < F.col("max_hops")).select(*columns)
    busy = None
    if neighbours.busy is not None:
        busy = neighbours.busy.select("chain", "node", "_hot").distinct()
    sides = []
    for end, ways in (("source", ("outgoing", "any")), ("target", ("incoming", "any"))):
        used = [w for w in ways if w in directions]
        if used:
            table = salt_known_keys(
                edges.withColumn("node", F.col(end)), ["chain", "node"], ["transfer_id"], busy
            )
            probe = expanded.filter(F.col("direction").isin(used)).drop("direction")
            sides.append(table.join(probe).drop("node"))
    if "any" in directions:
        return _edges_once(*sides, edges, expanded.filter(F.col("direction") == "any"))
    return reduce(DataFrame.unionByName, sides)


def _edges_once(by_source: DataFrame, by_target: DataFrame, edges: DataFrame, both: DataFrame) -> DataFrame:
    """Edges found by either end, each transfer once per case; ``both`` has the nodes looked at from both ends.

    An edge whose source is such a node is there already, so it is left out of the other side before anything
    moves; only transfer ids that repeat among the edges are grouped.
    """
    seen = both.select("case_id", "chain", F.col("node").alias("source"))
    rest = by_target.join(seen, ["case_id", "chain", "source"], "left_anti")
    counts = edges.groupBy("transfer_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("transfer_id")
    repeated, n = stage_counted(counts, "repeated-ids")
    return first_of_listed(by_source.unionByName(rest), ["case_id", "transfer_id"], ["ts", "tx_hash"], repeated, n)


def fallback_edges(cases: DataFrame, edges: DataFrame, transactions: DataFrame) -> DataFrame:
    """Edges of the transactions sent (or received) by roots that have no edge of their own.

    ``transactions(tx_hash, chain, sender, recipient)``.  The result starts at the root,
    so it can be added to the edges before the neighbour table is built.
    """
    incoming = F.col("direction") == "incoming"
    way = trace_direction(F.col("direction")).alias("direction")
    roots = cases.select("chain", "root", way).distinct()
    touched = edges.select("chain", F.col("source").alias("root"), F.lit(False).alias("_in")).union(
        edges.select("chain", F.col("target"), F.lit(True))
    )
    lonely = roots.join(
        touched,
        (roots.chain == touched.chain)
        & (roots.root == touched.root)
        & ((F.col("direction") == "any") | (incoming == F.col("_in"))),
        "left_anti",
    )
    sides = transactions.select(
        "tx_hash",
        "chain",
        F.explode(
            F.array(
                F.struct(F.col("sender").alias("root"), F.lit(False).alias("_in")),
                F.struct(F.col("recipient").alias("root"), F.lit(True).alias("_in")),
            )
        ).alias("s"),
    ).select("tx_hash", "chain", "s.*")
    own = lonely.join(sides, ["chain", "root"]).filter(
        (F.col("direction") == "any") | (incoming == F.col("_in"))
    )
    picked = own.select("chain", "tx_hash", "root", "direction").distinct()
    found = edges.join(picked, ["chain", "tx_hash"])
    return found.select(
        *[
            F.when(~incoming, F.col("root")).otherwise(F.col("source")).alias("source")
            if c == "source"
            else F.when(incoming, F.col("root")).otherwise(F.col("target")).alias("target")
            if c == "target"
            else F.col(c)
            for c in edges.columns
        ]
    )


def with_boundaries(
    traced: DataFrame, neighbours: Neighbours, budget_hit: DataFrame | None = None
) -> DataFrame:
    """Add ``boundary_reason`` to nodes whose onward edges were not followed.

    ``budget_hit(case_id)`` lists cases stopped by a budget.
    """
    pairs = neighbours.pairs
    onward = pairs.table.select(*pairs.keys).distinct()
    open_end = traced.join(onward, list(pairs.keys), "left_semi").filter(
        F.col("hop") >= F.col("max_hops")
    ).select("case_id", "node", F.lit("MAX_HOPS_REACHED").alias("boundary_reason"))
    marked = traced.join(open_end, ["case_id", "node"], "left")
    if budget_hit is None:
        return marked
    last = traced.groupBy("case_id").agg(F.max("hop").alias("_last"))
    cut = budget_hit.join(last, "case_id")
    return (
        marked.join(cut, "case_id", "left")
        .withColumn(
            "boundary_reason",
            F.when(F.col("hop") == F.col("_last"), "TRANSACTION_LIMIT_REACHED").otherwise(
                F.col("boundary_reason")
            ),
        )
        .drop("_last")
    )


def trace_summary(
    cases: DataFrame,
    traced: DataFrame,
    edges: DataFrame,
    max_transactions: int | None = None,
    max_nodes: int | None = None,
) -> DataFrame:
    """One row per case: sizes, depth reached and why the trace ended.

    ``traced`` comes from :func:`trace_with_budget`.  Cases without any edge are kept
    with the single root node and reason ``EMPTY_WALLET``.
    """
    found = traced.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max("hop").alias("hops"),
        F.count_distinct("first.tx_hash").alias("transactions"),
    )
    moved = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("edges"))
    joined = cases.join(found, "case_id", "left").join(moved, "case_id", "left")
    edges_n = F.coalesce("edges", F.lit(0))
    nodes_n, tx_n = F.coalesce("nodes", F.lit(1)), F.coalesce("transactions", F.lit(0))
    hops = F.coalesce("hops", F.lit(0))
    limited = F.lit(False)
    if max_transactions is not None:
        limited = limited | (tx_n >= max_transactions)
    if max_nodes is not None:
        limited = limited | (nodes_n >= max_nodes)
    depth = F.when((hops == 0) & (edges_n > 0), 1).otherwise(hops)
    reason = (
        F.when(edges_n == 0, "EMPTY_WALLET")
        .when(limited, "TRANSACTION_LIMIT_REACHED")
        .when(depth >= F.col("max_hops"), "MAX_HOPS_REACHED")
        .otherwise("NATURAL_TERMINATION")
    )
    return joined.select(
        "case_id",
        "direction",
        "max_hops",
        nodes_n.alias("nodes"),
        edges_n.alias("edges"),
        tx_n.alias("transactions"),
        depth.alias("hops"),
        limited.alias("limit_reached"),
        reason.alias("termination_reason"),
    )


def hop_layers(traced: DataFrame) -> DataFrame:
    return traced.groupBy("case_id", "hop").agg(F.count(F.lit(1)).alias("nodes"))


def subgraph(
    edges: DataFrame,
    traced: DataFrame,
    neighbours: Neighbours,
    directions: Sequence[str] = ("outgoing",),
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges a traversal touched."""
    found = trace_edges(edges, traced, neighbours, directions)
    return traced.select("case_id", "node", "hop"), found


def forward_closure(edges: DataFrame, roots: DataFrame, rounds: int = 5) -> DataFrame:
    """Edges that touch any node reachable from a root within ``rounds`` forward steps.

    ``roots(case_id, chain, root)``; an edge is returned once per case.
    """
    cases = roots.select(
        "case_id", "chain", "root", F.lit("outgoing").alias("direction"), F.lit(rounds).alias("max_hops")
    )
    reached = trace_nodes(cases, neighbour_table(edges)).select("case_id", "chain", "node")
    ends = [
        salt_hot_keys(edges.withColumn("node", F.col(end)), ["chain", "node"], ["transfer_id"])
        .join(reached)
        .drop("node")
        for end in ("source", "target")
    ]
    return _edges_once(*ends, edges, reached)

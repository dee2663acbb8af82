"""Edge and node tables of the fund-flow multigraph, keyed by ``case_id``.

Order of edges everywhere: (``ts``, ``tx_hash``, ``transfer_id``), NULL times first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.text import address_key, filled, key_chain, trace_direction
from ledgerhop.operators.ordering import HOT_ROWS, LISTED, first_of_repeats, row_numbers, row_numbers_upto
from ledgerhop.staging import stage, stage_counted

EDGE_ORDER = ["ts", "tx_hash", "transfer_id"]


def edge_table(transfers: DataFrame, fold_all: bool = False, native: str = "ETH") -> DataFrame:
    """Project transfers to edges: join keys, defaults, edge type."""
    sweep = F.col("is_sweep") if "is_sweep" in transfers.columns else F.lit(False)
    symbol = F.coalesce(filled(F.col("asset_symbol")), F.lit(native))
    evidence = F.concat(F.lit("ev_"), F.substring("tx_hash", 1, 10))
    keep = ["case_id"] if "case_id" in transfers.columns else []
    return transfers.select(
        *keep,
        "transfer_id",
        "tx_hash",
        key_chain(F.col("chain")).alias("chain"),
        address_key(F.col("chain"), F.col("from_address"), fold_all).alias("source"),
        address_key(F.col("chain"), F.col("to_address"), fold_all).alias("target"),
        "from_address",
        "to_address",
        F.coalesce(filled(F.col("asset_id")), symbol).alias("asset_id"),
        symbol.alias("asset_symbol"),
        "amount",
        "ts",
        F.upper("transfer_type").alias("transfer_type"),
        F.when(sweep, "SWEEP").otherwise("TRANSFER").alias("edge_type"),
        F.coalesce(filled(F.col("evidence_ref")), evidence).alias("evidence_ref"),
        "transfer_index",
    )


def distinct_transfers(transfers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per transfer id; ids are counted alone, only repeats move as whole rows."""
    return first_of_repeats(transfers, keys, order)


def unique_edge_keys(edges: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Add ``edge_key``: the transfer id, for repeats ``{tx}_{index}``, then a running number.

    ``order`` must be unique per ``scope`` and decides which copy keeps the plain id.
    Ids seen once, usually nearly all, only meet the list of repeated ids; where that list is
    long all edges are numbered in one shuffle.  Numbering is a window, or goes over range
    partitions when one id has very many copies.  Numbered and renamed edges are written once.
    """
    by_position = F.concat_ws("_", "tx_hash", "transfer_index")
    key = [*scope, "_key"]
    plain = edges.withColumn("_key", F.coalesce(filled(F.col("transfer_id")), by_position))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])  # NULL is no scope, nothing repeats in it
    counts = plain.filter(whole).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated, largest = stage_counted(counts, "repeats", F.max("_n"))
    if not largest:
        return plain.withColumn("edge_key", F.col("_key")).drop("_key")
    if repeated.count() > LISTED:
        alone, several = plain.filter(~whole), plain.filter(whole)
    else:
        alone, several = plain.join(repeated, key, "left_anti"), plain.join(repeated, key, "left_semi")
    copies, moved = stage_counted(
        row_numbers_upto(several, key, order, "_copy", largest), "copies", F.count_if(F.col("_copy") > 1)
    )
    first = copies.filter("_copy = 1").drop("_copy")
    later = copies.filter("_copy > 1").withColumn("_key", by_position)
    # A position may itself be the plain id of another edge; then numbering starts at 2.
    held = (
        alone.select(*key)
        .unionByName(first.select(*key))
        .join(later.select(*key).distinct(), key, "left_semi")
        .withColumn("_held", F.lit(1))
    )
    if moved > HOT_ROWS:
        moved = later.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    again = row_numbers_upto(later, key, ["_copy", *order], "_again", moved)
    numbered = again.join(held, key, "left")
    number = F.col("_again") + F.coalesce("_held", F.lit(0))
    named = numbered.withColumn(
        "edge_key",
        F.when(number == 1, F.col("_key")).otherwise(F.concat_ws("_", "_key", number.cast("string"))),
    )
    kept = alone.unionByName(first).withColumn("edge_key", F.col("_key"))
    named = stage(named.drop("_copy", "_again", "_held"), "named")
    return kept.unionByName(_apart(named, plain.select(*key), scope, order)).drop("_key")


def _apart(named: DataFrame, plain: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Made-up keys that some edge has as its own id, or that were made twice, get a digest of
    their order columns behind them."""
    zero, one = F.lit(0), F.lit(1)
    numbered = (F.col("edge_key") != F.col("_key")).cast("int")
    made = named.select(*scope, "edge_key", zero.alias("own"), one.alias("made"), numbered.alias("numbered"))
    own = plain.select(*scope, F.col("_key").alias("edge_key"), one.alias("own"), zero.alias("made"), zero.alias("numbered"))
    seen = made.unionByName(own).groupBy(*scope, "edge_key").agg(
        F.max("own").alias("own"), F.sum("made").alias("made"), F.max("numbered").alias("numbered")
    )
    clash, found = stage_counted(
        seen.filter("made > 1 or own = 1 and numbered = 1").select(*scope, "edge_key", F.lit(True).alias("_clash")), "clash"
    )
    if not found:
        return named
    tail = F.hex(F.xxhash64(*order))
    return named.join(clash, [*scope, "edge_key"], "left").withColumn(
        "edge_key", F.when(F.col("_clash"), F.concat_ws("~", "edge_key", tail)).otherwise(F.col("edge_key"))
    ).drop("_clash")


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: ``node`` key, spelling, side, and the edge order columns."""
    keep = ["case_id"] if "case_id" in edges.columns else []
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("node"), F.col("from_address").alias("address"), F.lit(0).alias("side")),
            F.struct(F.col("target").alias("node"), F.col("to_address").alias("address"), F.lit(1).alias("side")),
        )
    )
    return edges.select(*keep, "chain", *EDGE_ORDER, ends.alias("e")).select(
        *keep, "chain", *EDGE_ORDER, "e.*"
    )


def node_table(
    cases: DataFrame, edges: DataFrame, labels: DataFrame, traced: DataFrame | None = None
) -> DataFrame:
    """Nodes of every case: its root plus all edge ends.

    ``cases(case_id, chain, root)``; ``labels(chain, node, entity_name, entity_type,
    confidence)`` with one row per (chain, node); ``traced(case_id, node, hop, boundary_reason)`` supplies hops.
    The spelling first seen in edge order is kept as ``address``.
    """
    seen = edge_ends(edges).groupBy("case_id", "chain", "node").agg(
        F.min_by("address", F.struct(*EDGE_ORDER, "side")).alias("address")
    )
    roots = cases.select("case_id", "chain", F.col("root").alias("node"), F.lit(True).alias("is_root"))
    joined = seen.join(roots, ["case_id", "chain", "node"], "full").withColumn(
        "is_root", F.coalesce("is_root", F.lit(False))
    )
    named = joined.join(
        labels.select("chain", "node", "entity_name", "entity_type", "confidence"), ["chain", "node"], "left"
    )
    root = F.col("is_root")
    nodes = named.select(
        "case_id",
        "chain",
        "node",
        F.coalesce("address", "node").alias("address"),
        "is_root",
        F.when(root, "SUSPECT")
        .otherwise(F.coalesce("entity_type", F.lit("INTERMEDIARY")))
        .alias("node_type"),
        F.when(root, "Suspect Wallet").otherwise(F.col("entity_name")).alias("label"),
        F.when(~root, F.col("entity_name")).alias("entity_name"),
        F.when(root, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
    )
    if traced is None:
        return nodes
    hops = traced.select("case_id", "node", "hop", "boundary_reason")
    return (
        nodes.join(hops, ["case_id", "node"], "left")
        .withColumn("hop", F.coalesce("hop", F.when(root, 0).otherwise(1)))
        .withColumn("is_boundary", F.col("boundary_reason").isNotNull())
    )


def edge_hop(far_hop: Column, far_is_root: Column) -> Column:
    """Hop of an edge: that of its far end, 1 when unknown; 0 only at the root."""
    hop = F.coalesce(far_hop, F.lit(1))
    return F.when((hop == 0) & ~far_is_root, 1).otherwise(hop)


def annotate_edges(edges: DataFrame, traced: DataFrame, cases: DataFrame, constant: bool = False) -> DataFrame:
    """Add ``hop`` and ``is_boundary`` to case edges.

    The far end is the target, or the source in incoming cases.  Edges that bring ``_near_cut`` along (whether
    the near end is a boundary, as traced edges do) are joined with their far ends only.  ``constant`` gives
    every edge hop 1, which is what scoring without a hop table sees.
    """
    if constant:
        return edges.drop("_near_cut").withColumn("hop", F.lit(1)).withColumn("is_boundary", F.lit(False))
    about = cases.select("case_id", "root", trace_direction(F.col("direction")).alias("_way"))
    incoming = F.col("_way") == "incoming"
    far = F.when(incoming, F.col("source")).otherwise(F.col("target"))
    near = F.when(incoming, F.col("target")).otherwise(F.col("source"))
    hops = traced.select(
        "case_id",
        F.col("node"),
        F.col("hop"),
        F.col("boundary_reason").isNotNull().alias("_edge_of_trace"),
    )
    far_hops = hops.select("case_id", F.col("node").alias("_far"), F.col("hop").alias("_far_hop"), F.col("_edge_of_trace").alias("_far_cut"))
    placed = edges.join(about, "case_id").withColumn("_far", far).join(far_hops, ["case_id", "_far"], "left")
    if "_near_cut" not in edges.columns:
        near_hops = hops.select("case_id", F.col("node").alias("_near"), F.col("_edge_of_trace").alias("_near_cut"))
        placed = placed.withColumn("_near", near).join(near_hops, ["case_id", "_near"], "left").drop("_near")
    return (
        placed.withColumn("hop", edge_hop(F.col("_far_hop"), F.col("_far") == F.col("root")))
        .withColumn(
            "is_boundary",
            F.coalesce("_far_cut", F.lit(False)) | F.coalesce("_near_cut", F.lit(False)),
        )
        .drop("_far", "_far_hop", "_far_cut", "_near_cut", "_way", "root")
    )


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Deterministic ``node_order``: the root first, then by node key."""
    return row_numbers(nodes, ["case_id"], [F.desc("is_root"), F.asc("node")], "node_order")


def number_edges(edges: DataFrame) -> DataFrame:
    """Deterministic ``edge_order`` by time, hash and id; equal rows fall back to the key."""
    return row_numbers(edges, ["case_id"], [*EDGE_ORDER, *(["edge_key"] if "edge_key" in edges.columns else [])], "edge_order")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case: node and edge counts and the depth (1 at least when there are edges)."""
    sizes = nodes.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.coalesce(F.max(F.when(~F.col("is_boundary"), F.col("hop"))), F.lit(0)).alias("_depth"),
    )
    counts = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("total_edges"))
    total = F.coalesce("total_edges", F.lit(0))
    return sizes.join(counts, "case_id", "left").select(
        "case_id",
        "total_nodes",
        total.alias("total_edges"),
        F.when((F.col("_depth") == 0) & (total > 0), 1).otherwise(F.col("_depth")).alias("hop_depth"),
    )


def asset_volumes(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "asset_symbol").agg(
        F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("transfers")
    )


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """In and out degree per node, counting parallel edges: one aggregate over both ends."""
    ends = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    return ends.groupBy(*keys, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


def collapse_hubs(edges: DataFrame, degree_above: int, names: DataFrame, scope: list[str]) -> DataFrame:
    """Replace nodes with more than ``degree_above`` edges by one cluster node per entity.

    ``names(chain, node, entity_name)``; hubs without a name keep their own key.  Parallel
    edges between the new ends are combined per asset.
    """
    hubs = (
        degrees(edges, scope)
        .filter(F.col("in_degree") + F.col("out_degree") > degree_above)
        .join(names.select("chain", "node", "entity_name"), ["chain", "node"], "left")
        .select(*scope, "node", F.concat(F.lit("hub:"), F.coalesce("entity_name", "node")).alias("cluster"))
    )
    ends = edges
    for end in ("source", "target"):
        as_end = hubs.select(*scope, F.col("node").alias(end), F.col("cluster").alias(f"_{end}"))
        ends = ends.join(as_end, [*scope, end], "left").withColumn(
            end, F.coalesce(f"_{end}", end)
        ).drop(f"_{end}")
    return ends.groupBy(*scope, "source", "target", "asset_symbol").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("transfers")
    )

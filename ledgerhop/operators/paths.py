"""Paths from case roots: breadth-first ones with arrays that grow by a node per round, cheapest ones by
relaxation with parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.operators.skew import salt_hot_keys
from ledgerhop.operators.trace import CASE_COLUMNS, Neighbours, trace_with_budget
from ledgerhop.staging import stage, stage_counted



def path_trees(cases: DataFrame, neighbours: Neighbours) -> DataFrame:
    """Breadth-first path from the root to every node of a case, with transfer ids.

    One run serves all targets of all cases.  ``neighbours`` needs the ``first`` edges.
    """
    return with_transfer_ids(trace_with_budget(cases, neighbours, paths=True))


def with_transfer_ids(traced: DataFrame) -> DataFrame:
    return traced.withColumn("transfer_ids", F.col("steps.transfer_id")).drop("steps", "first")


def shortest_paths(trees: DataFrame, targets: DataFrame) -> DataFrame:
    """Shortest path per ``targets(case_id, node)``; NULL path when unreachable."""
    return targets.join(
        trees.select("case_id", "node", "hop", "path", "transfer_ids"), ["case_id", "node"], "left"
    )


def attribution_paths(trees: DataFrame, cases: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`shortest_paths`; an unreachable target gets ``[root, target]`` and no ids."""
    roots = cases.select("case_id", "root")
    found = shortest_paths(trees, targets).join(roots, "case_id")
    return found.select(
        "case_id",
        "node",
        "hop",
        F.coalesce("path", F.array("root", "node")).alias("path"),
        F.coalesce("transfer_ids", F.array().cast("array<string>")).alias("transfer_ids"),
    )


def path_listing(trees: DataFrame, neighbours: Neighbours) -> DataFrame:
    """One path per explored neighbour pair whose end is not on the branch yet."""
    ahead = neighbours.pairs.join(
        trees.filter(F.col("hop") < F.col("max_hops")).select(*CASE_COLUMNS, "node", "path")
    )
    return ahead.filter(~F.array_contains("path", F.col("nxt"))).select(
        "case_id", F.concat("path", F.array("nxt")).alias("path")
    )


def cycle_edges(case_edges: DataFrame, trees: DataFrame) -> DataFrame:
    """Add ``is_cycle``: the edge leads back to a node on the path to its source."""
    near = trees.select(
        "case_id", F.col("node").alias("source"), F.col("path").alias("_path")
    )
    return case_edges.join(near, ["case_id", "source"], "left").withColumn(
        "is_cycle", F.coalesce(F.array_contains("_path", F.col("target")), F.lit(False))
    ).drop("_path")


def value_pairs(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Largest parallel amount per ordered pair and its cost ``1 / amount``."""
    best = edges.groupBy(*scope, F.col("source").alias("node"), F.col("target").alias("nxt")).agg(
        F.max("amount").alias("amount")
    )
    value = F.col("amount").cast("double")
    return best.withColumn("value", F.when(value > 0, value).otherwise(F.lit(0.00001))).withColumn(
        "cost", F.lit(1.0) / F.col("value")
    )


#: Deltas of the relaxation are merged into one table after so many rounds.
MERGE_ROUNDS = 8


def highest_value_paths(
    cases: DataFrame, edges: DataFrame, scope: list[str] | None = None, bottleneck: bool = False
) -> DataFrame:
    """Cheapest path from each root to every node by the sum of ``1 / amount``.

    ``bottleneck`` ranks by the largest smallest amount instead.  A round joins only the nodes that
    improved in the one before and writes only those that improve now, as (case, node, cost, parent); of
    equal offers the least parent counts, and a known cost stays.  Costs never fall along a path and a
    node changes only for a lower one, so rounds end and parents never form a circle.  The paths are built
    once, at the end.
    """
    scope = scope or ["chain"]
    pairs = salt_hot_keys(stage(value_pairs(edges, scope), "value-pairs"), [*scope, "node"], ["nxt"])
    # One comparable number, smaller is better, in both modes.
    initial = F.lit(float("-inf")) if bottleneck else F.lit(0.0)
    step = (
        F.greatest(F.col("cost"), -F.col("value")) if bottleneck else F.col("cost") + F.col("step")
    )
    carried = list(dict.fromkeys(["case_id", *scope]))
    key = [*carried, "node"]
    start = cases.select(*carried, F.col("root").alias("node"), initial.alias("cost"), F.lit(None).cast("string").alias("parent"))
    fresh = stage(start, "value0")
    deltas, number = [fresh], 0
    while True:
        number += 1
        ahead = pairs.join(fresh.drop("parent").withColumnRenamed("cost", "_so_far")).withColumnRenamed("cost", "step")
        offers = ahead.withColumnRenamed("_so_far", "cost").filter(F.col("nxt") != F.col("node")).select(
            *carried, F.col("nxt").alias("node"), F.struct(step.alias("cost"), F.col("node").alias("parent")).alias("offer"),
            F.lit(None).cast("double").alias("held"),
        )
        known = reduce(DataFrame.unionByName, deltas).select(
            *key, F.lit(None).cast(offers.schema["offer"].dataType).alias("offer"), F.col("cost").alias("held")
        )
        best = known.unionByName(offers).groupBy(*key).agg(F.min("offer").alias("offer"), F.min("held").alias("held"))
        fresh, improved = stage_counted(
            best.filter("offer is not null and (held is null or offer.cost < held)").select(*key, "offer.*"), f"value{number}"
        )
        if not improved:
            break
        deltas.append(fresh)
        if len(deltas) > MERGE_ROUNDS:
            deltas = [stage(_last_offers(deltas, key), "value-merged")]
    found = rebuilt_paths(_last_offers(deltas, key), key, "node", "parent")
    return found.drop("parent") if not bottleneck else found.withColumn("value", -F.col("cost")).drop("cost", "parent")


def _last_offers(deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """The cheapest row of each node: its last one."""
    best = reduce(DataFrame.unionByName, deltas).groupBy(*key).agg(F.min(F.struct("cost", "parent")).alias("_b"))
    return best.select(*key, "_b.*")


def rebuilt_paths(tree: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """Add ``path``, the nodes from the root (NULL parent) down to each node.

    Pointer tripling: in a round every unfinished path puts the two that end above it in front, so the
    longest path takes a logarithm of its length in rounds.  Finished ones are not written again.
    """
    scope = [c for c in key if c != node]
    rows = tree.withColumns({"path": F.array(node), "_up": F.col(parent)})
    written, left = stage_counted(rows, "paths0", F.count_if(F.col("_up").isNotNull()))
    done, number = [written.filter("_up is null")], 0
    open_ = written.filter("_up is not null")
    while left:
        number += 1
        above = reduce(DataFrame.unionByName, [*done, open_]).select(
            *scope, F.col(node).alias("_up"), F.col("path").alias("_path"), F.col("_up").alias("_next")
        )
        once = open_.join(above, [*scope, "_up"]).withColumn("path", F.concat("_path", "path"))
        once = once.withColumn("_up", F.col("_next")).drop("_path", "_next")
        twice = once.join(above, [*scope, "_up"], "left").withColumn("path", F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path"))
        written, left = stage_counted(
            twice.withColumn("_up", F.col("_next")).select(*rows.columns), f"paths{number}", F.count_if(F.col("_up").isNotNull())
        )
        done.append(written.filter("_up is null"))
        open_ = written.filter("_up is not null")
    return reduce(DataFrame.unionByName, done).drop("_up")

"""Noise filters on case graphs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.operators.lookup import in_period
from ledgerhop.schema import AMOUNT

DUST = "0.0001"
# Dust limits that differ from the general one, by asset.
DUST_BY_ASSET = {"USDT": "1.0"}


def effective_minimum(min_amount: str = "0", hide_dust: bool = True, dust: str = DUST) -> Decimal:
    return max(Decimal(min_amount), Decimal(dust)) if hide_dust else Decimal(min_amount)


def filter_edges(
    edges: DataFrame,
    min_amount: str = "0",
    hide_dust: bool = True,
    dust: str = DUST,
    assets: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    max_hop: int | None = None,
) -> DataFrame:
    """Edges at or above the minimum, of the listed assets, inside the period and depth."""
    floor = effective_minimum(min_amount, hide_dust, dust)
    keep = F.col("amount") >= F.lit(str(floor)).cast(AMOUNT)
    if assets:
        listed = [a.upper() for a in assets]
        keep = keep & (F.upper("asset_symbol").isin(listed) | F.upper("asset_id").isin(listed))
    if start is not None or end is not None:
        keep = keep & in_period(F.col("ts"), start, end)
    if max_hop is not None:
        keep = keep & (F.col("hop") <= max_hop)
    return edges.filter(keep)


def keep_touched_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at either end of a kept edge, and the root always."""
    ends = (
        edges.select("case_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    )
    touched = ends.withColumn("_touched", F.lit(True))
    return nodes.join(touched, ["case_id", "node"], "left").filter(
        F.col("is_root") | F.col("_touched")
    ).drop("_touched")


def filtered_totals(cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth as the largest edge hop (0 without edges), and totals, for every case."""
    e = edges.groupBy("case_id").agg(
        F.max("hop").alias("_hop"), F.count(F.lit(1)).alias("total_edges")
    )
    n = nodes.groupBy("case_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    total = F.coalesce("total_edges", F.lit(0))
    return (
        cases.select("case_id")
        .join(n, "case_id", "left")
        .join(e, "case_id", "left")
        .select(
            "case_id",
            F.coalesce("total_nodes", F.lit(0)).alias("total_nodes"),
            total.alias("total_edges"),
            F.when(total > 0, F.greatest(F.col("_hop"), F.lit(1))).otherwise(0).alias("hop_depth"),
        )
    )


def drop_dust(
    edges: DataFrame,
    scope: list[str],
    dust: str = DUST,
    by_asset: dict[str, str] | None = None,
    major_share: float = 0.5,
) -> DataFrame:
    """Drop dust unless it is at least ``major_share`` of the sender's outflow in the asset."""
    limits = DUST_BY_ASSET if by_asset is None else by_asset
    limit = F.lit(dust).cast(AMOUNT)
    for asset, value in limits.items():
        limit = F.when(F.upper("asset_symbol") == asset, F.lit(value).cast(AMOUNT)).otherwise(limit)
    keys = [*scope, "source", "asset_symbol"]
    # Totals are an aggregate joined back, not a window over a possibly huge sender.
    totals = edges.groupBy(*keys).agg(F.sum("amount").cast("double").alias("_outflow"))
    share = F.col("amount").cast("double") >= major_share * F.col("_outflow")
    return edges.join(totals, keys).filter((F.col("amount") >= limit) | share).drop("_outflow")

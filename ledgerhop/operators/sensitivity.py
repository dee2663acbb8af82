"""What-if analysis of scores and evaluation against known answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.operators.scoring import band

ROBUST_UPTO, MODERATE_UPTO = 15.0, 28.0
SCREEN_HIGH, SCREEN_MEDIUM = 80.0, 50.0


def ablation(factors: DataFrame) -> DataFrame:
    """Score without each positive factor, one row per (candidate, factor)."""
    new = F.greatest(F.lit(0.0), F.col("score") - F.col("points"))
    return (
        factors.filter((F.col("kind") == "POSITIVE") & (F.col("points") > 0))
        .withColumn("new_score", new)
        .withColumn("score_delta", F.round(F.col("score") - F.col("new_score"), 1))
        .withColumn(
            "robustness",
            F.when(F.col("score_delta") <= ROBUST_UPTO, "ROBUST")
            .when(F.col("score_delta") <= MODERATE_UPTO, "MODERATE_DEPENDENCY")
            .otherwise("HIGH_DEPENDENCY"),
        )
        .select(
            "case_id", "entity", "rank", "factor", "score", "new_score", "score_delta", "robustness"
        )
    )


def ablate_set(factors: DataFrame, removed: Sequence[str]) -> DataFrame:
    """Score with several factors removed one after the other, never below zero.

    A candidate has at most seven factors, so their list is bounded.
    """
    gone = F.col("factor").isin(list(removed))
    listed = F.array_sort(F.collect_list(F.when(gone, F.struct("position", "points"))))
    grouped = factors.groupBy("case_id", "entity", "score").agg(listed.alias("gone"))
    simulated = F.aggregate(
        "gone", F.col("score"), lambda total, f: F.greatest(F.lit(0.0), total - f["points"])
    )
    return grouped.select(
        "case_id",
        "entity",
        "score",
        F.round(simulated, 1).alias("simulated_score"),
        band(simulated, SCREEN_HIGH, SCREEN_MEDIUM).alias("simulated_band"),
    )


def sensitivity_matrix(factors: DataFrame) -> DataFrame:
    """Re-rank every case after removing one factor from all its candidates.

    ROBUST: loses at most 25 points and stays first.  HIGHLY_SENSITIVE: loses more than 40
    and is no longer first.
    """
    removable = factors.filter((F.col("kind") == "POSITIVE") & (F.col("points") > 0))
    lost = removable.select("case_id", "entity", F.col("factor").alias("removed"), "points")
    candidates = factors.select("case_id", "entity", "score", "rank").distinct()
    names = lost.select("case_id", "removed").distinct()
    grid = candidates.join(names, "case_id").join(lost, ["case_id", "entity", "removed"], "left")
    new = F.greatest(F.lit(0.0), F.col("score") - F.coalesce("points", F.lit(0.0)))
    order = Window.partitionBy("case_id", "removed").orderBy(F.desc("new_score"), F.asc("rank"))
    delta = F.round(F.col("score") - F.col("new_score"), 1)
    return (
        grid.withColumn("new_score", new)
        .withColumn("new_rank", F.row_number().over(order))
        .withColumn("score_delta", delta)
        .withColumn(
            "assessment",
            F.when((F.col("score_delta") <= 25) & (F.col("new_rank") == 1), "ROBUST")
            .when((F.col("score_delta") > 40) & (F.col("new_rank") > 1), "HIGHLY_SENSITIVE")
            .otherwise("MODERATE"),
        )
        .select("case_id", "entity", "rank", "removed", "score", "new_score", "new_rank", "score_delta", "assessment")
    )


def fragility(factors: DataFrame) -> DataFrame:
    """Largest single-factor loss as a share of the score (0 for a zero score)."""
    drops = ablation(factors)
    return drops.groupBy("case_id", "entity", "score").agg(
        F.max("score_delta").alias("largest_delta")
    ).withColumn(
        "fragility_index",
        F.when(F.col("score") > 0, F.round(F.col("largest_delta") / F.col("score"), 4)).otherwise(0.0),
    )


def evaluate_benchmark(truth: DataFrame, scores: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Per case: name match, minimum score, expected breakpoint, pass."""
    top = scores.filter(F.col("rank") == 1).select("case_id", "entity", "score")
    marked = breakpoints.select("case_id").distinct().withColumn("_bp", F.lit(True))
    joined = truth.join(top, "case_id", "left").join(marked, "case_id", "left")
    name = F.coalesce(F.col("entity") == F.col("ground_truth_vasp"), F.lit(False))
    enough = F.coalesce(F.col("score") >= F.col("expected_min_score"), F.lit(False))
    breaks = F.coalesce("_bp", F.lit(False)) | ~F.coalesce("has_breakpoint", F.lit(False))
    return joined.select(
        "case_id",
        F.col("entity").alias("top_entity"),
        "score",
        name.alias("name_match"),
        enough.alias("score_match"),
        breaks.alias("breakpoint_match"),
        (name & enough & breaks).alias("passed"),
    )


def benchmark_kpis(truth: DataFrame, scores: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Top-1 and top-3 accuracy and breakpoint detection rate, one row."""
    best = (
        truth.join(scores, "case_id", "left")
        .filter(F.col("entity") == F.col("ground_truth_vasp"))
        .groupBy("case_id")
        .agg(F.min("rank").alias("hit_rank"))
    )
    marked = breakpoints.select("case_id").distinct().withColumn("_bp", F.lit(True))
    joined = truth.select("case_id", "has_breakpoint").join(best, "case_id", "left").join(
        marked, "case_id", "left"
    )
    one = F.lit(1.0)
    hit = F.coalesce("hit_rank", F.lit(2**31 - 1))
    return joined.agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.when(hit == 1, one).otherwise(0.0)).alias("top1_accuracy"),
        F.avg(F.when(hit <= 3, one).otherwise(0.0)).alias("top3_accuracy"),
        F.avg(F.when(F.col("has_breakpoint"), F.when(F.col("_bp"), one).otherwise(0.0))).alias(
            "breakpoint_detection_rate"
        ),
    )

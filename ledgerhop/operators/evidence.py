"""Evidence items, integrity digests and case dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.digests import row_digest
from ledgerhop.operators.ordering import top_rows


def evidence_items(transfers: DataFrame, transactions: DataFrame) -> DataFrame:
    """One evidence row per transfer; block, time and fee stay NULL when unknown."""
    about = transactions.select("chain", "tx_hash", "block_number", "fee")
    return transfers.drop("block_number").join(about, ["chain", "tx_hash"], "left").select(
        F.concat(F.lit("ev_"), F.substring("tx_hash", 1, 10)).alias("evidence_id"),
        "tx_hash",
        "transfer_id",
        "chain",
        "block_number",
        "ts",
        "from_address",
        "to_address",
        F.col("asset_symbol").alias("asset"),
        "amount",
        "fee",
        F.lit("ON_CHAIN_VERIFIED").alias("source"),
    )


def factor_evidence(support: DataFrame, transfers: DataFrame) -> DataFrame:
    """Drill-down: supporting transactions of each candidate with their transfers."""
    return support.join(transfers, ["chain", "tx_hash"])


def _combine(parts: DataFrame, digits: int) -> DataFrame:
    """Digest of the digests sharing (case, first ``digits`` of the bucket)."""
    line = F.concat_ws(":", "b", "d", F.col("n").cast("string"))
    return (
        parts.withColumn("p", F.substring("b", 1, digits))
        .groupBy("case_id", "p")
        .agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("d"),
            F.sum("n").alias("n"),
        )
        .withColumnRenamed("p", "b")
    )


def snapshot(rows: DataFrame) -> DataFrame:
    """Order-independent SHA-256 digest of all rows of a case.

    Equal rows are counted, then digests combine along their own hex digits (6, 3, 0), so
    no step collects more than 4,096 buckets and a large case spreads over all tasks.
    """
    names = [c for c in rows.columns if c != "case_id"]
    leaves = (
        rows.select("case_id", row_digest(names).alias("d"))
        .groupBy("case_id", "d")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("b", F.substring("d", 1, 6))
    )
    merged = _combine(_combine(_combine(leaves, 6), 3), 0)
    return merged.select("case_id", F.col("d").alias("digest"), F.col("n").alias("records"))


def verify_snapshot(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """VALID where the recomputed digest equals the stored one, else TAMPERED."""
    now = snapshot(rows).select("case_id", F.col("digest").alias("recomputed"))
    return stored.select("case_id", "digest").join(now, "case_id", "left").withColumn(
        "integrity",
        F.when(F.col("digest") == F.col("recomputed"), "VALID").otherwise("TAMPERED"),
    )


def dossier(
    cases: DataFrame,
    scores: DataFrame,
    support: DataFrame,
    risk: DataFrame,
    digests: DataFrame,
    first: int = 5,
) -> DataFrame:
    """One row per case: top candidate, first transactions, risk level and digest."""
    top = scores.filter(F.col("rank") == 1).select(
        "case_id", "entity", "score", "band", "terminal_address", "min_hop"
    )
    # The first hashes: a top-k per case, so the list has a fixed length.
    heads = (
        top_rows(
            support.join(top.select("case_id", "entity"), ["case_id", "entity"], "left_semi"),
            ["case_id"],
            ["tx_hash"],
            first,
            "n",
        )
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list("tx_hash")).alias("first_transactions"))
    )
    return (
        cases.join(top, "case_id", "left")
        .join(heads, "case_id", "left")
        .join(risk.select("case_id", "overall_risk_level", "total_findings"), "case_id", "left")
        .join(digests.select("case_id", "digest"), "case_id", "left")
    )

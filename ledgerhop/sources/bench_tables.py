"""Views of the TPC-H-like test tables in the shape of the data model.

``events`` become transfers between wallets ``a<n>``, ``lineitem`` joined to
``orders`` becomes a transfer volume from customers to suppliers, and ``nation`` /
``region`` supply entity names for labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerhop.schema import AMOUNT


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_transfers(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One transfer per event (of the table, or of a stream of it); two neighbouring events share a
    transaction hash."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    receiver = F.get_json_object("props", "$.k")
    event_id = F.col("event_id")
    pair = F.floor(event_id / 2).cast("bigint")
    source = load(spark, sf_dir, "events") if events is None else events
    return source.select(
        F.concat(F.lit("t"), event_id).alias("transfer_id"),
        F.concat(F.lit("x"), pair).alias("tx_hash"),
        F.lit("ethereum").alias("chain"),
        F.concat(F.lit("a"), F.col("user_id")).alias("from_address"),
        F.concat(F.lit("a"), receiver).alias("to_address"),
        F.when(F.col("event_type") == "view", "native").otherwise("erc20").alias("asset_type"),
        F.concat(F.lit("id-"), F.col("event_type")).alias("asset_id"),
        F.upper("event_type").alias("asset_symbol"),
        F.lit(None).cast("string").alias("token_contract"),
        F.lit(18).alias("token_decimals"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("raw_amount"),
        F.col("value").cast("decimal(18,2)").cast(AMOUNT).alias("amount"),
        F.when(F.col("event_type") == "view", "native").otherwise("token").alias("transfer_type"),
        F.pmod(event_id, F.lit(2)).cast("int").alias("transfer_index"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("evidence_ref"),
        F.floor(event_id / 10).cast("bigint").alias("block_number"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of :func:`event_transfers`, one row per hash."""
    return (
        event_transfers(spark, sf_dir)
        .groupBy("tx_hash", "chain")
        .agg(F.min("block_number").alias("block_number"), F.min("ts").alias("ts"))
    )


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-to-supplier transfers; the natural key repeats on purpose."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("_", F.concat(F.lit("o"), F.col("l_orderkey")), "l_linenumber").alias(
            "transfer_id"
        ),
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("tx_hash"),
        F.lit("ethereum").alias("chain"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("from_address"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("to_address"),
        F.col("l_returnflag").alias("asset_id"),
        F.col("l_returnflag").alias("asset_symbol"),
        price.cast(AMOUNT).alias("amount"),
        F.col("l_linenumber").cast("int").alias("transfer_index"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").alias("part_key"),
    )


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct wallets of both sides with their number."""
    events = load(spark, sf_dir, "events")
    return (
        events.select(F.col("user_id").alias("n"))
        .union(events.select(F.get_json_object("props", "$.k").cast("bigint").alias("n")))
        .distinct()
        .withColumn("address", F.concat(F.lit("a"), F.col("n")))
    )


def wallet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label record per service wallet: type by last digit, name by nation."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    digit = F.pmod(F.col("n"), F.lit(10))
    kind = (
        F.when(digit == 0, "VASP_DEPOSIT")
        .when(digit == 1, "VASP_HOT")
        .when(digit == 2, "MIXER")
        .when(digit == 3, "BRIDGE")
    )
    return (
        wallets(spark, sf_dir)
        .withColumn("entity_type", kind)
        .filter(F.col("entity_type").isNotNull())
        .withColumn("n_nationkey", F.pmod(F.col("n"), F.lit(25)).cast("int"))
        .join(nation, "n_nationkey")
        .select(
            F.lit(0).alias("file_no"),
            F.col("n").cast("int").alias("position"),
            "address",
            F.lit("ethereum").alias("chain"),
            F.concat(F.lit("ent"), F.col("n")).alias("entity_id"),
            F.col("n_name").alias("entity_name"),
            F.lit(None).cast("string").alias("name"),
            "entity_type",
            F.lit(None).cast("boolean").alias("vasp_status"),
            F.lit(0.9).alias("confidence"),
            F.lit("nation").alias("label_source"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("source_reference"),
            F.lit(None).cast("string").alias("notes"),
        )
    )


def second_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second record, named by region, for every wallet labelled as a bridge."""
    names = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        wallet_labels(spark, sf_dir)
        .filter(F.col("entity_type") == "BRIDGE")
        .join(names.select(F.col("n_name").alias("entity_name"), "r_name"), "entity_name")
        .withColumn("entity_name", F.col("r_name"))
        .withColumn("entity_type", F.lit("EXCHANGE"))
        .withColumn("file_no", F.lit(1))
        .drop("r_name")
    )


def nation_cases(spark: SparkSession, sf_dir: str, max_hops: int = 3, direction: str = "outgoing") -> DataFrame:
    """One case per nation, rooted at the wallet of its key."""
    return load(spark, sf_dir, "nation").select(
        F.concat(F.lit("case"), F.col("n_nationkey")).alias("case_id"),
        F.lit("ethereum").alias("chain"),
        F.concat(F.lit("a"), F.col("n_nationkey")).alias("root"),
        F.lit(direction).alias("direction"),
        F.lit(max_hops).alias("max_hops"),
    )


def sender_cases(spark: SparkSession, sf_dir: str, max_hops: int = 2) -> DataFrame:
    """One case per sending wallet."""
    return (
        load(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("case"), F.col("user_id")).alias("case_id"),
            F.lit("ethereum").alias("chain"),
            F.concat(F.lit("a"), F.col("user_id")).alias("root"),
            F.lit("outgoing").alias("direction"),
            F.lit(max_hops).alias("max_hops"),
        )
    )

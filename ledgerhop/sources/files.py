"""Readers for the JSON inputs: transaction records, cases, truth, labels, payloads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerhop.functions.text import address_key, filled, key_chain
from ledgerhop.operators.ordering import first_rows
from ledgerhop.schema import CASES, LABELS, RAW_RECORD, TRUTH, envelope


def read_records(spark: SparkSession, path: str | Sequence[str], schema: str = RAW_RECORD) -> DataFrame:
    """Transaction files (a list of records or one record each), with the file name."""
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(paths)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def read_record_lines(spark: SparkSession, path: str, schema: str = RAW_RECORD) -> DataFrame:
    """One record per line: the splittable form for large inputs."""
    return spark.read.schema(schema).json(path).withColumn(
        "file_name", F.col("_metadata.file_name")
    )


def file_alias(file_name: Column) -> Column:
    """Default case alias of a file: its name without the extension."""
    return F.regexp_replace(file_name, r"\.json$", "")


def with_case_alias(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attach ``case_id`` through ``aliases(file_name, case_id)``.

    Files without an alias use their own name.  The alias table has one row per
    file and alias; AQE broadcasts it when its measured size allows.
    """
    return records.join(aliases, "file_name", "left").withColumn(
        "case_id", F.coalesce("case_id", file_alias(F.col("file_name")))
    )


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Case definitions: one JSON document per file, or one per line."""
    return spark.read.schema(CASES).option("multiLine", not lines).json(path)


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    wrapper = T.StructType([T.StructField("benchmark_cases", T.ArrayType(TRUTH))])
    raw = spark.read.schema(wrapper).option("multiLine", not lines).json(path)
    return raw.select(F.explode("benchmark_cases").alias("c")).select("c.*")


def read_label_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Label records of several files with their reading order (``file_no``, ``position``)."""
    parts = []
    for number, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        rows = text.select(
            F.lit(number).alias("file_no"),
            F.posexplode(F.from_json("value", T.ArrayType(LABELS))).alias("position", "r"),
        )
        parts.append(rows.select("file_no", "position", "r.*"))
    return reduce(DataFrame.unionByName, parts)


def knowledge_base(records: DataFrame) -> DataFrame:
    """One label per chain and address: the last record wins, records without address drop out.

    ``chain`` and ``node`` are the keys that edges and nodes have (chain-aware, canonical).
    """
    chain = F.coalesce(filled(F.col("chain")), F.lit("ethereum"))
    keyed = (
        records.filter(filled(F.col("address")).isNotNull())
        .withColumn("node", address_key(chain, F.col("address")))
        .withColumn("chain", key_chain(chain))
    )
    newest = keyed.withColumn("_file", -F.col("file_no")).withColumn("_pos", -F.col("position"))
    return first_rows(newest, ["chain", "node"], ["_file", "_pos"]).drop("_file", "_pos")


def registry(records: DataFrame) -> DataFrame:
    """All records, keyed by canonical chain and chain-aware address."""
    chain = key_chain(F.coalesce("chain", F.lit("ethereum")))
    return (
        records.filter(filled(F.col("address")).isNotNull())
        .withColumn("registry_chain", chain)
        .withColumn("node", address_key(chain, F.col("address")))
    )


def add_records(current: DataFrame, extra: DataFrame) -> DataFrame:
    """Append label records; they rank after everything loaded before."""
    return current.unionByName(
        extra.withColumn("file_no", F.lit(2**31 - 1)), allowMissingColumns=True
    )


def read_payload(
    spark: SparkSession, path: str, transfers: bool = True, lines: bool = False
) -> DataFrame:
    """Items of ``data.EVM.Transfers[]`` (or ``Transactions[]``) with file and position.

    One envelope per file; files of several envelopes go through :func:`payload_items`
    with a ``payload`` number of their own.
    """
    raw = spark.read.schema(envelope(transfers)).option("multiLine", not lines).json(path)
    return payload_items(
        raw.withColumn("payload", F.col("_metadata.file_path")), transfers
    )


def payload_items(raw: DataFrame, transfers: bool = True) -> DataFrame:
    """Explode envelopes that were read or parsed already (columns ``payload``, ``data``)."""
    name = "Transfers" if transfers else "Transactions"
    return raw.select(
        "payload", F.posexplode(F.col("data.EVM").getField(name)).alias("position", "item")
    ).select("payload", "position", "item.*")

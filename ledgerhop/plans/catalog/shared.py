"""Inputs several queries start from."""

from pyspark.sql import DataFrame, SparkSession

from ledgerhop.operators import graph
from ledgerhop.plans.investigate import CaseGraph, case_graph
from ledgerhop.sources import bench_tables as tables
from ledgerhop.sources import files
from ledgerhop.staging import stage


def base_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge table of all event transfers."""
    return graph.edge_table(tables.event_transfers(spark, sf))


def labels_table(spark: SparkSession, sf: str) -> DataFrame:
    """The label base, written once: several joins of a query read it."""
    return stage(files.knowledge_base(tables.wallet_labels(spark, sf)), "labels")


def registry_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labels plus the second opinions that make some of them ambiguous."""
    return files.registry(
        files.add_records(tables.wallet_labels(spark, sf), tables.second_opinions(spark, sf))
    )


def traced_graph(spark: SparkSession, sf: str, max_hops: int = 3, constant_hops: bool = False) -> CaseGraph:
    """Forward graphs of one case per nation."""
    return case_graph(
        tables.nation_cases(spark, sf, max_hops),
        base_edges(spark, sf),
        labels_table(spark, sf),
        directions=("outgoing",),
        constant_hops=constant_hops,
    )

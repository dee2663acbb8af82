"""Session defaults and the shared folder that cuts lineage between hops.

Loops write each round as a Parquet table and read it back.  A written table is
computed once (``checkpoint()`` would run the plan twice), keeps column pruning,
survives executor loss, and its file size lets Spark decide on a broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed joins even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "ledgerhop", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the
    setting is an error, because a machine-local path would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="ledgerhop-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """New folder for one written table, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{stage_root(spark)}/ledgerhop/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back with its own schema."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` bucketed on ``keys``: joins on them need no further shuffle of this side.

    One repartition puts each bucket into one task, so there is one file per bucket.
    """
    spark = df.sparkSession
    name = f"ledgerhop_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", stage_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def stage_counted(
    df: DataFrame, label: str, measure: Column | None = None
) -> tuple[DataFrame, int]:
    """As :func:`stage`, with a number seen while writing (the row count unless another
    aggregate is given), so it costs no extra job."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    counted = F.count(F.lit(1)) if measure is None else measure
    staged = stage(df.observe(seen, counted.alias("n")), label)
    return staged, int(seen.get.get("n") or 0)

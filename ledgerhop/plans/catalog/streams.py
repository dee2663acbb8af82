"""Queries: the streaming jobs, run over the events table until it is exhausted."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerhop.plans.catalog.registry import TR, query
from ledgerhop.sources import bench_tables as tables
from ledgerhop.sources import sinks
from ledgerhop.staging import stage_path
from ledgerhop.streaming import transfers as streaming


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = tables.load(spark, sf, "events").schema
    # A pattern, because a stream's plain path has to be a folder and the table may be one file.
    path = f"{sf.rstrip('/')}/event[s].parquet"
    return tables.event_transfers(spark, sf, streaming.read_transfers(spark, path, schema))


def _drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Everything a stream appends until its source is used up."""
    path = stage_path(spark, label)
    streaming.write_available(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query(
    "s1_stream_without_repeats",
    f"WITH {TR} SELECT transfer_id, f AS from_address, t AS to_address, CAST(amount AS DOUBLE) AS amount FROM tr",
)
def _(spark, sf):
    # Every event arrives twice.
    both = _stream(spark, sf).unionByName(_stream(spark, sf))
    once = _drained(spark, streaming.without_repeats(both), "s1")
    return once.select("transfer_id", "from_address", "to_address", F.col("amount").cast("double").alias("amount"))


# Windows that the watermark has closed: their end is an hour or more before the last event.
@query(
    "s2_stream_burst_alerts",
    f"""WITH {TR}, w AS (SELECT f, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS b FROM tr),
x AS (SELECT f, b AS s FROM w UNION ALL SELECT f, b - INTERVAL '12 hours' FROM w)
SELECT epoch_us(s) AS start_us, f AS source, count(*) AS transfers FROM x
WHERE s + INTERVAL '24 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM tr) GROUP BY s, f HAVING count(*) >= 4""",
)
def _(spark, sf):
    alerts = streaming.burst_alerts(_stream(spark, sf), at_least=4, window="24 hours", step="12 hours")
    found = _drained(spark, alerts, "s2")
    return found.select(F.unix_micros("start").alias("start_us"), "source", "transfers")


def _in_files(spark: SparkSession, sf: str, label: str, minutes: int, files: int) -> str:
    """The events as ``files`` files in the order they arrive: up to ``minutes`` behind their time."""
    path = f"{stage_path(spark, label)}/events"
    events = tables.load(spark, sf, "events")
    behind = F.pmod(F.xxhash64("event_id"), F.lit(minutes * 60))
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + behind
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    part = F.floor((arrival - first) * files / (last - first + 1)).cast("int")
    placed = events.withColumn("part", part)
    for n in range(files):  # one write each, so that their times of change follow that order
        placed.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


@query(
    "s2_exact_stream_bursts",
    f"""WITH {TR} SELECT f AS source, epoch_us(ts) AS ts_us, n AS transfers FROM (
  SELECT DISTINCT f, ts, count(*) OVER (PARTITION BY f ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS n FROM tr) x
WHERE n >= 4 AND ts <= (SELECT max(ts) - INTERVAL '1 hour' FROM tr)""",
)
def _(spark, sf):
    """The batch rule on a stream of four files whose events come up to an hour late, in several batches."""
    path = _in_files(spark, sf, "s2-events", minutes=59, files=4)
    schema = tables.load(spark, sf, "events").schema
    stream = tables.event_transfers(spark, sf, streaming.read_transfers(spark, path, schema, files_per_trigger=1))
    alerts = streaming.exact_burst_alerts(stream, 4, 12 * 3600, "1 hour")
    return _drained(spark, alerts, "s2-exact").select("source", "ts_us", "transfers")


@query(
    "a13_streamed_audit_log",
    """SELECT 'x' || (event_id // 2) AS case_id, 'a' || user_id AS actor, event_type AS action, count(*) AS rows_stored,
  count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    """Audit rows of a stream that ends, is started again with more files, and is started once more with none."""
    path = _in_files(spark, sf, "a13-events", minutes=1, files=3)
    schema = tables.load(spark, sf, "events").schema
    root = stage_path(spark, "audit-db")
    for files_per_trigger in (1, 2, 1):
        events = streaming.read_transfers(spark, path, schema, files_per_trigger)
        rows = events.select(
            F.concat(F.lit("x"), F.floor(F.col("event_id") / 2).cast("bigint")).alias("case_id"),
            F.concat(F.lit("a"), F.col("user_id")).alias("actor"),
            F.col("event_type").alias("action"),
            F.col("event_id").cast("string").alias("detail"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
        sinks.append_audit(rows, root, f"{root}/checkpoint").awaitTermination()
    return sinks.read_audit(spark, root).groupBy("case_id", "actor", "action").agg(
        F.count(F.lit(1)).alias("rows_stored"), F.count_distinct("event_hash").alias("events")
    )

"""Structured Streaming jobs over a stream of transfers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_transfers(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def without_repeats(transfers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drop repeats of a transfer id that arrive within the watermark; state is bounded by it."""
    return transfers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transfer_id"])


def burst_alerts(
    transfers: DataFrame,
    at_least: int = 4,
    window: str = "15 minutes",
    step: str = "5 minutes",
    late: str = "1 hour",
) -> DataFrame:
    """Senders with ``at_least`` transfers in a sliding window.

    A burst straddling two steps can be missed; the batch operator is exact.
    """
    return (
        transfers.withWatermark("ts", late)
        .groupBy(F.window("ts", window, step), "chain", F.col("from_address").alias("source"))
        .agg(F.count(F.lit(1)).alias("transfers"))
        .filter(F.col("transfers") >= at_least)
        .select("window.start", "window.end", "chain", "source", "transfers")
    )


def write_available(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append everything available now to Parquet, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)


#: Output and state of the exact burst alerts: times in microseconds, the number of transfers at each, and the
#: time up to which the sender has been judged.
BURSTS = "chain string, source string, ts_us bigint, transfers bigint"
_BURST_STATE = "times array<bigint>, counts array<bigint>, judged bigint"


def exact_burst_alerts(
    transfers: DataFrame, at_least: int = 4, seconds: int = 15 * 60, late: str = "1 hour"
) -> DataFrame:
    """Times at which a sender made ``at_least`` transfers within the last ``seconds``, as the batch rule.

    A time is judged once the watermark has passed it, so transfers that come up to ``late`` behind
    count whatever their order.  Per sender the state holds the distinct times of the open part and
    of one window before it, with their number of transfers; a timer on the event time judges them
    without further input, and drops a sender whose last window has closed.  Transfers without a
    time take no part.
    """
    span = seconds * 1_000_000
    schema = [c.strip().split() for c in BURSTS.split(",")]

    def judge(key, batches, state):
        times, counts, judged = state.get if state.exists else ([], [], 0)
        seen = Counter(dict(zip(times, counts)))
        for batch in batches:
            seen.update(batch["at_us"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        moments = sorted(seen)
        before = [0, *accumulate(seen[t] for t in moments)]
        found = []
        for i in range(bisect_right(moments, judged), bisect_right(moments, passed)):
            n = before[i + 1] - before[bisect_left(moments, moments[i] - span)]
            if n >= at_least:
                found.append((*key, moments[i], n))
        judged = max(judged, passed)
        held = moments[bisect_left(moments, judged - span) :]
        if held:
            # The next time to judge, or else the end of the last window.
            ahead = bisect_right(held, judged)
            due = held[ahead] if ahead < len(held) else held[-1] + span
            state.update((held, [seen[t] for t in held], judged))
            state.setTimeoutTimestamp(due // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=[n for n, _ in schema]).astype({"ts_us": "int64", "transfers": "int64"})

    rows = transfers.filter(F.col("ts").isNotNull()).withWatermark("ts", late).select(
        "chain", F.col("from_address").alias("source"), "ts", F.unix_micros("ts").alias("at_us")
    )
    return rows.groupBy("chain", "source").applyInPandasWithState(judge, BURSTS, _BURST_STATE, "append", "EventTimeTimeout")

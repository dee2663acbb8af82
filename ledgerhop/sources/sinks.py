"""Parquet tables of the persisted model: insert-if-absent, reset, case results, audit trail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from ledgerhop.operators.ordering import first_of_listed, first_rows
from ledgerhop.schema import CASE_TABLES, DATED_TABLES, TABLES
from ledgerhop.staging import stage_counted

#: Partitions of a batch that are named one by one when the stored side is read; more become a range of months.
MOST_PARTITIONS = 2_000
#: Bits of a batch's key filter, at most (8 MB).
MOST_BITS = 1 << 26
#: Stored rows for one of the batch, at least, for which a key filter is made.
FILTER_SHARE = 4
#: Rows of one folder that a task writes, about.
FILE_ROWS = 5_000_000
#: Folders of a table of case results.
CASE_BUCKETS = 64


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def partition_columns(name: str) -> list[str]:
    return ["p_chain", "p_month"] if name in DATED_TABLES else ["p_bucket"] if name in CASE_TABLES else []


def _folders(name: str) -> dict[str, Column]:
    """Folders that a row belongs to; a missing chain or time has a folder of its own."""
    if name in DATED_TABLES:
        month = F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("none"))
        return {"p_chain": F.coalesce(F.nullif("chain", F.lit("")), F.lit("none")), "p_month": month}
    if name in CASE_TABLES:
        return {"p_bucket": case_bucket(F.col("case_id")).cast("string")}
    return {}


def _with_partitions(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns(_folders(name)) if _folders(name) else df


def case_bucket(case_id: Column) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(CASE_BUCKETS))


def stored_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The stored table with its folder columns."""
    schema = StructType(list(TABLES[name][0]))
    for column in partition_columns(name):
        schema.add(column, StringType())
    return spark.read.schema(schema).parquet(table_path(root, name))


def _append(df: DataFrame, root: str, name: str, most: int) -> None:
    """Appends at most ``most`` rows to their folders, each folder by as many tasks as such a batch may need."""
    by = partition_columns(name)
    path = table_path(root, name)
    if not by:
        df.write.mode("append").parquet(path)
        return
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(1 + most // FILE_ROWS))
    dealt = _with_partitions(df.repartition(tasks, *_folders(name).values(), spread), name)  # folder names don't move
    dealt.write.mode("append").partitionBy(*by).parquet(path)


def reset_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(TABLES)) -> None:
    """Recreate every table, or some, empty."""
    for name in names:
        schema, _ = TABLES[name]
        empty = _with_partitions(spark.createDataFrame([], schema), name)
        by = partition_columns(name)
        writer = empty.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return stored_table(spark, root, name).select(*TABLES[name][0].names)


def typed_rows(name: str, rows: DataFrame) -> DataFrame:
    """The columns of a table in their types."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name][0]])


def absent_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key by ``order``."""
    return first_rows(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def touched_partitions(batch: DataFrame) -> Column:
    """Condition on the folders that a batch of a dated table belongs to, for the scan of the stored side.

    Up to ``MOST_PARTITIONS`` folders are named; a batch over more is narrowed by chain and range of months.
    """
    folders = batch.select("p_chain", "p_month").distinct().limit(MOST_PARTITIONS + 1).collect()
    found = F.lit(False)
    if len(folders) <= MOST_PARTITIONS:
        months: dict[str, list[str]] = {}
        for r in folders:
            months.setdefault(r["p_chain"], []).append(r["p_month"])
        for chain, own in sorted(months.items()):
            found = found | ((F.col("p_chain") == chain) & F.col("p_month").isin(sorted(own)))
        return found
    spans = batch.groupBy("p_chain").agg(F.min("p_month").alias("a"), F.max("p_month").alias("b"))
    for r in spans.collect():  # one row per chain
        found = found | ((F.col("p_chain") == r["p_chain"]) & F.col("p_month").between(r["a"], r["b"]))
    return found


def key_filter(batch: DataFrame, keys: Sequence[str], rows: int) -> Column:
    """Whether the batch may hold a key: a Bloom filter of one bit per key, 32 bits for each, in one row
    of at most 8 MB.

    It runs in the scan of the stored side, so stored keys that are surely not in the batch are never
    shuffled; those that pass by chance are dropped by the join.
    """
    bits = min(MOST_BITS, max(64, 1 << (32 * max(1, rows) - 1).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    words = batch.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = batch.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("f"))
    word = F.get(packed.select(F.col("f.bits").alias("f")).scalar(), F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def stored_keys(spark: SparkSession, root: str, name: str, batch: DataFrame, rows: int, any_time: bool = False) -> DataFrame:
    """Stored keys that a batch may hold, read from the folders it touches only.

    The time of a transfer is fixed by its block, so its key can't be stored under another month;
    ``any_time`` searches all months, for sources that correct times.
    """
    keys = TABLES[name][1]
    stored = stored_table(spark, root, name)
    if name in DATED_TABLES and not any_time:
        stored = stored.filter(touched_partitions(batch))
    elif name in DATED_TABLES:
        chains = [r["p_chain"] for r in batch.select("p_chain").distinct().collect()]
        stored = stored.filter(F.col("p_chain").isin(chains))
    # The filter costs a shuffle of the batch's keys, so it is for a batch far smaller than what is stored.
    if rows * FILTER_SHARE <= stored.count():
        stored = stored.filter(key_filter(batch, keys, rows))
    return stored.select(*keys)


def insert_absent(spark: SparkSession, root: str, name: str, incoming: DataFrame, any_time: bool = False) -> None:
    """Append rows with new keys only, the first of each key; running it twice adds nothing.

    Keys and folders of the incoming rows are written once and make the key filter, the folders to read and the
    list of new keys, which says whether any row has to move: none if nothing is new, to their folders only if each
    key is new and there once.  The rows themselves are read again, so ``incoming`` must not change in between.
    """
    keys = TABLES[name][1]
    rows = typed_rows(name, incoming)
    narrow = list(dict.fromkeys([*keys, *partition_columns(name)]))
    given, n = stage_counted(_with_partitions(rows, name).select(*narrow), "incoming-keys")
    if not n:
        return
    stored = stored_keys(spark, root, name, given, n, any_time)
    counts = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(stored, keys, "left_anti")
    new, most = stage_counted(counts, "new-keys", F.sum("_n"))
    if most:
        _append(_new_rows(rows, keys, new, whole=most == n), root, name, most)


def _new_rows(rows: DataFrame, keys: list[str], new: DataFrame, whole: bool) -> DataFrame:
    """The first row of every key in ``new``, which are those of all rows if ``whole``."""
    order = [c for c in rows.columns if c not in keys] or keys
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    repeats, loose = new.agg(F.count_if(F.col("_n") > 1), F.count_if(missing)).first()
    if whole:
        return first_of_listed(rows, keys, order, new.filter("_n > 1").select(*keys), repeats)
    found = rows.join(new.select(*keys), keys, "left_semi")
    found = first_rows(found, keys, order) if repeats else found
    # A missing key is equal to none that is stored, so its first row is new every time.
    return found.unionByName(first_rows(rows.filter(missing), keys, order)) if loose else found


def write_case_results(df: DataFrame, path: str, files_per_bucket: int = 1) -> None:
    """Results in hash buckets of the case, so any number of cases makes ``CASE_BUCKETS`` folders.  A salt
    beside the bucket lets a large one use several files instead of one task."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
    rows = df.withColumn("p_bucket", case_bucket(F.col("case_id")).cast("int"))
    rows.repartition("p_bucket", spread).write.mode("overwrite").partitionBy("p_bucket").parquet(path)


def read_case_results(df: DataFrame, case_ids: Sequence[str]) -> DataFrame:
    """Rows of some cases, from their buckets only."""
    buckets = df.sparkSession.createDataFrame([(c,) for c in case_ids], "case_id string").select(
        case_bucket(F.col("case_id")).alias("b")
    )
    wanted = sorted({r["b"] for r in buckets.collect()})
    return df.filter(F.col("p_bucket").isin(wanted) & F.col("case_id").isin(list(case_ids)))


def persist_case_results(spark: SparkSession, root: str, **tables: DataFrame) -> None:
    """Adds attributions, risk events, snapshots of cases to their tables; rows already stored stay as they are."""
    for name, rows in tables.items():
        insert_absent(spark, root, name, rows)


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows with a digest over all their columns."""
    names = [f.name for f in TABLES["audit_log"][0] if f.name != "event_hash"]
    text = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    return events.select(*names, F.sha2(text, 256).alias("event_hash"))


def append_audit(events: DataFrame, root: str, checkpoint: str, stream: str = "audit") -> StreamingQuery:
    """Streams audit rows into the log until the source is used up, each batch exactly once.

    A batch owns the folder of its stream and number and overwrites it: one that is run again after a
    failure, with the same events by the checkpoint, replaces what it had written.
    """
    path = f"{table_path(root, 'audit_log')}_stream/stream={stream}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = audit_rows(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the streamed log."""
    path = f"{table_path(root, 'audit_log')}_stream"
    schema = TABLES["audit_log"][0]
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/stream=*/batch=*").select(*schema.names)

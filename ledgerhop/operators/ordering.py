"""Running sums and row numbers over groups of any size.

A window partitioned by a hot key puts the whole key into one task.  Here rows are
range-partitioned on (keys, order), so a hot key spreads over many partitions; each
partition is summed on its own and shifted by the total of the partitions before it.
Only groups that continue from an earlier partition need a shift, at most one per
partition, so the table of shifts is small whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.staging import stage, stage_counted

# Groups above this many rows are never put into one task.
HOT_ROWS = 1_000_000
# Repeated keys above this many are no short list: joins with it would move all rows, several times.
LISTED = 500_000


def _name(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str,
    fold: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
    include_current: bool = True,
) -> DataFrame:
    order_cols = [_name(c) for c in order]
    end = 0 if include_current else -1
    ranged = stage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_cols).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranged",
    )
    upto = Window.partitionBy(*keys, "_part").orderBy(*order_cols)
    local = ranged.withColumn(
        out, fold(F.col(value)).over(upto.rowsBetween(Window.unboundedPreceding, end))
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.join(F.broadcast(_spanning_keys(ranged, keys)), list(keys), "left_semi")
        .groupBy(*keys, "_part")
        .agg(fold(F.col(value)).alias("_total"))
        .withColumn("_shift", fold(F.col("_total")).over(before))
        .filter(F.col("_shift").isNotNull())
        .drop("_total")
    )
    # At most one shift per range partition: bounded by the partition count.
    joined = local.join(F.broadcast(shifts), [*keys, "_part"], "left")
    kind = local.schema[out].dataType
    return joined.withColumn(out, merge(F.col(out), F.col("_shift")).cast(kind)).drop(
        "_shift", "_part"
    )


def _spanning_keys(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in several range partitions.

    Ranges are ordered, so such a key is the smallest or largest of its partitions: the
    list has at most two rows per partition.
    """
    key = F.struct(*keys)
    ends = ranged.groupBy("_part").agg(F.array(F.min(key), F.max(key)).alias("_ends"))
    return (
        ends.select("_part", F.explode("_ends").alias("_k"))
        .select("_part", "_k.*")
        .groupBy(*keys)
        .agg((F.min("_part") < F.max("_part")).alias("_several"))
        .filter("_several")
        .select(*keys)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the group's rows up to and including this one.

    ``keys`` must not be NULL and ``order`` must be unique inside a group.
    """
    return _running(
        df, keys, order, value, out, F.sum, lambda own, prior: own + F.coalesce(prior, F.lit(0))
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Add ``out``: largest non-NULL ``value`` of the group up to this row."""
    return _running(df, keys, order, value, out, F.max, F.greatest, include_current)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str
) -> DataFrame:
    """``row_number()`` for groups that may hold a large share of all rows."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(counted, keys, order, "_one", out).drop("_one")


def row_numbers_upto(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, largest: int
) -> DataFrame:
    """Row numbers when the largest group is known: a plain window below ``HOT_ROWS`` rows."""
    if largest > HOT_ROWS:
        return row_numbers(df, keys, order, out)
    window = Window.partitionBy(*keys).orderBy(*[_name(c) for c in order])
    return df.withColumn(out, F.row_number().over(window).cast("bigint"))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, out: str
) -> DataFrame:
    """First ``n`` rows per group with their rank.

    Spark cuts every map task to ``n`` rows per group before the shuffle, so the
    final task sees a multiple of ``n`` however large the group is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[_name(c) for c in order]))
    return df.withColumn(out, rank).filter(F.col(out) <= n)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``: an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if rest and set(rest) <= set(order):  # the order is the whole row, so it moves once
        least = F.min(F.struct(*dict.fromkeys(c for c in order if c in rest)))
    else:
        least = F.min_by(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(least.alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_of_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """As :func:`first_rows` where few keys repeat.

    Keys are counted alone (of ``only``, a written table of them, if given); only rows whose key repeats are
    then grouped whole, all others stay where they are.  Where more than ``LISTED`` keys repeat all rows are
    grouped, which moves them once instead of once for each join with the list.  NULL is a key like any other.
    """
    counts = (df if only is None else only).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated, n = stage_counted(counts.select(*keys), "repeated-keys")
    return first_of_listed(df, keys, order, repeated, n)


def first_of_listed(df: DataFrame, keys: Sequence[str], order: Sequence[str], repeated: DataFrame, n: int) -> DataFrame:
    """The first row per key, where ``repeated`` lists the ``n`` values of some or all of the keys that may repeat."""
    if not n:
        return df
    if n > LISTED:
        return first_rows(df, keys, order)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in repeated.columns])
    repeated = repeated.select(*[F.col(k).alias(f"_{k}") for k in repeated.columns])
    alone = df.join(repeated, same, "left_anti")
    return alone.unionByName(first_rows(df.join(repeated, same, "left_semi"), keys, order))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Median per group, the mean of both middle values for even counts.

    Equal values collapse first, then a running count finds the middle positions.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, keys, [value], "_n", "_upto")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)

    def covers(position: Column) -> Column:
        return (F.col("_upto") >= position) & (F.col("_upto") - F.col("_n") < position)

    middle = ranked.join(totals, list(keys)).filter(covers(low) | covers(high))
    return middle.groupBy(*keys).agg(
        ((F.min(value) + F.max(value)) / 2.0).alias(out)
    )


def trailing_counts(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: str
) -> DataFrame:
    """For each distinct (keys, time): sum of ``value`` over the last ``seconds``, inclusive.

    Rows of equal time are combined first.  The sum is the difference of two running
    sums, at the time itself and just before the window opens, so neither a hot key nor a
    burst inside one window has to fit into one task.
    """
    micros = seconds * 1_000_000
    times = df.groupBy(*keys, F.unix_micros(ts).alias("_of")).agg(F.sum(value).alias("_n"))
    marks = F.array(
        F.struct(F.col("_of").alias("_at"), F.lit(1).alias("_kind"), F.col("_n").alias("_n")),
        F.struct((F.col("_of") - micros).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_n")),
    )
    moments = times.select(*keys, "_of", F.explode(marks).alias("_m")).select(*keys, "_of", "_m.*")
    summed = running_sum(moments, keys, ["_at", "_kind"], "_n", "_upto")
    opened = F.when(F.col("_kind") == 0, -F.col("_upto")).otherwise(F.col("_upto"))
    return summed.groupBy(*keys, "_of").agg(F.sum(opened).alias(value)).select(
        *keys, F.timestamp_micros("_of").alias(ts), value
    )

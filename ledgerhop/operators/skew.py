"""Joining against tables where a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.operators.ordering import HOT_ROWS
from ledgerhop.staging import stage_counted

SALT = "_salt"
BUCKETS = 64


@dataclass(frozen=True)
class SaltedTable:
    """A table keyed by ``keys`` whose hot keys are spread over ``buckets`` salts.

    ``hot`` is None when no key is hot; joins then skip the salt altogether.
    """

    table: DataFrame
    keys: tuple[str, ...]
    hot: DataFrame | None
    buckets: int

    def join(self, probe: DataFrame, how: str = "inner") -> DataFrame:
        """Join ``probe`` on the keys; probe rows are copied only for hot keys."""
        keys = list(self.keys)
        if self.hot is None:
            return probe.join(self.table, keys, how)
        marked = probe.join(self.hot, keys, "left")
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(self.buckets - 1))).otherwise(
            F.array(F.lit(0))
        )
        fanned = marked.withColumn(SALT, F.explode(salts)).drop("_hot")
        return fanned.join(self.table, [*keys, SALT], how).drop(SALT)


def salt_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    hot_rows: int = HOT_ROWS,
    buckets: int = BUCKETS,
) -> SaltedTable:
    """Find keys with more than ``hot_rows`` rows and spread them over salts.

    There are at most ``rows / hot_rows`` such keys.  The written size of that list
    tells Spark whether it may be broadcast; there is no hint.
    """
    hot, found = stage_counted(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot")),
        "hot-keys",
    )
    return salt_known_keys(df, keys, spread_on, hot if found else None, buckets)


def salt_known_keys(
    df: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    hot: DataFrame | None,
    buckets: int = BUCKETS,
) -> SaltedTable:
    """Spread the rows of the given hot keys; ``hot`` has the keys and ``_hot``."""
    if hot is None:
        return SaltedTable(df, tuple(keys), None, buckets)
    spread = F.pmod(F.xxhash64(*spread_on), F.lit(buckets)).cast("int")
    salted = df.join(hot, list(keys), "left").withColumn(
        SALT, F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    return SaltedTable(salted.drop("_hot"), tuple(keys), hot, buckets)

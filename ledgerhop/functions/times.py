"""Timestamp parsing; missing or unreadable times stay NULL (no run-time clock)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\d+(\.\d+)?$"


def parse_time(text: Column, millis_above: float | None = None) -> Column:
    """ISO text or epoch seconds; values above ``millis_above`` are milliseconds."""
    number = text.try_cast("double")
    seconds = number if millis_above is None else F.when(
        number > millis_above, number / 1000.0
    ).otherwise(number)
    micros = F.round(seconds * 1e6).cast("bigint")
    return F.when(text.rlike(_NUMBER), F.timestamp_micros(micros)).otherwise(
        F.try_to_timestamp(text)
    )


def parse_tron_time(text: Column) -> Column:
    return parse_time(text, millis_above=1e11)

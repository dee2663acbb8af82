"""SHA-256 of a canonical JSON text of the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(names: list[str]) -> Column:
    """JSON with keys in name order and NULL fields kept."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def row_digest(names: list[str]) -> Column:
    return F.sha2(canonical_json(names), 256)

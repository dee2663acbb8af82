"""All registered queries, imported for their side effect."""

from ledgerhop.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

from ledgerhop.plans.catalog import entities, graphs, lookups, risks, rows, scores, streams  # noqa: E402, F401

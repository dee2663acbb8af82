"""Small transfer graphs used by the tests."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerhop.operators.graph import edge_table
from ledgerhop.schema import TRANSFERS

START = datetime(2026, 3, 14, 8, 0, tzinfo=timezone.utc)


def transfers(spark, rows, chain="ethereum", symbol="ETH", step=60):
    """Rows are (id, from, to, amount[, seconds[, tx]]); times grow by ``step`` seconds."""
    data = []
    for n, row in enumerate(rows):
        tid, sender, receiver, amount = row[:4]
        seconds = row[4] if len(row) > 4 else n * step
        tx = row[5] if len(row) > 5 else f"tx_{tid}"
        ts = None if seconds is None else START + timedelta(seconds=seconds)
        data.append(
            (tid, tx, chain, sender, receiver, "native", symbol, symbol, None, 18, str(amount),
             Decimal(str(amount)), "native", 0, ts, None)
        )
    return spark.createDataFrame(data, TRANSFERS)


def edges(spark, rows, **kwargs):
    return edge_table(transfers(spark, rows, **kwargs))


def case(spark, root, max_hops=3, direction="outgoing", case_id="c1", chain="ethereum"):
    return spark.createDataFrame(
        [(case_id, chain, root, direction, max_hops)],
        "case_id string, chain string, root string, direction string, max_hops int",
    )


def labels(spark, rows):
    """Rows are (node, name, type) of Ethereum."""
    return spark.createDataFrame(
        rows, "node string, entity_name string, entity_type string"
    ).withColumns({"chain": F.lit("ethereum"), "confidence": F.lit(0.95), "label_source": F.lit("test")})


def nodes_of(traced):
    return {r["node"]: r["hop"] for r in traced.select("node", "hop").collect()}

"""Registered queries agree with their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

from ledgerhop.plans.catalog import QUERIES, SQL
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "e8_hop_layers", "e19_attribution_paths", "e2_unique_edge_keys", "g8_g9_g10_scores", "r9_rapid_relays",
    "r14_reconvergence", "d16_wallet_summary", "f3_registry_resolution", "b17_b18_explorer_transfers",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not mounted")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())

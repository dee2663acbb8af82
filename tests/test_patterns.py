"""Ordering helpers and timed patterns against brute force on random transfers."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerhop.operators import ordering, risk
from samples import edges

SCOPE = ["chain"]


@pytest.fixture(scope="module")
def rows():
    """A third of all transfers leave or reach one hub."""
    rng = random.Random(11)
    out = []
    for n in range(240):
        a, b = f"n{rng.randrange(8)}", f"n{rng.randrange(8)}"
        if n % 3 == 0:
            a = "hub"
        elif n % 3 == 1:
            b = "hub"
        out.append((f"t{n:03d}", a, b, rng.randrange(1, 50), rng.randrange(0, 4000)))
    return out


def test_running_sums_match_brute_force(spark, rows):
    df = spark.createDataFrame([(r[1], r[4], r[0], r[3]) for r in rows], "k string, s int, id string, v long")
    got = ordering.running_sum(df, ["k"], ["s", "id"], "v", "total").collect()
    ranks = {r["id"]: r["n"] for r in ordering.row_numbers(df, ["k"], ["s", "id"], "n").collect()}
    for r in got:
        before = [x for x in rows if x[1] == r["k"] and (x[4], x[0]) <= (r["s"], r["id"])]
        assert r["total"] == sum(x[3] for x in before)
        assert ranks[r["id"]] == len(before)


def test_groups_spanning_partitions_are_shifted(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.row_numbers(df, ["k"], ["id"], "n")
        assert got.filter("k = 'hot'").agg(F.max("n"), F.count_distinct("n")).first()[:] == (1667, 1667)
        assert got.groupBy("k").agg((F.max("n") == F.count("*")).alias("ok")).filter("not ok").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_max_ignores_null(spark):
    df = spark.createDataFrame([("k", n, v) for n, v in enumerate([None, 5, None, 3, 9])], "k string, n int, v int")
    got = ordering.running_max(df, ["k"], ["n"], "v", "m").orderBy("n").collect()
    assert [r["m"] for r in got] == [None, 5, 5, 5, 9]
    before = ordering.running_max(df, ["k"], ["n"], "v", "m", include_current=False).orderBy("n").collect()
    assert [r["m"] for r in before] == [None, None, 5, 5, 5]


def test_exact_median(spark, rows):
    df = spark.createDataFrame([(r[1], float(r[3])) for r in rows], "k string, v double")
    got = {r["k"]: r["m"] for r in ordering.exact_median(df, ["k"], "v", "m").collect()}
    keys = {r[1] for r in rows}
    assert got == {k: statistics.median(float(r[3]) for r in rows if r[1] == k) for k in keys}


def test_first_and_top_rows(spark, rows):
    df = spark.createDataFrame([(r[1], r[4], r[0]) for r in rows], "k string, s int, id string")
    first = {r["k"]: r["id"] for r in ordering.first_rows(df, ["k"], ["s", "id"]).collect()}
    top = ordering.top_rows(df, ["k"], ["s", "id"], 2, "n").collect()
    for k in {r[1] for r in rows}:
        ordered = [i for _, i in sorted((x[4], x[0]) for x in rows if x[1] == k)]
        assert first[k] == ordered[0]
        assert [r["id"] for r in sorted(top, key=lambda r: r["n"]) if r["k"] == k] == ordered[:2]


def test_bursts(spark, rows):
    got = {(r["source"], r["s"]): r["transfers"] for r in risk.fan_out_bursts(edges(spark, rows), SCOPE, 4, 300).select(
        "source", F.unix_seconds("ts").alias("s"), "transfers").collect()}
    base = edges(spark, rows).agg(F.min(F.unix_seconds("ts"))).first()[0] - min(r[4] for r in rows)
    want = {}
    for r in rows:
        n = sum(1 for x in rows if x[1] == r[1] and r[4] - 300 <= x[4] <= r[4])
        if n >= 4:
            want[r[1], base + r[4]] = n
    assert got == want


def _inflow(rows, r):
    times = [x[4] for x in rows if x[2] == r[1] and x[1] != x[2] and x[4] <= r[4]]
    return max(times) if times else None


def test_last_inflow_and_relays(spark, rows):
    found = risk.last_inflow(edges(spark, rows), SCOPE)
    got = {r["transfer_id"]: r["h"] for r in found.select("transfer_id", risk.held_seconds().alias("h")).collect()}
    held = {r[0]: (None if _inflow(rows, r) is None else float(r[4] - _inflow(rows, r))) for r in rows}
    assert got == held
    slow = {r["node"]: r["median_held"] for r in risk.rapid_relays(found, SCOPE, 60).collect()}
    for node in {r[1] for r in rows}:
        values = [held[r[0]] for r in rows if r[1] == node and held[r[0]] is not None]
        if values and statistics.median(values) <= 60:
            assert slow.pop(node) == statistics.median(values)
    assert not slow


def test_rapid_layering(spark, rows):
    got = {r["transfer_id"]: r["elapsed"] for r in risk.rapid_layering(edges(spark, rows), SCOPE, 3, 200).collect()}
    starts = {r[0]: r[4] for r in rows}
    for _ in range(2):
        nxt = {}
        for r in rows:
            prior = [starts[x[0]] for x in rows if x[2] == r[1] and x[4] < r[4] and starts.get(x[0]) is not None]
            nxt[r[0]] = max(prior) if prior else None
        starts = nxt
    want = {r[0]: float(r[4] - starts[r[0]]) for r in rows if starts[r[0]] is not None and r[4] - starts[r[0]] < 200}
    assert got == want


def test_smurfing_counts_small_transfers_of_funded_senders(spark):
    rows = [("t0", "boss", "mule", 100, 0)] + [(f"t{n}", "mule", f"d{n}", 3, n * 60) for n in range(1, 6)]
    rows += [(f"u{n}", "origin", f"e{n}", 3, n * 60) for n in range(5)]
    got = risk.smurfing(edges(spark, rows), SCOPE, "10").collect()
    assert {r["node"] for r in got} == {"mule"} and max(r["small"] for r in got) == 5


def test_fragmentation(spark):
    rows = [("i", "boss", "x", 30, 0), ("a", "x", "p", "10.0", 10), ("b", "x", "q", "10.2", 20), ("c", "x", "r", "9.9", 30),
            ("j", "boss", "y", 30, 0), ("d", "y", "p", 25, 10), ("e", "y", "q", 1, 20), ("f", "y", "r", 2, 30)]
    found = risk.fragmentation(risk.last_inflow(edges(spark, rows), SCOPE), SCOPE).collect()
    assert [(r["node"], r["parts"]) for r in found] == [("x", 3)]


def test_peel_chain(spark):
    rows, holder = [], "a0"
    for n in range(3):
        rows += [(f"l{n}", holder, f"a{n + 1}", "9.5"), (f"s{n}", holder, f"b{n}", "0.5")]
        holder = f"a{n + 1}"
    got = risk.peel_chains(edges(spark, rows), SCOPE).collect()
    assert [(r["head"], r["nodes"], r["change_address"]) for r in got] == [("a0", ["a0", "a1", "a2"], "a3")]
    assert risk.peel_chains(edges(spark, rows), SCOPE, steps=4).count() == 0


def test_reconvergence(spark, rows):
    extra = [(f"x{n}", "src", f"m{n}", 1) for n in range(7)] + [(f"y{n}", f"m{n}", "dst", 1) for n in range(7)]
    e = edges(spark, [r[:4] for r in rows] + extra)
    pairs = {(r[1], r[2]) for r in [*rows, *extra] if r[1] != r[2]}
    for limit in (2, 5):
        want = {}
        for a, m in pairs:
            for m2, b in pairs:
                if m == m2 and a != b:
                    want[a, b] = want.get((a, b), 0) + 1
        want = {k: v for k, v in want.items() if v > limit}
        got = {(r["source"], r["target"]): r["middles"] for r in risk.reconvergence(e, SCOPE, limit).collect()}
        assert got == want
    assert ("src", "dst") in want


def test_anomalies(spark):
    rows = [(f"t{n}_{k}", f"n{n}", "z", 10 + n) for n in range(9) for k in range(2)]
    rows += [(f"big{k}", "whale", "z", 5000) for k in range(60)]
    top = risk.wallet_anomalies(edges(spark, rows), SCOPE).orderBy(F.desc("anomaly_score")).first()
    assert top["node"] == "whale"

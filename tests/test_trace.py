"""Tracing, paths and graph tables on small topologies."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerhop.operators import graph, noise, ordering, paths, trace
from ledgerhop.plans.investigate import case_graph, investigate
from ledgerhop.sources import files
from samples import case, edges, labels, nodes_of, transfers

NO_LABELS = [("nobody", "Nobody", "UNKNOWN")]


def traced(spark, rows, root, hops=3, direction="outgoing", **budget):
    e = edges(spark, rows)
    around = trace.neighbour_table(e, [direction], detail=True)
    return e, trace.trace_with_budget(case(spark, root, hops, direction), around, **budget)


CHAIN = [("t1", "root", "a", 1), ("t2", "a", "b", 1), ("t3", "b", "c", 1), ("t4", "c", "d", 1)]


def test_hop_limit(spark):
    assert nodes_of(traced(spark, CHAIN, "root", 2)[1]) == {"root": 0, "a": 1, "b": 2}


def test_backward_trace(spark):
    got = traced(spark, CHAIN, "d", 2, "incoming")[1]
    assert nodes_of(got) == {"d": 0, "c": 1, "b": 2}


def test_cycle_counts_each_node_once(spark):
    rows = [("t1", "root", "h1", 1), ("t2", "h1", "h2", 1), ("t3", "h1", "root", 1)]
    _, got = traced(spark, rows, "root", 3)
    assert nodes_of(got) == {"root": 0, "h1": 1, "h2": 2}
    assert got.select("first.tx_hash").distinct().filter("tx_hash is not null").count() == 2


def test_transaction_budget(spark):
    rows = [(f"t{n}", "root", f"d{n}", 1) for n in range(10)]
    e, got = traced(spark, rows, "root", 2, max_transactions=3)
    assert set(nodes_of(got)) == {"root", "d0", "d1", "d2"}
    g = case_graph(case(spark, "root", 2), e, labels(spark, NO_LABELS), max_transactions=3)
    row = trace.trace_summary(g.cases, g.traced, g.edges, 3).first()
    assert (row["transactions"], row["termination_reason"]) == (3, "TRANSACTION_LIMIT_REACHED")
    reasons = {r["node"]: r["boundary_reason"] for r in g.traced.collect()}
    assert reasons["d0"] == "TRANSACTION_LIMIT_REACHED"


def test_node_budget(spark):
    rows = [(f"t{n}", "root", f"d{n}", 1) for n in range(10)]
    assert len(nodes_of(traced(spark, rows, "root", 2, max_nodes=4)[1])) == 4


def test_termination_reasons(spark):
    e = edges(spark, CHAIN)
    for root, hops, reason in (("root", 2, "MAX_HOPS_REACHED"), ("root", 5, "NATURAL_TERMINATION"), ("zz", 2, "EMPTY_WALLET")):
        g = case_graph(case(spark, root, hops), e, labels(spark, NO_LABELS))
        row = trace.trace_summary(g.cases, g.traced, g.edges).first()
        assert row["termination_reason"] == reason
        assert row["nodes"] == g.nodes.count()


def test_salted_tables_give_the_same_trace(spark):
    rng = random.Random(7)
    rows = [(f"t{n}", "hub" if n % 3 else f"n{rng.randrange(9)}", f"n{rng.randrange(40)}", 1) for n in range(300)]
    rows += [(f"u{n}", f"n{n}", "hub", 1) for n in range(40)]
    e = edges(spark, rows)
    plain = trace.neighbour_table(e, detail=True)
    salted = trace.neighbour_table(e, detail=True, hot_rows=10)
    assert plain.pairs.hot is None and salted.pairs.hot.count() > 0 and salted.busy.count() > 0
    cases = case(spark, "n1", 4)
    a, b = (trace.trace_with_budget(cases, t, paths=True) for t in (plain, salted))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    x, y = (trace.trace_edges(e, t, n).select("case_id", "transfer_id") for t, n in ((a, plain), (b, salted)))
    assert sorted(x.collect()) == sorted(y.collect())


def test_bucketed_pairs_are_not_shuffled_again(spark):
    rng = random.Random(5)
    rows = [(f"t{n}", f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", 1) for n in range(200)]
    e = edges(spark, rows)
    cases = case(spark, "n1", 4)
    bucketed = trace.neighbour_table(e, buckets=4)
    want = nodes_of(trace.trace_nodes(cases, trace.neighbour_table(e)))
    assert nodes_of(trace.trace_nodes(cases, bucketed)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probe = trace.start_nodes(cases).repartition(4)
        plan = bucketed.pairs.join(probe)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1
        assert nodes_of(trace.trace_nodes(cases, trace.neighbour_table(e, hot_rows=5, buckets=4))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_any_direction_expands_to_recipients(spark):
    rows = [("t1", "x", "root", 1), ("t2", "root", "a", 1), ("t3", "w", "x", 1)]
    e = edges(spark, rows)
    cases = case(spark, "root", 3, "any")
    around = trace.neighbour_table(e, ["any"])
    got = trace.trace_nodes(cases, around)
    assert set(nodes_of(got)) == {"root", "a"}
    ids = {r["transfer_id"] for r in trace.trace_edges(e, got, around, ["any"]).collect()}
    assert ids == {"t1", "t2"}
    both = trace.trace_nodes(cases, trace.neighbour_table(e, ["any"], any_expand="both"))
    assert set(nodes_of(both)) == {"root", "a", "x", "w"}


def test_root_fallback(spark):
    e = edges(spark, [("t1", "proxy", "b", 5, 0, "X"), ("t2", "a", "c", 1, 1, "Y")])
    transactions = spark.createDataFrame(
        [("X", "ethereum", "root", "z"), ("Y", "ethereum", "a", "c")],
        "tx_hash string, chain string, sender string, recipient string",
    )
    cases = case(spark, "root").union(case(spark, "a", case_id="c2"))
    got = trace.fallback_edges(cases, e, transactions).collect()
    assert [(r["source"], r["target"], r["transfer_id"]) for r in got] == [("root", "b", "t1")]


def test_forward_closure(spark):
    rows = [*CHAIN, ("t5", "x", "y", 1), ("t6", "q", "b", 1)]
    roots = spark.createDataFrame([("c", "ethereum", "a")], "case_id string, chain string, root string")
    got = {r["transfer_id"] for r in trace.forward_closure(edges(spark, rows), roots).collect()}
    assert got == {"t1", "t2", "t3", "t4", "t6"}


def test_attribution_path_forward_and_backward(spark):
    rows = [("t1", "s", "a", 1), ("t2", "a", "b", 1), ("t3", "b", "svc", 1), ("t9", "s", "z", 1)]
    e = edges(spark, rows)
    trees = paths.path_trees(case(spark, "s", 5), trace.neighbour_table(e, detail=True))
    row = trees.filter("node = 'svc'").first()
    assert (row["path"], row["transfer_ids"], row["hop"]) == (["s", "a", "b", "svc"], ["t1", "t2", "t3"], 3)

    back = edges(spark, [("t1", "svc", "c", 1), ("t2", "c", "s", 1)])
    cases = case(spark, "s", 5, "incoming")
    trees = paths.path_trees(cases, trace.neighbour_table(back, ["incoming"], detail=True))
    row = trees.filter("node = 'svc'").first()
    assert (row["path"], row["transfer_ids"]) == (["s", "c", "svc"], ["t2", "t1"])

    missing = spark.createDataFrame([("c1", "nowhere")], "case_id string, node string")
    row = paths.attribution_paths(trees, cases, missing).first()
    assert (row["path"], row["transfer_ids"]) == (["s", "nowhere"], [])
    assert paths.shortest_paths(trees, missing).first()["path"] is None


def test_shortest_against_highest_value(spark):
    e = edges(spark, [("d", "s", "t", "0.1"), ("x", "s", "m", 100), ("y", "m", "t", 100)])
    trees = paths.path_trees(case(spark, "s"), trace.neighbour_table(e, detail=True))
    assert trees.filter("node = 't'").first()["path"] == ["s", "t"]
    best = paths.highest_value_paths(case(spark, "s"), e).filter("node = 't'").first()
    assert best["path"] == ["s", "m", "t"] and best["cost"] == pytest.approx(0.02)
    wide = paths.highest_value_paths(case(spark, "s"), e, bottleneck=True).filter("node = 't'").first()
    assert wide["value"] == 100.0
    assert graph.asset_volumes(e, ["chain"]).first()["volume"] == Decimal("200.1")


def test_path_listing_and_cycles(spark):
    rows = [("t1", "s", "a", 1), ("t2", "a", "b", 1), ("t3", "b", "s", 1), ("t4", "s", "b", 1)]
    e = edges(spark, rows)
    around = trace.neighbour_table(e, detail=True)
    trees = paths.path_trees(case(spark, "s"), around)
    listed = sorted(r["path"] for r in paths.path_listing(trees, around).collect())
    assert listed == [["s", "a"], ["s", "a", "b"], ["s", "b"]]
    flagged = paths.cycle_edges(trace.trace_edges(e, trees, around), trees)
    assert {r["transfer_id"] for r in flagged.filter("is_cycle").collect()} == {"t3"}


def test_node_table_keeps_first_spelling_and_labels(spark):
    e = edges(spark, [("t1", "Root", "AbC", 1), ("t2", "root", "aBc", 1), ("t3", "ABC", "d", 1)])
    g = case_graph(case(spark, "root"), e, labels(spark, [("abc", "Kraken", "VASP_HOT")]))
    rows = {r["node"]: r for r in g.nodes.collect()}
    assert rows["abc"]["address"] == "AbC" and rows["abc"]["node_type"] == "VASP_HOT"
    assert rows["root"]["node_type"] == "SUSPECT" and rows["root"]["address"] == "Root"
    assert rows["d"]["node_type"] == "INTERMEDIARY" and rows["d"]["confidence"] == 1.0
    assert g.edges.count() == 3


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_edge_keys_stay_unique(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ordering, "HOT_ROWS", hot_rows)
    rows = [("t1", "a", "b", 1, 0, "x"), ("t1", "a", "b", 2, 1, "x"), ("t1", "a", "b", 3, 2, "x"), ("x_0", "a", "b", 4, 3, "x"),
            ("", "a", "b", 5, 4, "y"), ("t2", "a", "c", 6, 5, "z")]
    got = graph.unique_edge_keys(edges(spark, rows), ["chain"], ["ts", "amount"])
    keys = {int(r["amount"]): r["edge_key"] for r in got.collect()}
    assert len(set(keys.values())) == 6
    assert keys[1] == "t1" and keys[4] == "x_0" and keys[5] == "y_0" and keys[6] == "t2"
    assert {keys[2], keys[3]} == {"x_0_2", "x_0_3"}


def test_deterministic_order_under_shuffled_input(spark):
    rows = [(f"t{n}", f"n{n % 4}", f"n{(n * 3) % 7}", n + 1, (n * 37) % 11) for n in range(20)]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    results = []
    for part in (rows, shuffled):
        numbered = graph.number_edges(edges(spark, part).withColumn("case_id", F.lit("c")))
        results.append(sorted((r["edge_order"], r["transfer_id"]) for r in numbered.collect()))
    assert results[0] == results[1]
    assert [n for n, _ in results[0]] == list(range(1, 21))


def test_noise_filters(spark):
    rows = transfers(spark, [("big", "s", "a", 5, 0), ("dust", "s", "b", "0.00005", 60)])
    usdt = transfers(spark, [("usdt", "s", "c", 1000, 7200)], symbol="USDT")
    g = case_graph(case(spark, "s"), graph.edge_table(rows.union(usdt)), labels(spark, NO_LABELS))
    kept = noise.filter_edges(g.edges)
    assert kept.count() == 2
    assert noise.filter_edges(g.edges, assets=["usdt"]).count() == 1
    assert noise.filter_edges(g.edges, end="2026-03-14 08:30:00").count() == 1
    nodes = noise.keep_touched_nodes(g.nodes, noise.filter_edges(g.edges, "2000"))
    assert [r["node"] for r in nodes.collect()] == ["s"]
    none = noise.filtered_totals(g.cases, nodes, g.edges.limit(0)).first()
    assert (none["total_nodes"], none["total_edges"], none["hop_depth"]) == (1, 0, 0)


def test_dust_kept_when_it_is_most_of_the_outflow(spark):
    e = edges(spark, [("a", "s", "x", "0.00005"), ("b", "r", "x", "0.00005"), ("c", "r", "x", 5)])
    assert {r["transfer_id"] for r in noise.drop_dust(e, ["chain"]).collect()} == {"a", "c"}


def test_batch_investigation_mixes_directions(spark):
    rows = [("t1", "s", "a", 1), ("t2", "a", "svc", 1), ("t3", "svc", "q", 1), ("t1", "s", "a", 1)]
    cases = case(spark, "s", 3).union(case(spark, "Q", 2, "incoming", "c2"))
    records = spark.createDataFrame(
        [(0, 0, "svc", "eth", "e1", "Kraken", None, "VASP", None, None, None, None, None, None)],
        """file_no int, position int, address string, chain string, entity_id string, entity_name string, name string,
        entity_type string, vasp_status boolean, confidence double, label_source string, source string,
        source_reference string, notes string""",
    )
    result = investigate(cases, transfers(spark, rows), labels(spark, [("svc", "Kraken", "VASP")]), files.registry(records))
    found = {r["case_id"]: r for r in result.attributions.collect()}
    assert found["c1"]["path"] == ["s", "a", "svc"] and found["c1"]["transfer_ids"] == ["t1", "t2"]
    assert found["c2"]["path"] == ["q", "svc"] and found["c2"]["transfer_ids"] == ["t3"]
    sizes = {r["case_id"]: (r["nodes"], r["edges"]) for r in result.summary.collect()}
    assert sizes == {"c1": (4, 3), "c2": (3, 2)}
    statuses = {r["address"]: r["resolution_status"] for r in result.resolutions.collect()}
    assert statuses["svc"] == "RESOLVED" and statuses["a"] == "NOT_FOUND"


def test_made_up_edge_keys_never_meet_plain_ids(spark):
    rows = [("x_0", "x", i, n) for n, i in enumerate([0, 0, 0, 0])] + [("x_0_2", "x", 1, 9), ("x_0_3", "y", 1, 10)]
    edges = spark.createDataFrame(rows, "transfer_id string, tx_hash string, transfer_index int, n int").withColumn("chain", F.lit("e"))
    keys = [r["edge_key"] for r in graph.unique_edge_keys(edges, ["chain"], ["n"]).collect()]
    assert len(keys) == len(set(keys)) == 6
    assert {"x_0", "x_0_2", "x_0_3"} <= set(keys)


def test_one_exchange_of_reached_nodes_per_hop(spark):
    e = edges(spark, [("t1", "a", "b", 5), ("t2", "b", "c", 5)])
    around = trace.neighbour_table(e)
    start = trace.start_nodes(case(spark, "a"))
    reached = around.pairs.join(start).select(*trace.CASE_COLUMNS, F.col("nxt").alias("node")).distinct()
    keys = [*trace.CASE_COLUMNS, "node"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = reached.join(start.select(*keys), keys, "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One for each side of the neighbour join, one for the distinct rows, one for what was visited.
    assert plan.count("Exchange hashpartitioning") == 4


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def repeated_edges(spark):
    """Copies of one id, positions that are ids themselves, and edges without a chain."""
    rows = [(c, f"t{n % 4}" if n % 3 else f"x{n % 2}_1", f"x{n % 2}", n % 2, n) for n in range(40) for c in ("eth", None)]
    return spark.createDataFrame(rows, "chain string, transfer_id string, tx_hash string, transfer_index int, n int")


def test_edge_keys_with_many_repeats(spark, monkeypatch):
    """The same keys with a short and a long list of repeats; numbering is read, not run again."""
    few = graph.unique_edge_keys(repeated_edges(spark), ["chain"], ["n"])
    monkeypatch.setattr(graph, "LISTED", 0)
    many = graph.unique_edge_keys(repeated_edges(spark), ["chain"], ["n"])
    assert few.columns == many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "Window" not in plan_of(few) and "Window" not in plan_of(many)


def test_first_of_many_repeats_moves_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([(n % 5 if n % 7 else None, n, str(n)) for n in range(50)] + [(9, 1, "a")], "k int, n int, v string")
    listed = ordering.first_of_repeats(df, ["k"], ["n"]).collect()
    monkeypatch.setattr(ordering, "LISTED", 0)
    grouped = ordering.first_of_repeats(df, ["k"], ["n"])
    assert sorted(map(str, listed)) == sorted(map(str, grouped.collect())) and len(listed) == 7
    assert "Join" not in plan_of(grouped)


def random_any(spark, repeats):
    rng = random.Random(5)
    rows = [("eth", rng.choice("abcdef"), rng.choice("abcdef"), f"t{n % repeats}" if n % 11 else None, f"x{n}", n) for n in range(60)]
    return spark.createDataFrame(rows, "chain string, source string, target string, transfer_id string, tx_hash string, n int").selectExpr("*", "timestamp_seconds(n) ts")


@pytest.mark.parametrize("repeats", [60, 25])
def test_edges_of_both_ends_once(spark, repeats):
    """Each transfer once per case, the first one of an id that repeats, however many ends are looked at."""
    edges = random_any(spark, repeats)
    cases = spark.createDataFrame(
        [("c1", "eth", "a", "any", 1), ("c2", "eth", "b", "any", 2), ("c3", "eth", "c", "outgoing", 1), ("c4", "eth", "d", "incoming", 1)],
        "case_id string, chain string, root string, direction string, max_hops int",
    )
    ways = ["any", "outgoing", "incoming"]
    table = trace.neighbour_table(edges, ways)
    traced = trace.trace_nodes(cases, table)
    got = trace.trace_edges(edges, traced, table, ways)
    near = [r for r in traced.collect() if r["hop"] < r["max_hops"]]
    want = {}
    for e in sorted(edges.collect(), key=lambda e: e["n"]):
        for r in near:
            if e["source"] == r["node"] and r["direction"] != "incoming" or e["target"] == r["node"] and r["direction"] != "outgoing":
                want.setdefault((r["case_id"], e["transfer_id"]), e["tx_hash"])
    rows = got.collect()
    assert len(rows) == len(want) and {(r["case_id"], r["transfer_id"]): r["tx_hash"] for r in rows} == want


def test_edges_of_both_ends_are_not_grouped(spark):
    """Ids that don't repeat need no grouping of whole edges."""
    edges = random_any(spark, 60).filter("transfer_id is not null")
    table = trace.neighbour_table(edges, ["any"])
    cases = spark.createDataFrame([("c", "eth", "a", "any", 2)], "case_id string, chain string, root string, direction string, max_hops int")
    assert "Aggregate" not in plan_of(trace.trace_edges(edges, trace.trace_nodes(cases, table), table, ["any"]))


def test_wide_rounds_find_the_same_nodes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("eth", f"s{n % 30}" if n % 2 else f"m{n % 5}", f"m{rng.randrange(5)}", f"t{n}") for n in range(200)]
    edges = spark.createDataFrame(rows, "chain string, source string, target string, transfer_id string")
    cases = spark.createDataFrame(
        [(f"c{n}", "eth", f"s{n}", "outgoing", 1 + n % 3) for n in range(30)],
        "case_id string, chain string, root string, direction string, max_hops int",
    )
    table = trace.neighbour_table(edges)
    plain = sorted(map(str, trace.trace_nodes(cases, table).collect()))
    for rows_listed in (500_000, 0):
        monkeypatch.setattr(trace, "WIDE_ROUND", 0)
        monkeypatch.setattr(trace, "LISTED", rows_listed)
        assert sorted(map(str, trace.trace_nodes(cases, table).collect())) == plain

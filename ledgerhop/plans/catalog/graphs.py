"""Queries: edge and node tables, traces, traversal, paths."""

from pyspark.sql import functions as F

from ledgerhop.operators import graph, paths, trace
from ledgerhop.operators.ordering import first_rows
from ledgerhop.plans.catalog.registry import GRAPH, TR, TRACE, query
from ledgerhop.plans.catalog.shared import base_edges, labels_table, traced_graph
from ledgerhop.plans.investigate import case_graph
from ledgerhop.sources import bench_tables as tables
from ledgerhop.staging import stage


def _double(name):
    return F.col(name).cast("double").alias(name)


@query(
    "e1_edge_table",
    f"""WITH {TR} SELECT transfer_id, f AS source, t AS target, asset_id, asset_symbol,
  CAST(amount AS DOUBLE) AS amount, CASE WHEN asset_type = 'native' THEN 'NATIVE' ELSE 'TOKEN' END AS transfer_type,
  'TRANSFER' AS edge_type, 'ev_' || substr(tx_hash, 1, 10) AS evidence_ref FROM tr""",
)
def _(spark, sf):
    return base_edges(spark, sf).select(
        "transfer_id", "source", "target", "asset_id", "asset_symbol", _double("amount"),
        "transfer_type", "edge_type", "evidence_ref",
    )


_LI = """li AS (SELECT 'o' || l_orderkey || '_' || l_linenumber AS transfer_id, 'o' || l_orderkey AS tx_hash,
  l_linenumber, 'c' || o_custkey AS f, 's' || l_suppkey AS t, l_partkey, l_shipdate,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "e2_unique_edge_keys",
    f"""WITH {_LI}, c AS (SELECT transfer_id, row_number() OVER (PARTITION BY transfer_id
  ORDER BY l_shipdate, l_partkey, t, amount) AS n FROM li)
SELECT CASE WHEN n = 1 THEN transfer_id ELSE transfer_id || '_' || n END AS edge_key, count(*) AS edges
FROM c GROUP BY 1""",
)
def _(spark, sf):
    # The joined input is read several times, so it is written once.
    li = stage(tables.order_transfers(spark, sf), "order-transfers")
    # The natural key equals ``{tx}_{index}`` here, so repeats end in a running number.
    keyed = graph.unique_edge_keys(li, ["chain"], ["ts", "part_key", "to_address", "amount"])
    return keyed.groupBy("edge_key").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "e3_node_table",
    f"""WITH RECURSIVE {GRAPH}
SELECT nd.case_id, nd.node, nd.node_type, CASE WHEN is_root THEN 'Suspect Wallet' ELSE lb.entity_name END AS label,
  CAST(CASE WHEN is_root OR lb.node IS NULL THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence
FROM nd LEFT JOIN lb ON lb.node = nd.node""",
)
def _(spark, sf):
    return traced_graph(spark, sf).nodes.select("case_id", "node", "node_type", "label", "confidence")


@query(
    "e3_first_seen_spelling",
    """WITH x AS (SELECT ts, event_id, CASE WHEN event_type = 'view' THEN '0xA' ELSE '0xa' END || user_id AS f,
  CASE WHEN event_type = 'error' THEN '0xA' ELSE '0xa' END || regexp_extract(props, '"k": ([0-9]+)', 1) AS t FROM events),
s AS (SELECT lower(f) AS node, f AS address, ts, 'x' || event_id AS h, 0 AS side FROM x
  UNION ALL SELECT lower(t), t, ts, 'x' || event_id, 1 FROM x)
SELECT node, address FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, h, side) AS n FROM s) y WHERE n = 1""",
)
def _(spark, sf):
    big, small = F.lit("0xA"), F.lit("0xa")
    kind, event = F.col("event_type"), F.col("event_id")
    tr = tables.load(spark, sf, "events").select(
        F.concat(F.lit("t"), event).alias("transfer_id"),
        F.concat(F.lit("x"), event).alias("tx_hash"),
        F.lit("ethereum").alias("chain"),
        F.concat(F.when(kind == "view", big).otherwise(small), "user_id").alias("from_address"),
        F.concat(
            F.when(kind == "error", big).otherwise(small), F.get_json_object("props", "$.k")
        ).alias("to_address"),
        F.lit("ETH").alias("asset_symbol"),
        F.lit("ETH").alias("asset_id"),
        F.col("value").cast("decimal(38,18)").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("native").alias("transfer_type"),
        F.lit(None).cast("string").alias("evidence_ref"),
        F.lit(0).alias("transfer_index"),
    )
    ends = graph.edge_ends(graph.edge_table(tr))
    return first_rows(
        ends.select("node", "address", *graph.EDGE_ORDER, "side"), ["node"], [*graph.EDGE_ORDER, "side"]
    ).select("node", "address")


@query(
    "e4_boundary_annotation",
    f"""WITH RECURSIVE {GRAPH}, b AS (SELECT case_id, node, CASE WHEN hop = 3 AND node IN (SELECT node FROM pairs)
  THEN 'MAX_HOPS_REACHED' END AS reason FROM traced),
eb AS (SELECT ce.case_id, count(*) AS n FROM ce JOIN b ON b.case_id = ce.case_id AND b.node = ce.t
  WHERE b.reason IS NOT NULL GROUP BY ce.case_id)
SELECT b.case_id, count(*) AS boundary_nodes, coalesce(max(eb.n), 0) AS boundary_edges
FROM b LEFT JOIN eb ON eb.case_id = b.case_id WHERE reason = 'MAX_HOPS_REACHED' GROUP BY b.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    nodes = g.nodes.filter("boundary_reason = 'MAX_HOPS_REACHED'").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("boundary_nodes")
    )
    edges = g.edges.groupBy("case_id").agg(F.count_if("is_boundary").alias("boundary_edges"))
    return nodes.join(edges, "case_id")


@query(
    "e4_one_hop_boundaries",
    f"""WITH {TR}, cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
b AS (SELECT DISTINCT case_id, root, t AS node FROM cases JOIN tr ON f = root WHERE t <> root AND t IN (SELECT f FROM tr))
SELECT b.case_id, count(DISTINCT node) AS boundary_nodes, count(*) AS boundary_edges
FROM b JOIN tr ON f = root AND t = node GROUP BY b.case_id""",
)
def _(spark, sf):
    """Traces of one hop end at nodes that send on: they and the edges to them are boundaries."""
    g = traced_graph(spark, sf, max_hops=1)
    nodes = g.nodes.filter("boundary_reason = 'MAX_HOPS_REACHED'").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("boundary_nodes")
    )
    edges = g.edges.groupBy("case_id").agg(F.count_if("is_boundary").alias("boundary_edges"))
    return nodes.join(edges, "case_id")


@query(
    "e5_edge_hops",
    f"WITH RECURSIVE {GRAPH} SELECT case_id, transfer_id, hop FROM ce",
)
def _(spark, sf):
    return traced_graph(spark, sf).edges.select("case_id", "transfer_id", "hop")


@query(
    "e6_backward_hop_distance",
    f"""WITH RECURSIVE {TR}, e AS (SELECT * FROM tr),
cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
r(case_id, node, hop) AS (SELECT case_id, root, 0 FROM cases
  UNION SELECT r.case_id, e.f, hop + 1 FROM r JOIN e ON e.t = r.node WHERE hop < 5)
SELECT case_id, node, min(hop) AS hop FROM r GROUP BY case_id, node""",
)
def _(spark, sf):
    cases = tables.nation_cases(spark, sf, max_hops=5, direction="incoming")
    pairs = trace.neighbour_table(base_edges(spark, sf), ["incoming"])
    return trace.trace_nodes(cases, pairs).select("case_id", "node", "hop")


@query(
    "e7_deterministic_order",
    f"""WITH RECURSIVE {GRAPH}
SELECT case_id, 'node' AS kind, node AS id, row_number() OVER (PARTITION BY case_id ORDER BY is_root DESC, node) AS position FROM nd
UNION ALL SELECT case_id, 'edge', transfer_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, tx_hash, transfer_id) FROM ce""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    nodes = graph.number_nodes(g.nodes).select(
        "case_id", F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("node_order").alias("position")
    )
    edges = graph.number_edges(g.edges).select(
        "case_id", F.lit("edge"), "transfer_id", "edge_order"
    )
    return nodes.union(edges)


@query(
    "e7_graph_totals",
    f"""WITH RECURSIVE {GRAPH}, m AS (SELECT case_id, count(*) AS k FROM ce GROUP BY case_id)
SELECT nd.case_id, count(*) AS total_nodes, coalesce(max(k), 0) AS total_edges,
  max(CASE WHEN hop = 3 AND node IN (SELECT node FROM pairs) THEN 0 ELSE hop END) AS hop_depth
FROM nd LEFT JOIN m ON m.case_id = nd.case_id GROUP BY nd.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    return graph.graph_totals(g.nodes, g.edges)


@query(
    "e8_hop_layers",
    f"WITH RECURSIVE {TRACE} SELECT case_id, hop, count(*) AS nodes FROM traced GROUP BY case_id, hop",
)
def _(spark, sf):
    pairs = trace.neighbour_table(base_edges(spark, sf))
    return trace.hop_layers(trace.trace_nodes(tables.nation_cases(spark, sf), pairs))


@query(
    "e8_trace_every_sender",
    f"""WITH RECURSIVE {TR}, p AS (SELECT DISTINCT f, t FROM tr),
r(case_id, node, hop) AS (SELECT DISTINCT 'case' || user_id, 'a' || user_id, 0 FROM events
  UNION SELECT r.case_id, p.t, hop + 1 FROM r JOIN p ON p.f = r.node WHERE hop < 2),
m AS (SELECT case_id, node, min(hop) AS hop FROM r GROUP BY case_id, node)
SELECT case_id, hop, count(*) AS nodes FROM m GROUP BY case_id, hop""",
)
def _(spark, sf):
    pairs = trace.neighbour_table(base_edges(spark, sf))
    return trace.hop_layers(trace.trace_nodes(tables.sender_cases(spark, sf), pairs))


@query(
    "e8_trace_any_direction",
    f"""WITH RECURSIVE {TRACE},
x AS (SELECT DISTINCT n.case_id, e.transfer_id, e.amount FROM traced n JOIN e ON e.f = n.node OR e.t = n.node WHERE n.hop < 3)
SELECT case_id, count(*) AS transfers, CAST(sum(amount) AS DOUBLE) AS volume FROM x GROUP BY case_id""",
)
def _(spark, sf):
    cases = tables.nation_cases(spark, sf, direction="any")
    edges = base_edges(spark, sf)
    around = trace.neighbour_table(edges, ["any"])
    found = trace.trace_edges(edges, trace.trace_nodes(cases, around), around, ["any"])
    return found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("transfers"), F.sum("amount").cast("double").alias("volume")
    )


@query(
    "e8_trace_both_sides",
    f"""WITH RECURSIVE {TR}, e AS (SELECT * FROM tr),
p AS (SELECT f AS node, t AS nxt FROM e UNION SELECT t, f FROM e),
r(case_id, node, hop) AS (SELECT 'case' || n_nationkey, 'a' || n_nationkey, 0 FROM nation
  UNION SELECT r.case_id, p.nxt, hop + 1 FROM r JOIN p ON p.node = r.node WHERE hop < 2),
m AS (SELECT case_id, node, min(hop) AS hop FROM r GROUP BY case_id, node)
SELECT case_id, hop, count(*) AS nodes FROM m GROUP BY case_id, hop""",
)
def _(spark, sf):
    cases = tables.nation_cases(spark, sf, max_hops=2, direction="any")
    pairs = trace.neighbour_table(base_edges(spark, sf), ["any"], any_expand="both")
    return trace.hop_layers(trace.trace_nodes(cases, pairs))


# One hop with a budget of 3 transactions: the first three hashes in edge order win.
@query(
    "e9_transaction_budget",
    f"""WITH {TR}, e AS (SELECT * FROM tr),
cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
p AS (SELECT case_id, t AS node, ts, tx_hash, transfer_id,
  row_number() OVER (PARTITION BY case_id, t ORDER BY ts, tx_hash, transfer_id) AS k
  FROM cases JOIN e ON e.f = root WHERE t <> root),
d AS (SELECT * FROM p WHERE k = 1),
x AS (SELECT case_id, tx_hash, row_number() OVER (PARTITION BY case_id ORDER BY min(struct_pack(a := ts, b := tx_hash, c := transfer_id))) AS n
  FROM d GROUP BY case_id, tx_hash)
SELECT d.case_id, d.node, d.tx_hash FROM d JOIN x ON x.case_id = d.case_id AND x.tx_hash = d.tx_hash WHERE n <= 3""",
)
def _(spark, sf):
    cases = tables.nation_cases(spark, sf, max_hops=1)
    pairs = trace.neighbour_table(base_edges(spark, sf), detail=True)
    traced = trace.trace_with_budget(cases, pairs, max_transactions=3)
    return traced.filter("hop = 1").select("case_id", "node", F.col("first.tx_hash").alias("tx_hash"))


@query(
    "e9_node_budget",
    f"""WITH {TR}, cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
p AS (SELECT case_id, t AS node, ts, tx_hash, transfer_id,
  row_number() OVER (PARTITION BY case_id, t ORDER BY ts, tx_hash, transfer_id) AS k FROM cases JOIN tr ON f = root WHERE t <> root),
x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, tx_hash, transfer_id, node) AS n FROM p WHERE k = 1)
SELECT case_id, node, transfer_id FROM x WHERE n < 5""",
)
def _(spark, sf):
    """Five nodes a case, the root among them: the first four it reaches."""
    cases = tables.nation_cases(spark, sf, max_hops=1)
    pairs = trace.neighbour_table(base_edges(spark, sf), detail=True)
    traced = trace.trace_with_budget(cases, pairs, max_nodes=5)
    return traced.filter("hop = 1").select("case_id", "node", F.col("first.transfer_id").alias("transfer_id"))


# Wallets that never send get the transfers of the transactions naming them as sender.
@query(
    "e10_root_fallback",
    f"""WITH {TR}, tx AS (SELECT tx_hash, 's' || (event_id // 2 % 7) AS sender FROM tr GROUP BY 1, 2)
SELECT sender AS source, tr.t AS target, count(*) AS transfers
FROM tx JOIN tr ON tr.tx_hash = tx.tx_hash WHERE sender IN ('s1', 's4') GROUP BY 1, 2""",
)
def _(spark, sf):
    number = F.substring("tx_hash", 2, 20).cast("bigint")
    transactions = tables.event_transactions(spark, sf).select(
        "tx_hash",
        "chain",
        F.concat(F.lit("s"), number % 7).alias("sender"),
        F.lit("nobody").alias("recipient"),
    )
    roots = spark.createDataFrame([("s1",), ("s4",), ("a3",)], "root string").select(
        F.col("root").alias("case_id"), F.lit("ethereum").alias("chain"), "root",
        F.lit("outgoing").alias("direction"), F.lit(1).alias("max_hops"),
    )
    found = trace.fallback_edges(roots, base_edges(spark, sf), transactions)
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("transfers"))


@query(
    "e11_trace_summary",
    f"""WITH RECURSIVE {GRAPH},
firsts AS (SELECT n.case_id, n.node, e.tx_hash,
  row_number() OVER (PARTITION BY n.case_id, n.node ORDER BY e.ts, e.tx_hash, e.transfer_id) AS k
  FROM traced n JOIN e ON e.t = n.node JOIN traced p ON p.case_id = n.case_id AND p.node = e.f AND p.hop = n.hop - 1),
u AS (SELECT case_id, count(DISTINCT tx_hash) AS transactions FROM firsts WHERE k = 1 GROUP BY case_id),
m AS (SELECT case_id, count(*) AS edges FROM ce GROUP BY case_id),
s AS (SELECT case_id, count(*) AS nodes, max(hop) AS hops FROM traced GROUP BY case_id)
SELECT s.case_id, nodes, coalesce(edges, 0) AS edges, coalesce(transactions, 0) AS transactions, hops,
  CASE WHEN edges IS NULL THEN 'EMPTY_WALLET' WHEN hops >= 3 THEN 'MAX_HOPS_REACHED' ELSE 'NATURAL_TERMINATION' END AS termination_reason
FROM s LEFT JOIN m ON m.case_id = s.case_id LEFT JOIN u ON u.case_id = s.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    return trace.trace_summary(g.cases, g.traced, g.edges).select(
        "case_id", "nodes", "edges", "transactions", "hops", "termination_reason"
    )


@query(
    "e12_empty_wallets",
    f"""WITH {TR}, x AS (SELECT DISTINCT f FROM tr)
SELECT 'case' || n_nationkey AS case_id, 'EMPTY_WALLET' AS termination_reason, 1 AS nodes, 0 AS edges
FROM nation WHERE 'a' || (n_nationkey * 97) NOT IN (SELECT f FROM x)""",
)
def _(spark, sf):
    # Some of these wallets exist at every size, most do not.
    number = F.substring("root", 2, 20).cast("bigint") * 97
    cases = tables.nation_cases(spark, sf, max_hops=1).withColumn("root", F.concat(F.lit("a"), number))
    g = case_graph(cases, base_edges(spark, sf), labels_table(spark, sf), directions=("outgoing",))
    summary = trace.trace_summary(g.cases, g.traced, g.edges)
    return summary.filter("termination_reason = 'EMPTY_WALLET'").select(
        "case_id", "termination_reason", F.col("nodes").cast("int").alias("nodes"), F.col("edges").cast("int").alias("edges")
    )


@query(
    "e13_distinct_transfers",
    f"""WITH {_LI} SELECT transfer_id, arg_min(t, (l_shipdate, l_partkey, t, amount)) AS to_address,
  CAST(arg_min(amount, (l_shipdate, l_partkey, t, amount)) AS DOUBLE) AS amount FROM li GROUP BY transfer_id""",
)
def _(spark, sf):
    columns = ["transfer_id", "ts", "part_key", "to_address", "amount"]
    li = tables.order_transfers(spark, sf).select(*columns)
    once = graph.distinct_transfers(
        li.unionByName(li), ["transfer_id"], ["ts", "part_key", "to_address", "amount"]
    )
    return once.select("transfer_id", "to_address", _double("amount"))


@query(
    "e14_traversal_edges",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, count(*) AS edges, count(DISTINCT transfer_id) AS ids,
  CAST(sum(amount) AS DOUBLE) AS volume FROM ce GROUP BY case_id""",
)
def _(spark, sf):
    edges = base_edges(spark, sf)
    around = trace.neighbour_table(edges)
    traced = trace.trace_nodes(tables.nation_cases(spark, sf), around)
    found = trace.trace_edges(edges, traced, around, ["outgoing"])
    return found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_distinct("transfer_id").alias("ids"),
        F.sum("amount").cast("double").alias("volume"),
    )


# A limit of 40 edges for each case: the first by hop, then edge order.
@query(
    "e14_edge_limit",
    f"""WITH RECURSIVE {GRAPH}, x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hop, ts, tx_hash, transfer_id) AS n FROM ce)
SELECT case_id, transfer_id, hop FROM x WHERE n <= 40""",
)
def _(spark, sf):
    g = case_graph(
        tables.nation_cases(spark, sf), base_edges(spark, sf), labels_table(spark, sf), directions=("outgoing",), max_edges=40
    )
    return g.edges.select("case_id", "transfer_id", "hop")


@query(
    "e16_subgraph",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, 'node' AS kind, node AS id FROM nd
UNION ALL SELECT case_id, 'edge', transfer_id FROM ce""",
)
def _(spark, sf):
    edges = base_edges(spark, sf)
    around = trace.neighbour_table(edges)
    traced = trace.trace_nodes(tables.nation_cases(spark, sf), around)
    nodes, found = trace.subgraph(edges, traced, around)
    return nodes.select("case_id", F.lit("node").alias("kind"), F.col("node").alias("id")).union(
        found.select("case_id", F.lit("edge"), "transfer_id")
    )


@query(
    "e20_asset_volumes",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, asset_symbol, CAST(sum(amount) AS DOUBLE) AS volume, count(*) AS transfers
FROM ce GROUP BY case_id, asset_symbol""",
)
def _(spark, sf):
    volumes = graph.asset_volumes(traced_graph(spark, sf).edges, ["case_id"])
    return volumes.select("case_id", "asset_symbol", _double("volume"), "transfers")


@query(
    "e21_degrees",
    f"""WITH {TR} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT f AS node, 0 AS i, 1 AS o FROM tr UNION ALL SELECT t, 1, 0 FROM tr) x GROUP BY node""",
)
def _(spark, sf):
    return graph.degrees(base_edges(spark, sf), ["chain"]).drop("chain")


# Shortest paths with the smallest edge sequence, level by level.
_PATHS = f"""{TRACE},
fe AS (SELECT f AS node, t AS nxt, min(struct_pack(a := ts, b := tx_hash, c := transfer_id)) AS e1 FROM e GROUP BY f, t),
p0 AS (SELECT case_id, root AS node, [root] AS path, [] :: STRUCT(a TIMESTAMP, b VARCHAR, c VARCHAR)[] AS steps FROM cases),
c1 AS (SELECT case_id, nxt AS node, list_append(path, nxt) AS path, list_append(steps, e1) AS steps FROM p0 JOIN fe USING (node)),
p1 AS (SELECT case_id, node, arg_min(path, steps) AS path, min(steps) AS steps FROM c1 JOIN traced USING (case_id, node) WHERE hop = 1 GROUP BY case_id, node),
c2 AS (SELECT case_id, nxt AS node, list_append(path, nxt) AS path, list_append(steps, e1) AS steps FROM p1 JOIN fe USING (node)),
p2 AS (SELECT case_id, node, arg_min(path, steps) AS path, min(steps) AS steps FROM c2 JOIN traced USING (case_id, node) WHERE hop = 2 GROUP BY case_id, node),
c3 AS (SELECT case_id, nxt AS node, list_append(path, nxt) AS path, list_append(steps, e1) AS steps FROM p2 JOIN fe USING (node)),
p3 AS (SELECT case_id, node, arg_min(path, steps) AS path, min(steps) AS steps FROM c3 JOIN traced USING (case_id, node) WHERE hop = 3 GROUP BY case_id, node),
trees AS (SELECT case_id, node, 0 AS hop, path, steps FROM p0 UNION ALL SELECT case_id, node, 1, path, steps FROM p1
  UNION ALL SELECT case_id, node, 2, path, steps FROM p2 UNION ALL SELECT case_id, node, 3, path, steps FROM p3)"""


def _trees(spark, sf):
    pairs = trace.neighbour_table(base_edges(spark, sf), detail=True)
    cases = tables.nation_cases(spark, sf)
    return cases, pairs, paths.path_trees(cases, pairs)


@query(
    "e15_path_listing",
    f"""WITH RECURSIVE {_PATHS}
SELECT DISTINCT case_id, array_to_string(list_append(path, nxt), '>') AS path
FROM trees JOIN fe USING (node) WHERE hop < 3 AND NOT list_contains(path, nxt)""",
)
def _(spark, sf):
    _, pairs, trees = _trees(spark, sf)
    return paths.path_listing(trees, pairs).select("case_id", F.array_join("path", ">").alias("path"))


@query(
    "e17_shortest_paths",
    f"""WITH RECURSIVE {_PATHS}
SELECT 'case' || n_nationkey AS case_id, 'a' || n_regionkey AS node, array_to_string(path, '>') AS path
FROM nation LEFT JOIN trees t ON t.case_id = 'case' || n_nationkey AND t.node = 'a' || n_regionkey""",
)
def _(spark, sf):
    _, _, trees = _trees(spark, sf)
    targets = tables.load(spark, sf, "nation").select(
        F.concat(F.lit("case"), "n_nationkey").alias("case_id"),
        F.concat(F.lit("a"), "n_regionkey").alias("node"),
    )
    found = paths.shortest_paths(trees, targets)
    return found.select("case_id", "node", F.array_join("path", ">").alias("path"))


# Runs until no cost falls; a round sees the costs of the one before, the least parent wins ties.
_RELAX = f"""{TR}, e AS (SELECT * FROM tr),
vp AS (SELECT f AS node, t AS nxt, 1.0 / max(CAST(amount AS DOUBLE)) AS c FROM e GROUP BY f, t),
v(case_id, node, cost, parent) USING KEY (case_id, node) AS (
  SELECT 'case' || n_nationkey, 'a' || n_nationkey, CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR) FROM nation
  UNION
  SELECT case_id, nxt, min(cost), arg_min(parent, (cost, parent)) FROM (
    SELECT v.case_id, vp.nxt, v.cost + vp.c AS cost, v.node AS parent
    FROM v JOIN vp ON vp.node = v.node LEFT JOIN recurring.v AS o ON o.case_id = v.case_id AND o.node = vp.nxt
    WHERE vp.nxt <> v.node AND (o.cost IS NULL OR v.cost + vp.c < o.cost)) x GROUP BY 1, 2),
p(case_id, node, cost, path) AS (
  SELECT case_id, node, cost, [node] FROM v WHERE parent IS NULL
  UNION ALL SELECT v.case_id, v.node, v.cost, list_append(p.path, v.node)
  FROM p JOIN v ON v.case_id = p.case_id AND v.parent = p.node)"""


@query(
    "e18_highest_value_paths",
    f"WITH RECURSIVE {_RELAX} SELECT case_id, node, round(cost, 9) AS cost, array_to_string(path, '>') AS path FROM p",
)
def _(spark, sf):
    found = paths.highest_value_paths(tables.nation_cases(spark, sf), base_edges(spark, sf))
    return found.select(
        "case_id", "node", F.round("cost", 9).alias("cost"), F.array_join("path", ">").alias("path")
    )


@query(
    "e18_widest_paths",
    f"""WITH RECURSIVE {TR}, e AS (SELECT * FROM tr),
vp AS (SELECT f AS node, t AS nxt, max(CAST(amount AS DOUBLE)) AS a FROM e GROUP BY f, t),
lv AS (SELECT DISTINCT a FROM vp),
r(root, node, w) AS (SELECT 'a' || n_nationkey, 'a' || n_nationkey, CAST('inf' AS DOUBLE) FROM nation
  UNION SELECT r.root, vp.nxt, least(r.w, vp.a) FROM r JOIN vp ON vp.node = r.node)
SELECT root, node, max(w) AS width FROM r WHERE node <> root GROUP BY root, node""",
)
def _(spark, sf):
    cases = tables.nation_cases(spark, sf)
    found = paths.highest_value_paths(cases, base_edges(spark, sf), bottleneck=True)
    return found.join(cases.select("case_id", "root"), "case_id").filter("node <> root").select(
        "root", "node", F.col("value").alias("width")
    )


@query(
    "e19_attribution_paths",
    f"""WITH RECURSIVE {_PATHS}
SELECT case_id, node, hop, array_to_string(path, '>') AS path,
  array_to_string(list_transform(steps, lambda x: x.c), '>') AS transfer_ids FROM trees""",
)
def _(spark, sf):
    _, _, trees = _trees(spark, sf)
    return trees.select(
        "case_id",
        "node",
        "hop",
        F.array_join("path", ">").alias("path"),
        F.array_join("transfer_ids", ">").alias("transfer_ids"),
    )


@query(
    "e22_cycle_edges",
    f"""WITH RECURSIVE {_PATHS}
SELECT t.case_id, count(*) AS edges, count(*) FILTER (WHERE list_contains(path, e.t)) AS cycle_edges
FROM trees t JOIN e ON e.f = t.node WHERE t.hop < 3 GROUP BY t.case_id""",
)
def _(spark, sf):
    edges = base_edges(spark, sf)
    _, around, trees = _trees(spark, sf)
    case_edges = trace.trace_edges(edges, trees, around, ["outgoing"])
    flagged = paths.cycle_edges(case_edges, trees)
    return flagged.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("is_cycle").alias("cycle_edges")
    )


"""Queries: scans, lookups, pages, timelines, wallet summaries, noise filters."""

from pyspark.sql import functions as F

from ledgerhop.operators import graph, lookup, noise
from ledgerhop.plans.catalog.registry import GRAPH, LABELS, TR, query
from ledgerhop.plans.catalog.shared import base_edges, labels_table, traced_graph
from ledgerhop.sources import bench_tables as tables


def _amount():
    return F.col("amount").cast("double").alias("amount")


def _us():
    return F.unix_micros("ts").alias("ts_us")


@query(
    "d1_transfers_by_direction",
    f"""WITH {TR}
SELECT 'outgoing' AS direction, transfer_id, f AS from_address, t AS to_address,
  CAST(amount AS DOUBLE) AS amount FROM tr WHERE f = 'a7'
UNION ALL SELECT 'incoming', transfer_id, f, t, CAST(amount AS DOUBLE) FROM tr WHERE t = 'a7'
UNION ALL SELECT 'any', transfer_id, f, t, CAST(amount AS DOUBLE) FROM tr WHERE f = 'a7' OR t = 'a7'""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf)
    parts = [
        lookup.transfers_of(tr, "A7", d).select(
            F.lit(d).alias("direction"), "transfer_id", "from_address", "to_address", _amount()
        )
        for d in ("outgoing", "incoming", "any")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "d1_transfers_of_many_addresses",
    f"""WITH {TR}, a AS (SELECT 'a' || n_nationkey AS node FROM nation)
SELECT node, count(*) AS transfers, CAST(sum(amount) AS DOUBLE) AS volume
FROM a JOIN tr ON tr.f = node OR tr.t = node GROUP BY node""",
)
def _(spark, sf):
    wanted = tables.nation_cases(spark, sf).select(
        "chain", F.col("root").alias("node"), F.lit("any").alias("direction")
    )
    found = lookup.transfers_of_many(tables.event_transfers(spark, sf), wanted)
    return found.groupBy("node").agg(
        F.count(F.lit(1)).alias("transfers"), F.sum("amount").cast("double").alias("volume")
    )


@query(
    "d2_inclusive_period",
    f"""WITH {TR}, x AS (SELECT f, CASE WHEN asset_symbol = 'ERROR' THEN NULL ELSE ts END AS ts FROM tr)
SELECT f AS from_address, count(*) AS transfers FROM x
WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'
GROUP BY f""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf).withColumn(
        "ts", F.when(F.col("asset_symbol") != "ERROR", F.col("ts"))
    )
    kept = tr.filter(lookup.in_period(F.col("ts"), "2024-01-03 00:00:00", "2024-01-10 12:00:00"))
    return kept.groupBy("from_address").agg(F.count(F.lit(1)).alias("transfers"))


@query(
    "d3_asset_filter",
    f"""WITH {TR} SELECT 'id' AS by, transfer_id FROM tr WHERE asset_id = 'id-view'
UNION ALL SELECT 'symbol', transfer_id FROM tr WHERE asset_symbol = 'CLICK'""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf)
    by_id = tr.filter(lookup.of_asset("ID-VIEW")).select(F.lit("id").alias("by"), "transfer_id")
    return by_id.union(tr.filter(lookup.of_asset("click")).select(F.lit("symbol"), "transfer_id"))


@query(
    "d4_asset_id_to_contract",
    """WITH a AS (SELECT CASE event_type WHEN 'view' THEN ' ETH ' WHEN 'click' THEN 'ethereum:0xc' || user_id
  WHEN 'error' THEN '0xd' || user_id ELSE 'USDT' END AS asset_id FROM events)
SELECT coalesce(CASE WHEN lower(trim(asset_id)) IN ('eth', 'ether', 'native') THEN NULL
  WHEN trim(asset_id) LIKE 'ethereum:%' THEN substr(trim(asset_id), 10)
  WHEN trim(asset_id) LIKE '0x%' THEN trim(asset_id) END, 'none') AS contract, count(*) AS transfers
FROM a GROUP BY 1""",
)
def _(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id")
    asked = (
        F.when(kind == "view", " ETH ")
        .when(kind == "click", F.concat(F.lit("ethereum:0xc"), user))
        .when(kind == "error", F.concat(F.lit("0xd"), user))
        .otherwise("USDT")
    )
    found = tables.load(spark, sf, "events").select(lookup.contract_of(asked).alias("contract"))
    return found.groupBy(F.coalesce("contract", F.lit("none")).alias("contract")).agg(
        F.count(F.lit(1)).alias("transfers")
    )


@query(
    "d5_transactions_with_match",
    f"""WITH {TR}, tx AS (SELECT tx_hash, min(block_number) AS block_number FROM tr GROUP BY tx_hash)
SELECT tx_hash, block_number FROM tx
WHERE EXISTS (SELECT 1 FROM tr WHERE tr.tx_hash = tx.tx_hash AND (f = 'a3' OR t = 'a3'))""",
)
def _(spark, sf):
    found = lookup.with_matching_transfer(
        tables.event_transactions(spark, sf), tables.event_transfers(spark, sf), lookup.touches("a3")
    )
    return found.select("tx_hash", "block_number")


@query(
    "d6_transaction_by_hash",
    f"WITH {TR} SELECT transfer_id, f AS from_address, t AS to_address FROM tr WHERE tx_hash = 'x100'",
)
def _(spark, sf):
    found = lookup.by_hash(tables.event_transfers(spark, sf), "X100")
    return found.select("transfer_id", "from_address", "to_address")


@query(
    "d7_page_with_has_more",
    f"""WITH {TR}, x AS (SELECT transfer_id, block_number, event_id // 2 AS tx_index, transfer_index,
  row_number() OVER (ORDER BY block_number DESC, event_id // 2 DESC, transfer_index) AS position FROM tr)
SELECT transfer_id, block_number, CAST(position AS BIGINT) AS position,
  (SELECT count(*) FROM x) > 70 AS has_more FROM x WHERE position > 20 AND position <= 70""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf).withColumn(
        "tx_index", F.substring("tx_hash", 2, 20).cast("bigint")
    )
    return lookup.page(tr, limit=50, offset=20).select(
        "transfer_id", "block_number", F.col("position").cast("bigint").alias("position"), "has_more"
    )


@query(
    "d7_deep_pages",
    f"""WITH {TR}, x AS (SELECT transfer_id, block_number,
  row_number() OVER (ORDER BY block_number DESC, event_id // 2 DESC, transfer_index) AS position, count(*) OVER () AS n FROM tr)
SELECT transfer_id, block_number, position, n > n * 9 // 10 + 100 AS has_more FROM x
WHERE position > n * 9 // 10 AND position <= n * 9 // 10 + 100
UNION ALL SELECT transfer_id, block_number, position, false FROM x WHERE position > n - 7""",
)
def _(spark, sf):
    """A page nine tenths into the transfers, and the last seven rows, of a table written in page order."""
    tr = tables.event_transfers(spark, sf).withColumn(
        "tx_index", F.substring("tx_hash", 2, 20).cast("bigint")
    )
    ordered = lookup.ordered_table(tr.select("transfer_id", "block_number", "tx_index", "transfer_index"))
    total = sum(n for _, _, n in ordered.parts)
    deep = ordered.page(100, total * 9 // 10).unionByName(ordered.page(100, total - 7))
    return deep.select("transfer_id", "block_number", "position", "has_more")


@query(
    "d8_wallet_history",
    f"""WITH {TR}, tx AS (SELECT tx_hash, min(ts) AS ts FROM tr GROUP BY tx_hash)
SELECT tx_hash, epoch_us(ts) AS ts_us FROM tx
WHERE tx_hash IN (SELECT tx_hash FROM tr WHERE f = 'a5' OR t = 'a5') ORDER BY ts, tx_hash LIMIT 50""",
)
def _(spark, sf):
    found = lookup.wallet_history(
        tables.event_transactions(spark, sf), tables.event_transfers(spark, sf), "a5", limit=50
    )
    return found.select("tx_hash", _us())


@query(
    "d9_attach_transfers_to_page",
    f"""WITH {TR}, tx AS (SELECT tx_hash, min(block_number) AS b FROM tr GROUP BY tx_hash),
p AS (SELECT tx_hash FROM tx ORDER BY b DESC, tx_hash LIMIT 40)
SELECT tx_hash, transfer_id, CAST(transfer_index AS BIGINT) AS transfer_index FROM p JOIN tr USING (tx_hash)""",
)
def _(spark, sf):
    newest = lookup.page(
        tables.event_transactions(spark, sf), 40, 0, [F.desc("block_number"), F.asc("tx_hash")]
    )
    found = lookup.attach_transfers(newest, tables.event_transfers(spark, sf))
    return found.select("tx_hash", "transfer_id", F.col("transfer_index").cast("bigint").alias("transfer_index"))


@query(
    "d10_case_by_alias",
    f"""WITH {TR}, al AS (SELECT DISTINCT 'file_' || lower(asset_symbol) AS alias FROM tr),
wanted(case_id) AS (VALUES ('file_view'), ('FILE_CLICK-2'), ('purchase'))
SELECT 'file_view' AS case_id, transfer_id FROM tr WHERE asset_symbol = 'VIEW'
UNION ALL SELECT 'FILE_CLICK-2', transfer_id FROM tr WHERE asset_symbol = 'CLICK'
UNION ALL SELECT 'purchase', transfer_id FROM tr WHERE asset_symbol = 'PURCHASE'""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf).withColumn(
        "alias", F.concat(F.lit("file_"), F.lower("asset_symbol"))
    )
    wanted = spark.createDataFrame([("file_view",), ("FILE_CLICK-2",), ("purchase",)], "case_id string")
    return lookup.case_by_alias(tr, wanted).select("case_id", "transfer_id")


@query(
    "d10_forward_closure",
    f"""WITH RECURSIVE {TR}, e AS (SELECT * FROM tr),
cases AS (SELECT 'case' || n_nationkey AS case_id, 'a' || n_nationkey AS root FROM nation),
r(case_id, node, h) AS (SELECT case_id, root, 0 FROM cases
  UNION SELECT r.case_id, e.t, h + 1 FROM r JOIN e ON e.f = r.node WHERE h < 5),
v AS (SELECT DISTINCT case_id, node FROM r)
SELECT case_id, count(*) AS transfers FROM (
  SELECT DISTINCT v.case_id, e.transfer_id FROM v JOIN e ON e.f = v.node OR e.t = v.node) x GROUP BY case_id""",
)
def _(spark, sf):
    from ledgerhop.operators.trace import forward_closure

    roots = tables.nation_cases(spark, sf).select("case_id", "chain", "root")
    return forward_closure(base_edges(spark, sf), roots).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("transfers")
    )


_CASES_SQL = f"""WITH RECURSIVE {TR},
e AS (SELECT *, CASE WHEN asset_symbol IN ('VIEW', 'CLICK') THEN 'polygon' ELSE 'ethereum' END AS chain,
  CASE WHEN event_id % 4 = 0 THEN 'file_' || lower(asset_symbol) END AS alias FROM tr),
al AS (SELECT DISTINCT alias FROM e WHERE alias IS NOT NULL),
cases AS (
  SELECT DISTINCT 'file_' || lower(asset_symbol) AS case_id, 'ethereum' AS chain, 'a1' AS suspect FROM tr
  UNION ALL SELECT CASE n_nationkey % 5 WHEN 0 THEN 'FILE_VIEW_' || n_name WHEN 1 THEN 'LICK' ELSE 'case' || n_nationkey END,
    CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'ETH' ELSE 'matic' END,
    CASE n_nationkey % 5 WHEN 2 THEN 'A' || n_nationkey WHEN 3 THEN 'nobody' END
  FROM nation WHERE n_nationkey % 5 <> 1 OR n_nationkey = 1),
exact AS (SELECT case_id, alias FROM cases JOIN al ON alias = case_id),
part AS (SELECT case_id, min(alias) AS alias FROM cases, al WHERE case_id NOT IN (SELECT case_id FROM exact)
  AND (contains(lower(case_id), lower(alias)) OR contains(lower(alias), lower(case_id))) GROUP BY case_id),
named AS (SELECT *, 'ALIAS' AS answered_by FROM exact UNION ALL SELECT *, 'NAME' FROM part),
rest AS (SELECT case_id, CASE chain WHEN 'ETH' THEN 'ethereum' WHEN 'matic' THEN 'polygon' END AS chain, lower(suspect) AS root
  FROM cases WHERE case_id NOT IN (SELECT case_id FROM named)),
r(case_id, chain, node, h) AS (SELECT case_id, chain, root, 0 FROM rest WHERE chain IS NOT NULL AND root IS NOT NULL
  UNION SELECT r.case_id, r.chain, e.t, h + 1 FROM r JOIN e ON e.f = r.node AND e.chain = r.chain WHERE h < 5),
v AS (SELECT DISTINCT case_id, chain, node FROM r),
closed AS (SELECT DISTINCT v.case_id, e.event_id FROM v JOIN e ON e.chain = v.chain AND (e.f = v.node OR e.t = v.node)),
answers AS (SELECT n.case_id, n.answered_by, e.event_id FROM named n JOIN e ON e.alias = n.alias
  UNION ALL SELECT case_id, 'CLOSURE', event_id FROM closed
  UNION ALL SELECT rest.case_id, CASE WHEN rest.chain IS NULL THEN 'ALL' ELSE 'CHAIN' END, e.event_id
    FROM rest JOIN e ON rest.chain IS NULL OR rest.chain = e.chain WHERE rest.case_id NOT IN (SELECT case_id FROM closed))
SELECT case_id, answered_by, count(*) AS transfers, CAST(sum(event_id) AS BIGINT) AS ids FROM answers GROUP BY case_id, answered_by"""


@query("d10_case_transfers", _CASES_SQL)
def _(spark, sf):
    """Whole case lookup: some cases are answered by each of the five steps, on two chains."""
    tr = tables.event_transfers(spark, sf)
    on_polygon = F.col("asset_symbol").isin("VIEW", "CLICK")
    tr = tr.withColumn("chain", F.when(on_polygon, "polygon").otherwise("ethereum"))
    number = F.substring("transfer_id", 2, 20).cast("bigint")
    edges = graph.edge_table(tr).withColumn(
        "alias", F.when(number % 4 == 0, F.concat(F.lit("file_"), F.lower("asset_symbol")))
    )
    key = F.col("n_nationkey")
    turn = F.pmod(key, F.lit(5))
    nations = tables.load(spark, sf, "nation").filter((turn != 1) | (key == 1)).select(
        F.when(turn == 0, F.concat(F.lit("FILE_VIEW_"), "n_name"))
        .when(turn == 1, "LICK")
        .otherwise(F.concat(F.lit("case"), key))
        .alias("case_id"),
        F.when(turn == 4, None).when(key % 2 == 0, "ETH").otherwise("matic").alias("chain"),
        F.when(turn == 2, F.concat(F.lit("A"), key)).when(turn == 3, "nobody").alias("suspect"),
    )
    files_ = tr.select(
        F.concat(F.lit("file_"), F.lower("asset_symbol")).alias("case_id"),
        F.lit("ethereum").alias("chain"), F.lit("a1").alias("suspect"),
    ).distinct()
    found = lookup.case_edges_of(files_.unionByName(nations), edges)
    return found.groupBy("case_id", "answered_by").agg(
        F.count(F.lit(1)).alias("transfers"), F.sum(number).alias("ids")
    )


@query(
    "d11_label_search",
    f"""WITH {LABELS} SELECT node AS address, entity_name, entity_type FROM lb
WHERE lower(entity_name) LIKE '%nation\\_1%' ESCAPE '\\' OR node LIKE '%nation\\_1%' ESCAPE '\\'""",
)
def _(spark, sf):
    found = lookup.search_labels(labels_table(spark, sf), "Nation_1")
    return found.select("address", "entity_name", "entity_type")


@query(
    "d12_case_list",
    """SELECT 'order' || o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders
WHERE lower('order' || o_orderkey) LIKE '%11%' OR lower(o_orderpriority) LIKE '%11%' OR lower('c' || o_custkey) LIKE '%11%'""",
)
def _(spark, sf):
    cases = tables.load(spark, sf, "orders").select(
        F.concat(F.lit("order"), "o_orderkey").alias("case_id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("c"), "o_custkey").alias("suspect_wallet"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )
    return lookup.list_cases(cases, "11").select("case_id", "created_at")


@query(
    "d13_transaction_evidence",
    f"""WITH {TR} SELECT tx_hash, min(block_number) AS block_number,
  arg_min(transfer_id, transfer_index) AS transfer_id, arg_min(f, transfer_index) AS from_address,
  CAST(arg_min(amount, transfer_index) AS DOUBLE) AS amount FROM tr GROUP BY tx_hash""",
)
def _(spark, sf):
    found = lookup.first_transfer_of(
        tables.event_transactions(spark, sf), tables.event_transfers(spark, sf)
    )
    return found.select("tx_hash", "block_number", "transfer_id", "from_address", _amount())


@query(
    "d15_case_timeline",
    f"""WITH RECURSIVE {GRAPH}
SELECT case_id, transfer_id, epoch_us(ts) AS ts_us, CAST(amount AS DOUBLE) AS amount,
  CAST(sum(amount) OVER (PARTITION BY case_id, asset_symbol ORDER BY ts, tx_hash, transfer_id
    ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
FROM ce WHERE amount >= 120 AND hop <= 2""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    rows = lookup.timeline(g.edges, min_amount="120", max_hop=2)
    return rows.select(
        "case_id", "transfer_id", _us(), _amount(), F.col("running_total").cast("double").alias("running_total")
    )


@query(
    "d16_wallet_summary",
    f"""WITH {TR}, {LABELS}, s AS (
  SELECT f AS address, asset_symbol, amount, ts, 1 AS o FROM tr
  UNION ALL SELECT t, asset_symbol, amount, ts, 0 FROM tr)
SELECT address, asset_symbol, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  CAST(sum(CASE WHEN o = 0 THEN amount ELSE 0 END) AS DOUBLE) AS total_in,
  CAST(sum(CASE WHEN o = 1 THEN amount ELSE 0 END) AS DOUBLE) AS total_out,
  count(*) AS transfers, coalesce(max(entity_type), 'INTERMEDIARY') AS role
FROM s LEFT JOIN lb ON lb.node = address GROUP BY address, asset_symbol""",
)
def _(spark, sf):
    found = lookup.wallet_summary(tables.event_transfers(spark, sf), labels_table(spark, sf))
    return found.select(
        "address",
        "asset_symbol",
        F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"),
        F.col("total_in").cast("double").alias("total_in"),
        F.col("total_out").cast("double").alias("total_out"),
        "transfers",
        "role",
    )


@query(
    "d16_wallet_summary_order_volume",
    """WITH x AS (SELECT 'c' || o_custkey AS f, 's' || l_suppkey AS t, l_returnflag AS a,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT f AS address, a, v, 1 AS o FROM x UNION ALL SELECT t, a, v, 0 FROM x)
SELECT address, a AS asset_symbol, CAST(sum(CASE WHEN o = 0 THEN v ELSE 0 END) AS DOUBLE) AS total_in,
  CAST(sum(CASE WHEN o = 1 THEN v ELSE 0 END) AS DOUBLE) AS total_out, count(*) AS transfers
FROM s GROUP BY address, a""",
)
def _(spark, sf):
    found = lookup.wallet_summary(tables.order_transfers(spark, sf))
    return found.select(
        "address",
        "asset_symbol",
        F.col("total_in").cast("double").alias("total_in"),
        F.col("total_out").cast("double").alias("total_out"),
        "transfers",
    )


@query(
    "d17_label_search_by_type",
    f"""WITH {LABELS} SELECT node AS address, entity_name FROM lb
WHERE entity_type = 'MIXER' AND (lower(entity_name) LIKE '%2%' OR node LIKE '%2%')""",
)
def _(spark, sf):
    found = lookup.search_labels(labels_table(spark, sf), "2", "ETHEREUM", "mixer")
    return found.select("address", "entity_name")


@query(
    "d18_case_transactions_page",
    f"""WITH RECURSIVE {GRAPH}, tx AS (SELECT tx_hash, min(block_number) AS block_number FROM tr GROUP BY tx_hash)
SELECT tx_hash, block_number FROM tx WHERE tx_hash IN (SELECT tx_hash FROM ce WHERE case_id = 'case3')
ORDER BY block_number DESC, tx_hash LIMIT 30 OFFSET 10""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    found = lookup.case_transactions(
        g.edges.filter(F.col("case_id") == "case3"), tables.event_transactions(spark, sf), 30, 10
    )
    return found.select("tx_hash", "block_number")


@query(
    "d19_block_lookup",
    """SELECT event_id // 10 AS block_number, 'h' || (event_id // 10) AS block_hash, epoch_us(min(ts)) AS ts_us
FROM events WHERE event_id // 10 IN (12, 17) GROUP BY 1, 2""",
)
def _(spark, sf):
    blocks = (
        tables.event_transfers(spark, sf)
        .groupBy("block_number")
        .agg(F.min("ts").alias("ts"))
        .withColumn("block_hash", F.concat(F.lit("h"), "block_number"))
    )
    found = lookup.block_by(blocks, number=12).union(lookup.block_by(blocks, block_hash="h17"))
    return found.select("block_number", "block_hash", _us())


# Noise filters on the case graphs.


@query(
    "c1_minimum_and_dust",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, count(*) AS edges, CAST(sum(amount) AS DOUBLE) AS volume
FROM ce WHERE amount >= 150 GROUP BY case_id""",
)
def _(spark, sf):
    kept = noise.filter_edges(traced_graph(spark, sf).edges, "20", hide_dust=True, dust="150")
    return kept.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("amount").cast("double").alias("volume")
    )


@query(
    "c2_asset_whitelist",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, asset_symbol, count(*) AS edges FROM ce
WHERE asset_symbol IN ('CLICK') OR upper(asset_id) IN ('ID-VIEW') GROUP BY case_id, asset_symbol""",
)
def _(spark, sf):
    kept = noise.filter_edges(traced_graph(spark, sf).edges, assets=["click", "id-view"])
    return kept.groupBy("case_id", "asset_symbol").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "c3_time_window",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, count(*) AS edges FROM ce
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY case_id""",
)
def _(spark, sf):
    kept = noise.filter_edges(
        traced_graph(spark, sf).edges, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00"
    )
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "c4_touched_nodes",
    f"""WITH RECURSIVE {GRAPH}, k AS (SELECT * FROM ce WHERE amount >= 200),
u AS (SELECT case_id, f AS node FROM k UNION SELECT case_id, t FROM k)
SELECT nd.case_id, nd.node, nd.node_type FROM nd LEFT JOIN u ON u.case_id = nd.case_id AND u.node = nd.node
WHERE is_root OR u.node IS NOT NULL""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    kept = noise.keep_touched_nodes(g.nodes, noise.filter_edges(g.edges, "200"))
    return kept.select("case_id", "node", "node_type")


@query(
    "c5_totals_after_filter",
    f"""WITH RECURSIVE {GRAPH}, k AS (SELECT * FROM ce WHERE amount >= 250),
u AS (SELECT case_id, f AS node FROM k UNION SELECT case_id, t FROM k UNION SELECT case_id, root FROM cases),
s AS (SELECT case_id, count(*) AS n FROM u GROUP BY case_id),
h AS (SELECT case_id, count(*) AS m, max(hop) AS d FROM k GROUP BY case_id)
SELECT s.case_id, n AS total_nodes, coalesce(m, 0) AS total_edges,
  CAST(CASE WHEN m IS NULL THEN 0 ELSE greatest(d, 1) END AS INT) AS hop_depth FROM s LEFT JOIN h ON h.case_id = s.case_id""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    kept = noise.filter_edges(g.edges, "250")
    return noise.filtered_totals(g.cases, noise.keep_touched_nodes(g.nodes, kept), kept)


@query(
    "c6_dust_exception",
    f"""WITH {TR}, o AS (SELECT f, asset_symbol, CAST(sum(amount) AS DOUBLE) AS s FROM tr GROUP BY f, asset_symbol)
SELECT tr.asset_symbol, count(*) AS kept FROM tr JOIN o ON o.f = tr.f AND o.asset_symbol = tr.asset_symbol
WHERE amount >= (CASE WHEN tr.asset_symbol = 'CLICK' THEN 60 ELSE 30 END)
  OR CAST(amount AS DOUBLE) >= 0.1 * s GROUP BY tr.asset_symbol""",
)
def _(spark, sf):
    edges = graph.edge_table(tables.event_transfers(spark, sf))
    kept = noise.drop_dust(edges, ["chain"], "30", {"CLICK": "60"}, major_share=0.1)
    return kept.groupBy("asset_symbol").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "c7_collapse_hubs",
    f"""WITH {TR}, {LABELS}, d AS (SELECT node, count(*) AS n FROM (SELECT f AS node FROM tr UNION ALL SELECT t FROM tr) x GROUP BY node),
h AS (SELECT d.node, 'hub:' || coalesce(entity_name, d.node) AS cl FROM d LEFT JOIN lb ON lb.node = d.node WHERE d.n > 100)
SELECT coalesce(a.cl, f) AS source, coalesce(b.cl, t) AS target, asset_symbol,
  CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS transfers
FROM tr LEFT JOIN h a ON a.node = f LEFT JOIN h b ON b.node = t GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    edges = graph.edge_table(tables.event_transfers(spark, sf))
    merged = graph.collapse_hubs(edges, 100, labels_table(spark, sf), ["chain"])
    return merged.select("source", "target", "asset_symbol", _amount(), "transfers")


@query(
    "c8_depth_limit",
    f"""WITH RECURSIVE {GRAPH} SELECT case_id, hop, count(*) AS edges FROM ce WHERE hop <= 2 GROUP BY case_id, hop""",
)
def _(spark, sf):
    kept = noise.filter_edges(traced_graph(spark, sf).edges, max_hop=2)
    return kept.groupBy("case_id", "hop").agg(F.count(F.lit(1)).alias("edges"))

"""Queries: labels, registry, entity resolution and service attribution."""

from pyspark.sql import functions as F

from ledgerhop.functions.text import entity_category, is_service
from ledgerhop.operators import entities, paths, trace
from ledgerhop.plans.catalog.graphs import _PATHS
from ledgerhop.plans.catalog.registry import GRAPH, LABELS, TR, TRACE, query
from ledgerhop.plans.catalog.shared import labels_table, registry_table, traced_graph
from ledgerhop.plans.investigate import investigate
from ledgerhop.sources import bench_tables as tables
from ledgerhop.sources import files

# All label records: the labels and, for bridges, a second one named by region.
_RECORDS = f"""{LABELS},
rec AS (SELECT node, entity_name, entity_type, 0 AS file_no FROM lb
  UNION ALL SELECT lb.node, r_name, 'EXCHANGE', 1 FROM lb JOIN region ON n_regionkey = r_regionkey WHERE entity_type = 'BRIDGE')"""


@query(
    "a4_last_label_wins",
    f"""WITH {_RECORDS} SELECT node, arg_max(entity_name, file_no) AS entity_name, arg_max(entity_type, file_no) AS entity_type
FROM rec GROUP BY node""",
)
def _(spark, sf):
    records = tables.wallet_labels(spark, sf).unionByName(tables.second_opinions(spark, sf))
    return files.knowledge_base(records).select("node", "entity_name", "entity_type")


@query(
    "a5_registry_records",
    f"WITH {LABELS} SELECT 'ethereum' AS chain, node, count(*) AS records FROM lb GROUP BY node",
)
def _(spark, sf):
    registry = files.registry(tables.wallet_labels(spark, sf))
    return registry.groupBy(F.col("registry_chain").alias("chain"), "node").agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "a6_added_records",
    f"WITH {_RECORDS} SELECT node, count(*) AS records, count(DISTINCT entity_name) AS names FROM rec GROUP BY node",
)
def _(spark, sf):
    return registry_table(spark, sf).groupBy("node").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("entity_name").alias("names")
    )


@query(
    "f1_label_lookup",
    f"""WITH {LABELS} SELECT 'A' || w.n AS address, entity_name, coalesce(entity_type, 'INTERMEDIARY') AS entity_type,
  CAST(CASE WHEN node IS NULL THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE WHEN node IS NULL THEN 'UNRESOLVED' ELSE 'nation' END AS label_source FROM w LEFT JOIN lb ON lb.n = w.n""",
)
def _(spark, sf):
    wallets = tables.wallets(spark, sf).select(F.upper("address").alias("address"))
    return entities.resolve_labels(wallets, labels_table(spark, sf))


@query(
    "f2_label_map",
    f"""WITH RECURSIVE {GRAPH}, u AS (SELECT case_id, f AS node FROM ce UNION SELECT case_id, t FROM ce)
SELECT case_id, u.node, entity_name, entity_type FROM u JOIN lb ON lb.node = u.node""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    found = entities.label_map(g.edges, g.labels)
    return found.select("case_id", "node", "entity_name", "entity_type")


@query(
    "f3_registry_resolution",
    f"""WITH {_RECORDS}, g AS (SELECT node, count(DISTINCT entity_name) AS k, count(*) AS records,
  arg_min(entity_name, file_no) AS name, arg_min(entity_type, file_no) AS kind FROM rec GROUP BY node)
SELECT 'a' || w.n AS node, CASE WHEN g.node IS NULL THEN 'NOT_FOUND' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS resolution_status,
  CASE WHEN k > 1 THEN 'Multiple candidates' ELSE name END AS entity_name,
  CASE WHEN g.node IS NULL THEN FALSE WHEN k > 1 THEN TRUE ELSE kind LIKE 'VASP%' END AS vasp_status,
  CASE WHEN k > 1 THEN records ELSE 0 END AS candidates FROM w LEFT JOIN g ON g.node = 'a' || w.n""",
)
def _(spark, sf):
    wallets = tables.wallets(spark, sf).select(F.lit("eth").alias("chain"), "address")
    found = entities.resolve_registry(wallets, registry_table(spark, sf))
    return found.select("node", "resolution_status", "entity_name", "vasp_status", "candidates")


@query(
    "f4_entity_category",
    """WITH x AS (SELECT CASE event_type WHEN 'view' THEN 'Centralized_x' WHEN 'click' THEN 'dex pool'
  WHEN 'error' THEN 'privacy_mixer' WHEN 'signup' THEN 'mining_pool' ELSE 'shop' END AS raw FROM events)
SELECT CASE WHEN raw = 'Centralized_x' THEN 'VASP' WHEN raw = 'dex pool' THEN 'PROTOCOL'
  WHEN raw = 'privacy_mixer' THEN 'PAYMENT_PROVIDER' WHEN raw = 'mining_pool' THEN 'MINER' ELSE 'UNKNOWN' END AS category,
  count(*) AS records FROM x GROUP BY 1""",
)
def _(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", "Centralized_x")
        .when(kind == "click", "dex pool")
        .when(kind == "error", "privacy_mixer")
        .when(kind == "signup", "mining_pool")
        .otherwise("shop")
    )
    found = tables.load(spark, sf, "events").select(entity_category(raw).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("records"))


@query(
    "f5_service_flag",
    """WITH x AS (SELECT CASE WHEN event_type = 'view' THEN user_id % 2 = 0 END AS flag,
  CASE WHEN event_type IN ('view', 'click') THEN 'VASP' WHEN event_type = 'error' THEN 'CUSTODIAN' ELSE 'BRIDGE' END AS c, user_id FROM events)
SELECT user_id, count(*) FILTER (WHERE coalesce(flag, c IN ('VASP', 'EXCHANGE', 'CUSTODIAN'))) AS services FROM x GROUP BY user_id""",
)
def _(spark, sf):
    kind = F.col("event_type")
    flag = F.when(kind == "view", F.col("user_id") % 2 == 0)
    category = (
        F.when(kind.isin("view", "click"), "VASP").when(kind == "error", "CUSTODIAN").otherwise("BRIDGE")
    )
    return tables.load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(is_service(flag, category)).alias("services")
    )


@query(
    "f6_candidates",
    f"""WITH {_RECORDS}, k AS (SELECT node FROM rec GROUP BY node HAVING count(DISTINCT entity_name) > 1)
SELECT rec.node, entity_name, CASE WHEN entity_type = 'EXCHANGE' THEN 'VASP' ELSE 'BRIDGE' END AS category,
  entity_type = 'EXCHANGE' AS vasp_status FROM rec JOIN k ON k.node = rec.node""",
)
def _(spark, sf):
    return entities.candidate_rows(registry_table(spark, sf)).select(
        "node", "entity_name", "category", "vasp_status"
    )


@query(
    "f7_distinct_addresses",
    f"""WITH {TR}, x AS (SELECT asset_symbol AS case_id, lower(f) AS node, min(event_id) AS r FROM tr GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY r, node) AS n FROM x)
SELECT case_id, node FROM y WHERE n <= 40""",
)
def _(spark, sf):
    tr = tables.event_transfers(spark, sf).select(
        F.col("asset_symbol").alias("case_id"),
        "chain",
        F.when(F.col("transfer_index") == 1, F.upper("from_address"))
        .otherwise(F.col("from_address"))
        .alias("address"),
        F.substring("transfer_id", 2, 20).cast("bigint").alias("rank"),
    )
    return entities.distinct_addresses(tr, limit_per_case=40).select("case_id", "node")


@query(
    "f8_node_annotation",
    f"""WITH RECURSIVE {TRACE}, {_RECORDS}, g AS (SELECT node, count(DISTINCT entity_name) AS k, count(*) AS records,
  arg_min(entity_name, file_no) AS name, arg_min(entity_type, file_no) AS kind FROM rec GROUP BY node)
SELECT case_id, t.node, CASE WHEN k > 1 THEN 'Multiple candidates' ELSE name END AS entity_name,
  CASE WHEN g.node IS NULL THEN NULL WHEN k > 1 THEN NULL WHEN kind LIKE 'VASP%' THEN 'VASP' WHEN kind = 'MIXER' THEN 'PAYMENT_PROVIDER' ELSE 'BRIDGE' END AS kind,
  CASE WHEN k > 1 THEN CAST(records AS VARCHAR) END AS candidates
FROM traced t LEFT JOIN g ON g.node = t.node""",
)
def _(spark, sf):
    nodes = entities.annotate_nodes(traced_graph(spark, sf).nodes, registry_table(spark, sf))
    return nodes.select(
        "case_id",
        "node",
        "entity_name",
        F.col("metadata")["entity_type"].alias("kind"),
        F.col("metadata")["candidates_count"].alias("candidates"),
    )


@query(
    "f9_service_attributions",
    f"""WITH RECURSIVE {_PATHS}, {LABELS}
SELECT case_id, t.node, entity_name, hop, array_to_string(path, '>') AS path,
  array_to_string(list_transform(steps, lambda x: x.c), '>') AS transfer_ids
FROM trees t JOIN lb ON lb.node = t.node WHERE entity_type LIKE 'VASP%'""",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    pairs = trace.neighbour_table(g.edges, scope=("case_id", "chain"), detail=True)
    trees = paths.path_trees(g.cases, pairs)
    found = entities.attribute_services(g.nodes, registry_table(spark, sf), trees, g.cases)
    return found.select(
        "case_id",
        "node",
        "entity_name",
        "hop",
        F.array_join("path", ">").alias("path"),
        F.array_join("transfer_ids", ">").alias("transfer_ids"),
    )


@query(
    "e23_batch_investigation",
    f"""WITH RECURSIVE {GRAPH}, m AS (SELECT case_id, count(*) AS edges FROM ce GROUP BY case_id),
s AS (SELECT case_id, count(*) AS nodes, max(hop) AS hops FROM traced GROUP BY case_id),
a AS (SELECT case_id, count(*) AS services, CAST(sum(hop) AS BIGINT) AS hop_sum FROM traced JOIN lb ON lb.node = traced.node
  WHERE entity_type LIKE 'VASP%' GROUP BY case_id)
SELECT s.case_id, nodes, coalesce(edges, 0) AS edges, hops,
  CASE WHEN edges IS NULL THEN 'EMPTY_WALLET' WHEN hops >= 3 THEN 'MAX_HOPS_REACHED' ELSE 'NATURAL_TERMINATION' END AS termination_reason,
  coalesce(services, 0) AS services, coalesce(hop_sum, 0) AS hop_sum
FROM s LEFT JOIN m ON m.case_id = s.case_id LEFT JOIN a ON a.case_id = s.case_id""",
)
def _(spark, sf):
    result = investigate(
        tables.nation_cases(spark, sf),
        tables.event_transfers(spark, sf),
        labels_table(spark, sf),
        registry_table(spark, sf),
        directions=("outgoing",),
    )
    services = result.attributions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("services"), F.sum("hop").alias("hop_sum")
    )
    return result.summary.join(services, "case_id", "left").select(
        "case_id",
        "nodes",
        "edges",
        "hops",
        "termination_reason",
        F.coalesce("services", F.lit(0)).alias("services"),
        F.coalesce("hop_sum", F.lit(0)).alias("hop_sum"),
    )



# Two wallets that never send and one that does; the transactions name s1 and s4 as senders.
@query(
    "e23_root_fallback",
    f"""WITH {TR}, tx AS (SELECT DISTINCT tx_hash, 's' || (event_id // 2 % 7) AS sender FROM tr),
fe AS (SELECT f, t FROM tr UNION ALL SELECT sender, t FROM tx JOIN tr USING (tx_hash) WHERE sender IN ('s1', 's4'))
SELECT f AS case_id, count(DISTINCT CASE WHEN t <> f THEN t END) + 1 AS nodes, count(*) AS edges
FROM fe WHERE f IN ('s1', 's4', 'a3') GROUP BY f""",
)
def _(spark, sf):
    number = F.substring("tx_hash", 2, 20).cast("bigint")
    transactions = tables.event_transactions(spark, sf).select(
        "tx_hash", "chain", F.concat(F.lit("s"), number % 7).alias("sender"), F.lit("nobody").alias("recipient")
    )
    cases = spark.createDataFrame([("s1",), ("s4",), ("a3",)], "root string").select(
        F.col("root").alias("case_id"), F.lit("eth").alias("chain"), "root",
        F.lit("forward").alias("direction"), F.lit(1).alias("max_hops"),
    )
    result = investigate(
        cases, tables.event_transfers(spark, sf), labels_table(spark, sf), registry_table(spark, sf), transactions=transactions
    )
    return result.summary.select("case_id", "nodes", "edges")

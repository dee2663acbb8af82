"""Queries: readers and sinks, normalisation of raw records, scalar rules.

Raw records are derived from the test tables row by row: nested arrays are built inside
one row, so nothing is grouped to make them.
"""

from pyspark.sql import functions as F

from ledgerhop.functions import amounts, text, times
from ledgerhop.functions.addresses import audit_addresses, audit_report
from ledgerhop.functions.digests import row_digest
from ledgerhop.operators import explorer, normalize, risk, scoring
from ledgerhop.plans.catalog.registry import TR, query
from ledgerhop.plans.catalog.scores import SCORES
from ledgerhop.plans.catalog.shared import traced_graph
from ledgerhop.schema import (
    EXPLORER_TRANSACTION,
    EXPLORER_TRANSFER,
    RAW_ACCOUNT,
    RAW_RECORD,
    RAW_TRON,
    RAW_UTXO,
    envelope,
)
from ledgerhop.sources import bench_tables as tables
from ledgerhop.sources import files, sinks
from ledgerhop.staging import stage, stage_path


def _json_lines(df, label):
    """Write rows as JSON lines and return the folder."""
    path = stage_path(df.sparkSession, label)
    df.write.json(path)
    return path


def _double(name):
    return F.col(name).cast("double").alias(name)


def _struct(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _none():
    return F.lit(None).cast("string")


def _events(spark, sf):
    """Events with the pieces raw records are made of."""
    value = F.col("value").cast("decimal(18,2)")
    return tables.load(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("kind"),
        F.concat(F.lit("x"), "event_id").alias("tx"),
        F.concat(F.lit("a"), "user_id").alias("f"),
        F.concat(F.lit("a"), F.get_json_object("props", "$.k")).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        value.alias("value"),
        value.cast("string").alias("value_text"),
        (value * 100).cast("bigint").cast("string").alias("cents"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type AS kind, 'x' || event_id AS tx, 'a' || user_id AS f,
  'a' || regexp_extract(props, '"k": ([0-9]+)', 1) AS t, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k,
  CAST(value AS DECIMAL(18,2)) AS v, CAST(round(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents,
  date_trunc('second', ts) AS ts FROM events)"""


# --- demo-style records ---


def _records(spark, sf):
    """Purchases carry no nested transfers, all other records two."""
    kind = F.col("kind")

    def nested(sender, receiver, amount, asset, places):
        return _struct(
            from_address=sender, to_address=receiver, amount=amount, asset=asset,
            token_decimals=places,
        )

    inner = F.array(
        nested(F.col("f"), F.col("t"), F.col("value_text"), _none(), F.lit(None).cast("int")),
        nested(F.col("t"), F.col("f"), F.lit("1500000"), F.lit("USDT"), F.lit(6)),
    )
    return _events(spark, sf).select(
        F.col("tx").alias("tx_id"),
        F.when(kind == "error", "BTC").when(kind == "click", "trx").otherwise("ETH").alias("chain"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("SUCCESS").alias("status"),
        F.col("f").alias("from_address"),
        F.col("t").alias("to_address"),
        F.col("value_text").alias("amount"),
        F.lit("0.0021").alias("fee"),
        F.when(kind != "purchase", inner).alias("transfers"),
    )


def _read_back(spark, sf):
    return files.read_record_lines(spark, _json_lines(_records(spark, sf), "records"))


_CHAIN = "CASE kind WHEN 'error' THEN 'bitcoin' WHEN 'click' THEN 'tron' ELSE 'ethereum' END"


@query(
    "a1_read_records",
    f"""WITH {EV} SELECT tx AS tx_hash, {_CHAIN} AS chain, epoch(ts) :: BIGINT AS ts_s, 'confirmed' AS status,
  CASE kind WHEN 'error' THEN 'utxo_transaction' ELSE 'native_transfer' END AS transaction_type,
  CASE kind WHEN 'purchase' THEN 1 ELSE 2 END AS transfers FROM ev""",
)
def _(spark, sf):
    found = normalize.transactions_from_records(_read_back(spark, sf))
    return found.select(
        "tx_hash",
        "chain",
        F.unix_seconds("ts").alias("ts_s"),
        "status",
        "transaction_type",
        F.size("transfers").alias("transfers"),
    )


@query(
    "a2_record_transfers",
    f"""WITH {EV} SELECT tx || '_0' AS transfer_id, f AS from_address, t AS to_address,
  CASE kind WHEN 'error' THEN 'BTC' ELSE 'ETH' END AS asset_symbol, 'native' AS asset_type,
  CAST(v AS DOUBLE) AS amount, CASE WHEN cents = 0 THEN '0' ELSE CAST(cents AS VARCHAR) || repeat('0', CASE kind WHEN 'error' THEN 6 ELSE 16 END) END AS raw_amount FROM ev
UNION ALL SELECT tx || '_1', t, f, 'USDT', CASE kind WHEN 'click' THEN 'trc20' ELSE 'erc20' END, 1.5, '1500000' FROM ev WHERE kind <> 'purchase'""",
)
def _(spark, sf):
    found = normalize.explode_transfers(normalize.transactions_from_records(_read_back(spark, sf)))
    return found.select(
        "transfer_id", "from_address", "to_address", "asset_symbol", "asset_type", _double("amount"), "raw_amount"
    )


@query(
    "a3_case_aliases",
    f"""WITH {EV}, al(kind, case_id) AS (VALUES ('view', 'CASE-V'), ('view', 'case_v'), ('click', 'CASE-C'))
SELECT coalesce(case_id, ev.kind || '_transactions') AS case_id, count(*) AS records FROM ev LEFT JOIN al ON al.kind = ev.kind GROUP BY 1""",
)
def _(spark, sf):
    records = _events(spark, sf).withColumn("file_name", F.concat("kind", F.lit("_transactions.json")))
    aliases = spark.createDataFrame(
        [("view_transactions.json", "CASE-V"), ("view_transactions.json", "case_v"), ("click_transactions.json", "CASE-C")],
        "file_name string, case_id string",
    )
    return files.with_case_alias(records, aliases).groupBy("case_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "a8_read_cases",
    """SELECT 'order' || o_orderkey AS case_id, 'c' || o_custkey AS suspect_wallet, 'ETH' AS chain, o_orderpriority AS priority FROM orders""",
)
def _(spark, sf):
    cases = tables.load(spark, sf, "orders").select(
        F.concat(F.lit("order"), "o_orderkey").alias("case_id"),
        F.concat(F.lit("c"), "o_custkey").alias("suspect_wallet"),
        F.lit("ETH").alias("chain"),
        F.col("o_orderpriority").alias("priority"),
    )
    found = files.read_cases(spark, _json_lines(cases, "cases"), lines=True)
    return found.select("case_id", "suspect_wallet", "chain", "priority")


@query(
    "a9_read_truth",
    """SELECT 'c' || c_custkey AS case_id, c_mktsegment AS ground_truth_vasp, c_acctbal AS expected_min_score FROM customer
UNION ALL SELECT 'd' || c_custkey, c_mktsegment, 50.0 FROM customer""",
)
def _(spark, sf):
    def item(prefix, score):
        return _struct(
            case_id=F.concat(F.lit(prefix), "c_custkey"),
            ground_truth_vasp=F.col("c_mktsegment"),
            expected_min_score=score,
        )

    truth = tables.load(spark, sf, "customer").select(
        F.array(item("c", F.col("c_acctbal")), item("d", F.lit(50.0))).alias("benchmark_cases")
    )
    found = files.read_truth(spark, _json_lines(truth, "truth"), lines=True)
    return found.select("case_id", "ground_truth_vasp", "expected_min_score")


# --- sinks ---


@query(
    "a10_insert_if_absent",
    """WITH x AS (SELECT 'o' || l_orderkey || '_' || l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(DISTINCT id) AS rows_stored, count(DISTINCT id) AS ids FROM x""",
)
def _(spark, sf):
    root = stage_path(spark, "db")
    sinks.reset_tables(spark, root)
    # The joined input is read by every insertion, so it is written once.
    rows = stage(tables.order_transfers(spark, sf), "order-transfers").withColumns(
        {c: _none() for c in ("asset_type", "token_contract", "raw_amount", "transfer_type", "evidence_ref")}
    ).withColumn("token_decimals", F.lit(None).cast("int"))
    sinks.insert_absent(spark, root, "transfers", rows.filter("transfer_index <= 4"))
    sinks.insert_absent(spark, root, "transfers", rows)
    sinks.insert_absent(spark, root, "transfers", rows)
    return sinks.read_table(spark, root, "transfers").agg(
        F.count(F.lit(1)).alias("rows_stored"), F.count_distinct("transfer_id").alias("ids")
    )


@query(
    "a11_reset_tables",
    """SELECT 'cases' AS name, CAST(0 AS BIGINT) AS rows_after, count(*) AS rows_before FROM orders""",
)
def _(spark, sf):
    root = stage_path(spark, "db")
    sinks.reset_tables(spark, root)
    cases = tables.load(spark, sf, "orders").select(
        F.concat(F.lit("order"), "o_orderkey").alias("case_id"),
        *[_none().alias(c) for c in ("title", "investigator", "description", "priority", "suspect_wallet", "chain", "created_at", "expected_vasp", "expected_confidence_band", "expected_breakpoint_hop")],
    )
    sinks.insert_absent(spark, root, "cases", cases)
    before = sinks.read_table(spark, root, "cases").count()
    sinks.reset_tables(spark, root)
    return sinks.read_table(spark, root, "cases").agg(F.count(F.lit(1)).alias("rows_after")).select(
        F.lit("cases").alias("name"), "rows_after", F.lit(before).cast("bigint").alias("rows_before")
    )


@query(
    "a12_persist_case_results",
    f"WITH RECURSIVE {SCORES} SELECT case_id, count(*) AS attributions, max(CAST(score AS DOUBLE)) AS best FROM sc GROUP BY case_id",
)
def _(spark, sf):
    g = traced_graph(spark, sf)
    scores = scoring.score_cases(g.cases, g.nodes, g.edges, g.labels)
    path = stage_path(spark, "attributions")
    sinks.write_case_results(scores.select("case_id", "entity", "rank", "score", "band"), path, 2)
    return spark.read.parquet(path).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("attributions"), F.max("score").alias("best")
    )


@query(
    "a13_audit_log",
    f"""WITH {EV} SELECT tx AS case_id, sha256(concat_ws('|', tx, f, kind, CAST(v AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS event_hash FROM ev""",
)
def _(spark, sf):
    rows = _events(spark, sf).select(
        F.col("tx").alias("case_id"),
        F.col("f").alias("actor"),
        F.col("kind").alias("action"),
        F.col("value_text").alias("detail"),
        F.col("ts").alias("created_at"),
    )
    return sinks.audit_rows(rows).select("case_id", "event_hash")


# --- scalar rules ---

_SPELLED = "CASE kind WHEN 'view' THEN ' BTC' WHEN 'click' THEN 'Eth ' WHEN 'error' THEN 'bsc' WHEN 'signup' THEN 'MATIC' ELSE 'arbitrum' END"


def _spelled():
    kind = F.col("kind")
    return (
        F.when(kind == "view", " BTC")
        .when(kind == "click", "Eth ")
        .when(kind == "error", "bsc")
        .when(kind == "signup", "MATIC")
        .otherwise("arbitrum")
    )


@query(
    "b1_canonical_chain",
    f"""WITH {EV} SELECT CASE kind WHEN 'view' THEN 'bitcoin' WHEN 'click' THEN 'ethereum' WHEN 'error' THEN 'bnb' WHEN 'signup' THEN 'polygon' ELSE 'unknown' END AS chain,
  count(*) AS records FROM ev GROUP BY 1""",
)
def _(spark, sf):
    chain = text.canonical_chain(_spelled(), "unknown").alias("chain")
    return _events(spark, sf).groupBy(chain).agg(F.count(F.lit(1)).alias("records"))


@query(
    "b2_registry_chain",
    f"""WITH {EV} SELECT CASE kind WHEN 'view' THEN 'bitcoin' WHEN 'click' THEN 'ethereum' WHEN 'error' THEN 'bsc' WHEN 'signup' THEN 'matic' ELSE 'arbitrum' END AS chain,
  count(*) AS records FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return _events(spark, sf).groupBy(text.registry_chain(_spelled()).alias("chain")).agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "b3_transaction_status",
    f"""WITH {EV} SELECT CASE kind WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'pending' WHEN 'signup' THEN 'confirmed' ELSE 'unknown' END AS status,
  count(*) AS records FROM ev GROUP BY 1""",
)
def _(spark, sf):
    kind = F.col("kind")
    word = (
        F.when(kind == "view", " Success")
        .when(kind == "click", "0")
        .when(kind == "error", "MEMPOOL")
        .when(kind == "signup", "ok")
        .otherwise("odd")
    )
    return _events(spark, sf).groupBy(text.transaction_status(word).alias("status")).agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "b4_address_keys",
    f"""WITH {EV}, x AS (SELECT CASE kind WHEN 'view' THEN 'bitcoin' ELSE 'ethereum' END AS chain, CASE WHEN event_id % 2 = 0 THEN 'Q' ELSE 'q' END || user_id AS a FROM ev)
SELECT chain, count(DISTINCT CASE chain WHEN 'bitcoin' THEN a ELSE lower(a) END) AS keys, count(DISTINCT lower(a)) AS folded FROM x GROUP BY chain""",
)
def _(spark, sf):
    rows = _events(spark, sf).select(
        F.when(F.col("kind") == "view", "bitcoin").otherwise("ethereum").alias("chain"),
        F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, "Q").otherwise("q"), "user_id").alias("a"),
    )
    return rows.groupBy("chain").agg(
        F.count_distinct(text.address_key(F.col("chain"), F.col("a"))).alias("keys"),
        F.count_distinct(text.address_key(F.col("chain"), F.col("a"), fold_all=True)).alias("folded"),
    )


@query(
    "b5_amount_from_units",
    f"""WITH {EV}, x AS (SELECT event_id, CAST(event_id * 1234567 AS VARCHAR) AS raw, user_id % 19 AS d, kind, v FROM ev),
p AS (SELECT *, lpad(raw, CAST(greatest(length(raw), d + 1) AS INT), '0') AS z FROM x)
SELECT event_id, CAST(CASE kind WHEN 'view' THEN CAST(v AS DECIMAL(38,18)) WHEN 'error' THEN CAST(0 AS DECIMAL(38,18))
  ELSE CAST(left(z, length(z) - d) || '.' || right(z, d) || '0' AS DECIMAL(38,18)) END AS VARCHAR) AS amount FROM p""",
)
def _(spark, sf):
    kind = F.col("kind")
    raw = F.when(kind == "view", F.col("value_text")).when(
        kind != "error", (F.col("event_id") * 1234567).cast("string")
    )
    amount = amounts.to_amount(raw, (F.col("user_id") % 19).cast("int"))
    return _events(spark, sf).select("event_id", amounts.plain_text(amount).alias("amount"))


@query(
    "b6_units_from_amount",
    f"""WITH {EV}, x AS (SELECT event_id, cents, user_id % 9 AS d FROM ev)
SELECT event_id, CAST(CASE WHEN d >= 2 THEN cents * CAST(power(10, d - 2) AS BIGINT) WHEN d = 1 THEN cents // 10 ELSE cents // 100 END AS VARCHAR) AS units FROM x""",
)
def _(spark, sf):
    amount = F.col("value").cast("decimal(38,18)")
    return _events(spark, sf).select(
        "event_id", amounts.to_raw(amount, F.col("user_id") % 9).alias("units")
    )


@query(
    "b7_b8_b9_timestamps",
    f"""WITH {EV} SELECT event_id, CASE WHEN kind = 'error' THEN NULL ELSE epoch(ts) :: BIGINT END AS ts_s, kind = 'error' AS ts_missing FROM ev""",
)
def _(spark, sf):
    kind = F.col("kind")
    seconds = F.unix_seconds("ts")
    raw = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .when(kind == "signup", seconds.cast("string"))
        .when(kind == "purchase", (seconds * 1000).cast("string"))
        .otherwise("not a time")
    )
    parsed = times.parse_tron_time(raw)
    return _events(spark, sf).select(
        "event_id", F.unix_seconds(parsed).alias("ts_s"), parsed.isNull().alias("ts_missing")
    )


@query(
    "b10_transfer_defaults",
    f"""WITH {EV} SELECT tx || '_' || (event_id % 3) AS transfer_id, tx AS tx_hash, CASE kind WHEN 'view' THEN 'ETH' ELSE kind END AS asset_symbol,
  CASE WHEN kind = 'click' THEN '0xc' || user_id WHEN kind = 'view' THEN 'ETH' ELSE kind END AS asset_id,
  CASE WHEN kind = 'click' THEN 'erc20' ELSE 'native' END AS asset_type, CAST(v AS DOUBLE) AS amount FROM ev""",
)
def _(spark, sf):
    rows = _events(spark, sf).select(
        F.col("tx").alias("tx_id"),
        F.when(F.col("kind") != "view", F.col("kind")).alias("asset"),
        F.when(F.col("kind") == "click", F.concat(F.lit("0xc"), "user_id")).alias("token_contract"),
        F.col("value_text").alias("amount"),
        F.col("f").alias("from_address"),
        F.col("t").alias("to_address"),
        (F.col("event_id") % 3).alias("transfer_index"),
    )
    return normalize.default_transfer_fields(rows).select(
        "transfer_id", "tx_hash", "asset_symbol", "asset_id", "asset_type", _double("amount")
    )


@query(
    "b11_transaction_and_edge_defaults",
    f"""WITH {EV} SELECT tx AS id, CASE kind WHEN 'view' THEN 'FIXTURE' ELSE kind END AS detail, epoch(ts) :: BIGINT AS number FROM ev
UNION ALL SELECT tx || '_0', CASE kind WHEN 'view' THEN 'ETH' ELSE kind END, cents FROM ev""",
)
def _(spark, sf):
    ev = _events(spark, sf)
    named = F.when(F.col("kind") != "view", F.col("kind"))
    transactions = normalize.default_transaction_fields(
        ev.select(
            F.col("tx").alias("tx_id"),
            named.alias("source"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.lit("0.1").alias("fee"),
        )
    )
    edges = normalize.default_edge_fields(
        ev.select(F.col("tx").alias("tx_id"), named.alias("asset"), "value_text").withColumnRenamed(
            "value_text", "amount"
        )
    )
    return transactions.select(
        F.col("tx_hash").alias("id"), F.col("provider").alias("detail"), F.unix_seconds("ts").alias("number")
    ).union(edges.select("transfer_id", "asset_symbol", (F.col("amount") * 100).cast("bigint")))


@query(
    "b12_transaction_view",
    f"""WITH {EV} SELECT tx AS tx_hash, f AS from_address, t AS to_address, CASE kind WHEN 'error' THEN 'BTC' ELSE 'ETH' END AS asset,
  CAST(v + CASE kind WHEN 'purchase' THEN 0.0 ELSE 1.5 END AS DOUBLE) AS amount FROM ev""",
)
def _(spark, sf):
    found = normalize.transaction_view(normalize.transactions_from_records(_records_typed(spark, sf)))
    return found.select("tx_hash", "from_address", "to_address", "asset", _double("amount"))


def _records_typed(spark, sf):
    """Records through the declared schema without a file in between."""
    return _typed(_records(spark, sf), RAW_RECORD)


def _typed(df, schema):
    """Rows through JSON into a schema; out of a generator, as filters on them would be pushed below and parse once more."""
    return df.select(F.inline_outer(F.array(F.from_json(F.to_json(F.struct("*")), schema))))


# --- chain normalisers ---


def _utxo(spark, sf):
    """Orders as two-input, two-output transactions with a fee of 2,000 units; a part of
    them lacks the address of its first input, some do not balance."""
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    half = F.floor(cents / 2).cast("bigint")
    key = F.col("o_orderkey")

    def spent(address, value):
        return _struct(
            txid=F.concat(F.lit("p"), key),
            prevout=_struct(scriptpubkey_address=address, value=value.cast("string")),
        )

    def paid(address, value):
        return _struct(scriptpubkey_address=address, value=value.cast("string"))

    first = F.when(key % 3 != 0, F.concat(F.lit("1C"), "o_custkey"))
    leak = F.when(key % 10 == 0, 5).otherwise(0)
    rows = tables.load(spark, sf, "orders").select(
        F.concat(F.lit("u"), key).alias("txid"),
        key.alias("block_height"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("2000").alias("fee"),
        F.array(spent(first, half), spent(F.concat(F.lit("3D"), "o_custkey"), cents - half)).alias("vin"),
        F.array(
            paid(F.concat(F.lit("1S"), key % 97), half),
            paid(F.concat(F.lit("1C"), "o_custkey"), cents - half - 2000 - leak),
        ).alias("vout"),
    )
    return _typed(rows, RAW_UTXO)


UT = """ut AS (SELECT o_orderkey AS key, 'u' || o_orderkey AS tx, CASE WHEN o_orderkey % 3 <> 0 THEN '1C' ELSE '3D' END || o_custkey AS sender, o_custkey,
  CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS c, CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END AS leak FROM orders)"""


@query(
    "b13_utxo_normalisation",
    f"""WITH {UT} SELECT tx || '_0' AS transfer_id, sender AS from_address, '1S' || (key % 97) AS to_address, CAST(c // 2 AS VARCHAR) AS raw_amount,
  CAST(CAST(c // 2 AS DECIMAL(38,8)) / 100000000 AS DOUBLE) AS amount FROM ut
UNION ALL SELECT tx || '_1', sender, '1C' || o_custkey, CAST(c - c // 2 - 2000 - leak AS VARCHAR), CAST(CAST(c - c // 2 - 2000 - leak AS DECIMAL(38,8)) / 100000000 AS DOUBLE) FROM ut""",
)
def _(spark, sf):
    found = normalize.explode_transfers(normalize.normalize_utxo(_utxo(spark, sf)))
    return found.select("transfer_id", "from_address", "to_address", "raw_amount", _double("amount"))


@query(
    "b28_value_preservation",
    f"WITH {UT} SELECT tx AS tx_hash, 0.00000005 :: DOUBLE AS difference FROM ut WHERE leak > 0",
)
def _(spark, sf):
    found = normalize.value_mismatches(normalize.normalize_utxo(_utxo(spark, sf)))
    return found.select("tx_hash", _double("difference"))


def _tokens(*items):
    return F.array(*[_struct(**i) for i in items])


def _account(spark, sf):
    kind = F.col("kind")
    token = _tokens(
        {"from": F.col("f"), "to": F.col("t"), "contract_address": F.lit("0xusdt"), "symbol": F.lit("USDT"), "decimals": F.lit(6), "amount": F.col("cents")},
        {"from": F.col("t"), "to": F.col("f"), "contract_address": _none(), "symbol": _none(), "decimals": F.lit(None).cast("int"), "amount": F.lit("2.5")},
    )
    rows = _events(spark, sf).select(
        F.col("tx").alias("hash"),
        F.when(kind == "error", "bsc").when(kind == "click", "matic").otherwise("zzz").alias("chain"),
        F.col("f").alias("from"),
        F.col("t").alias("to"),
        F.unix_seconds("ts").cast("string").alias("timestamp"),
        F.when(kind.isin("view", "error"), F.concat("cents", F.lit("0000000000000000"))).otherwise("0").alias("value"),
        F.when(kind.isin("click", "error"), token).alias("token_transfers"),
        F.when(kind == "signup", "0xabcd").otherwise("0x").alias("input"),
        F.lit("21000").alias("gasUsed"),
        (F.col("event_id") + 1).cast("string").alias("gasPrice"),
        F.when(kind == "signup", "0x1").when(kind == "purchase", "failed").alias("status"),
    )
    return _typed(rows, RAW_ACCOUNT)


_ACCOUNT_ROWS = f"""{EV}, acc AS (SELECT *, CASE kind WHEN 'error' THEN 'bnb' WHEN 'click' THEN 'polygon' ELSE 'ethereum' END AS chain,
  kind IN ('click', 'error') AS tok, CASE WHEN kind IN ('view', 'error') THEN v ELSE 0 END AS nat FROM ev),
acn AS (SELECT *, nat > 0 OR NOT tok AS native FROM acc)"""


@query(
    "b14_account_normalisation",
    f"""WITH {_ACCOUNT_ROWS} SELECT tx || '_0' AS transfer_id, f AS from_address, CASE chain WHEN 'bnb' THEN 'BNB' WHEN 'polygon' THEN 'MATIC' ELSE 'ETH' END AS asset_symbol,
  'native' AS asset_type, CAST(nat AS DOUBLE) AS amount FROM acn WHERE native
UNION ALL SELECT tx || '_' || CASE WHEN native THEN 1 ELSE 0 END, f, 'USDT', CASE chain WHEN 'bnb' THEN 'bep20' ELSE 'erc20' END, CAST(CAST(cents AS DECIMAL(38,6)) / 1000000 AS DOUBLE) FROM acn WHERE tok
UNION ALL SELECT tx || '_' || CASE WHEN native THEN 2 ELSE 1 END, t, 'TOKEN', CASE chain WHEN 'bnb' THEN 'bep20' ELSE 'erc20' END, 2.5 FROM acn WHERE tok""",
)
def _(spark, sf):
    found = normalize.explode_transfers(normalize.normalize_account(_account(spark, sf)))
    return found.select("transfer_id", "from_address", "asset_symbol", "asset_type", _double("amount"))


@query(
    "b20_b21_type_status_fee",
    f"""WITH {_ACCOUNT_ROWS} SELECT tx AS tx_hash, chain, CASE WHEN tok AND nat > 0 THEN 'mixed' WHEN tok THEN 'token_transfer' WHEN kind = 'signup' THEN 'contract_call' ELSE 'native_transfer' END AS transaction_type,
  CASE kind WHEN 'purchase' THEN 'failed' ELSE 'confirmed' END AS status, 21000 * (event_id + 1) AS fee_wei FROM acn""",
)
def _(spark, sf):
    found = normalize.normalize_account(_account(spark, sf))
    return found.select(
        "tx_hash", "chain", "transaction_type", "status",
        amounts.to_raw(F.col("fee"), F.lit(18)).cast("bigint").alias("fee_wei"),
    )


def _tron(spark, sf):
    kind = F.col("kind")
    token = _tokens({"from": F.col("f"), "to": F.col("t"), "amount": F.col("cents")})
    rows = _events(spark, sf).select(
        F.col("tx").alias("txID"),
        F.struct((F.unix_seconds("ts") * 1000).cast("string").alias("timestamp")).alias("raw_data"),
        F.col("f").alias("owner_address"),
        F.col("t").alias("to_address"),
        F.when(kind == "view", F.col("cents")).otherwise("0").alias("amount"),
        F.when(kind == "click", "1500000").otherwise("7").alias("fee"),
        F.when(kind == "click", token).alias("trc20_transfers"),
    )
    return _typed(rows, RAW_TRON)


@query(
    "b15_tron_normalisation",
    f"""WITH {EV} SELECT tx || '_0' AS transfer_id, CASE kind WHEN 'click' THEN 'USDT' ELSE 'TRX' END AS asset_symbol,
  CAST(CAST(CASE WHEN kind IN ('view', 'click') THEN cents ELSE 0 END AS DECIMAL(38,6)) / 1000000 AS DOUBLE) AS amount,
  CASE kind WHEN 'click' THEN 1.5 ELSE 7.0 END :: DOUBLE AS fee, epoch(ts) :: BIGINT AS ts_s FROM ev""",
)
def _(spark, sf):
    found = normalize.explode_transfers(normalize.normalize_tron(_tron(spark, sf)), "fee")
    return found.select(
        "transfer_id", "asset_symbol", _double("amount"), _double("fee"), F.unix_seconds("ts").alias("ts_s")
    )


@query(
    "b16_dispatch_by_chain",
    f"""WITH {EV} SELECT CASE kind WHEN 'view' THEN 'bitcoin' WHEN 'click' THEN 'tron' WHEN 'error' THEN 'bnb' ELSE 'ethereum' END AS chain,
  CASE kind WHEN 'view' THEN 'BTC' WHEN 'click' THEN 'TRX' WHEN 'error' THEN 'BNB' ELSE 'ETH' END AS fee_asset, count(*) AS transactions FROM ev GROUP BY 1, 2""",
)
def _(spark, sf):
    kind = F.col("kind")
    spelled = F.when(kind == "view", "BTC").when(kind == "click", "trx").when(kind == "error", "binance").otherwise("unheard of")

    def raw(schema, **fields):
        return F.from_json(F.to_json(_struct(**fields)), schema)

    mixed = _events(spark, sf).select(
        spelled.alias("chain"),
        raw(RAW_UTXO, txid=F.col("tx"), from_address=F.col("f"), to_address=F.col("t"), amount=F.col("value_text")).alias("utxo"),
        raw(RAW_ACCOUNT, hash=F.col("tx"), to=F.col("t"), value=F.col("value_text")).alias("account"),
        raw(RAW_TRON, txID=F.col("tx"), to_address=F.col("t"), amount=F.col("value_text")).alias("tron"),
    )
    return normalize.dispatch_by_chain(mixed).groupBy("chain", "fee_asset").agg(
        F.count(F.lit(1)).alias("transactions")
    )


# --- explorer payloads ---


def _items(spark, sf):
    """Explorer transfers: many share a transaction (one per user) and a location."""
    kind = F.col("kind")
    native = kind == "view"
    item = _struct(
        Block=_struct(
            Hash=F.concat(F.lit("h"), F.floor(F.col("event_id") / 10)),
            Number=F.floor(F.col("event_id") / 10).cast("string"),
            Time=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ),
        Log=F.when(kind == "click", _struct(Index=F.col("k") % 3)),
        Call=F.when(kind == "error", _struct(Index=F.col("k") % 2)),
        Transaction=_struct(Hash=F.concat(F.lit("0xT"), "user_id"), From=F.col("f"), To=F.col("t")),
        Transfer=_struct(
            Amount=F.when(kind != "signup", F.col("value_text")),
            Id=F.when(kind == "purchase", F.concat(F.lit("id"), F.col("k") % 5)).otherwise("0"),
            Index=F.when(native, F.col("k") % 4),
            Sender=F.when(kind != "signup", F.col("f")),
            Receiver=F.col("t"),
            Type=F.when(native, "call").when(kind == "signup", "Token"),
            Currency=_struct(
                Native=native,
                Symbol=F.when(native, "ETH").when(kind == "click", "USDT"),
                Name=F.when(kind == "click", F.concat(F.lit("Tether "), F.col("k") % 2)),
                SmartContract=F.when(~native, F.concat(F.lit("0xC"), F.col("k") % 7)),
                Decimals=F.when(kind == "click", 6),
            ),
        ),
    )
    text_item = F.from_json(F.to_json(item), EXPLORER_TRANSFER)
    return _events(spark, sf).select(
        F.lit("p").alias("payload"), F.col("event_id").alias("position"), text_item.alias("i")
    ).select("payload", "position", "i.*")


_ITEM_ROWS = f"""{EV}, it AS (SELECT *, '0xT' || user_id AS h, CASE kind WHEN 'click' THEN 'log_' || (k % 3) WHEN 'error' THEN 'call_' || (k % 2)
  WHEN 'purchase' THEN 'id' || (k % 5) WHEN 'view' THEN 'call_' || (k % 4) ELSE 'token_0' END AS loc FROM ev),
oc AS (SELECT *, row_number() OVER (PARTITION BY h, loc ORDER BY event_id) - 1 AS n FROM it)"""


@query(
    "a7_explorer_envelopes",
    f"""WITH {EV} SELECT event_id // 2 AS payload, event_id % 2 AS position, f AS sender FROM ev WHERE (event_id // 2) * 2 + event_id % 2 = event_id""",
)
def _(spark, sf):
    """Envelopes of two items each: a pair is rebuilt inside one row from the next event."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(F.floor(F.col("event_id") / 2)).orderBy("event_id")
    rows = _events(spark, sf).select("event_id", "f", F.lead("f").over(ordered).alias("g"))

    def item(sender):
        return F.struct(F.struct(sender.alias("Sender")).alias("Transfer"))

    both = F.filter(F.array(item(F.col("f")), F.when(F.col("g").isNotNull(), item(F.col("g")))), lambda x: x.isNotNull())
    wrapped = F.struct(F.struct(F.struct(both.alias("Transfers")).alias("EVM")).alias("data"))
    text_rows = rows.filter(F.col("event_id") % 2 == 0).select(
        F.floor(F.col("event_id") / 2).alias("payload"), F.to_json(wrapped).alias("body")
    )
    raw = text_rows.select("payload", F.from_json("body", envelope(True)).alias("e")).select("payload", "e.*")
    found = files.payload_items(raw)
    return found.select(
        F.col("payload").cast("bigint").alias("payload"),
        F.col("position").cast("bigint").alias("position"),
        F.col("Transfer.Sender").alias("sender"),
    )


@query(
    "b17_b18_explorer_transfers",
    f"""WITH {_ITEM_ROWS} SELECT 'ethereum:' || h || ':' || loc || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS transfer_id, f AS from_address,
  CASE WHEN kind = 'view' THEN 'ETH' ELSE 'ethereum:0xc' || (k % 7) END AS asset_id, CASE kind WHEN 'view' THEN 'ETH' WHEN 'click' THEN 'USDT' ELSE 'TOKEN' END AS asset_symbol,
  CASE kind WHEN 'view' THEN 'internal' ELSE 'token' END AS transfer_type, CAST(CASE WHEN kind = 'signup' THEN 0 ELSE v END AS DOUBLE) AS amount,
  CAST(CASE kind WHEN 'click' THEN k % 3 WHEN 'error' THEN k % 2 WHEN 'view' THEN k % 4 ELSE n END AS INT) AS transfer_index FROM oc""",
)
def _(spark, sf):
    return explorer.map_transfers(_items(spark, sf)).select(
        "transfer_id", "from_address", "asset_id", "asset_symbol", "transfer_type", _double("amount"), "transfer_index"
    )


def _transaction_items(spark, sf):
    """One transaction per event; every second one attaches transfers of its own hash."""
    kind = F.col("kind")
    item = _struct(
        Block=_struct(Number=F.floor(F.col("event_id") / 10).cast("string"), Hash=F.lit("h"), Time=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        Fee=_struct(EffectiveGasPrice=F.lit("3000000000")),
        Receipt=_struct(GasUsed=F.lit("21000"), Status=F.when(kind == "error", "0").otherwise("1"), ContractAddress=F.lit("")),
        Transaction=_struct(
            Hash=F.concat(F.lit("0xT"), "event_id"), From=F.col("f"), To=F.when(kind != "signup", F.col("t")),
            Value=F.when(kind.isin("view", "error"), F.col("value_text")).otherwise("0"),
            Cost=F.when(kind == "click", "0.25"),
        ),
        TransactionStatus=_struct(Success=F.lit(True)),
    )
    parsed = F.from_json(F.to_json(item), EXPLORER_TRANSACTION)
    return _events(spark, sf).select(parsed.alias("i")).select("i.*")


def _attached(spark, sf):
    """Purchases carry a token transfer, even views a native one from the sender."""
    rows = _events(spark, sf).filter(
        (F.col("kind") == "purchase") | ((F.col("kind") == "view") & (F.col("event_id") % 2 == 0))
    )
    return rows.select(
        F.concat(F.lit("0xt"), "event_id").alias("tx_hash"),
        F.when(F.col("kind") == "purchase", "erc20").otherwise("native").alias("asset_type"),
        F.col("value").cast("decimal(38,18)").alias("amount"),
        F.col("f").alias("from_address"),
    )


_TX_ROWS = f"""{EV}, q AS (SELECT *, '0xT' || event_id AS h, kind = 'view' AND v > 0 AND event_id % 2 = 1 AS implied,
  kind = 'view' AND v > 0 AS natives FROM ev)"""


@query(
    "b19_explorer_transactions",
    f"""WITH {_TX_ROWS} SELECT h AS tx_hash, CASE kind WHEN 'error' THEN 'failed' ELSE 'confirmed' END AS status,
  CASE WHEN kind = 'purchase' THEN 'token_transfer' WHEN natives THEN 'native_transfer' WHEN kind = 'click' OR (kind = 'view' AND FALSE) THEN 'contract_call'
    ELSE 'unknown' END AS transaction_type, implied AS implied_native,
  CASE kind WHEN 'click' THEN 0.25 ELSE 0.000063 END :: DOUBLE AS fee FROM q""",
)
def _(spark, sf):
    found = explorer.map_transactions(_transaction_items(spark, sf), _attached(spark, sf))
    return found.select("tx_hash", "status", "transaction_type", "implied_native", _double("fee"))


@query(
    "b19_implied_transfers",
    f"""WITH {_TX_ROWS} SELECT 'ethereum:' || h || ':0' AS transfer_id, f AS from_address, CAST(v AS DOUBLE) AS amount FROM q WHERE implied""",
)
def _(spark, sf):
    found = explorer.map_transactions(_transaction_items(spark, sf), _attached(spark, sf))
    return explorer.implied_transfers(found).select("transfer_id", "from_address", _double("amount"))


@query(
    "b22_payload_hash",
    """SELECT o_orderkey AS id, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS digest FROM orders""",
)
def _(spark, sf):
    names = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return tables.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), row_digest(names).alias("digest")
    )


@query(
    "b23_asset_dimension",
    f"""WITH {EV}, c AS (SELECT 'ethereum:0xc' || (k % 7) AS asset_id, ts, CASE kind WHEN 'click' THEN 'USDT' ELSE 'TOKEN' END AS symbol,
  CASE kind WHEN 'click' THEN 'Tether ' || (k % 2) ELSE 'TOKEN Token' END AS name, CASE kind WHEN 'click' THEN 6 ELSE 18 END AS decimals FROM ev WHERE kind <> 'view')
SELECT asset_id, arg_max(symbol, (ts, symbol, name)) AS symbol, arg_max(name, (ts, symbol, name)) AS name, arg_max(decimals, (ts, symbol, name)) AS decimals FROM c GROUP BY asset_id""",
)
def _(spark, sf):
    return explorer.asset_dimension(_items(spark, sf)).select("asset_id", "symbol", "name", "decimals")


@query(
    "b24_block_dimension",
    f"""WITH {EV} SELECT event_id // 10 AS block_number, 'h' || (event_id // 10) AS block_hash, epoch(min(ts)) :: BIGINT AS ts_s FROM ev GROUP BY 1, 2""",
)
def _(spark, sf):
    return explorer.block_dimension(_items(spark, sf)).select(
        "block_number", "block_hash", F.unix_seconds("ts").alias("ts_s")
    )


# A digest is almost never a valid checksum spelling, so mixed case means a mismatch.
@query(
    "b25_address_audit",
    f"""WITH {EV}, a AS (SELECT DISTINCT CASE kind WHEN 'view' THEN 'bitcoin' WHEN 'click' THEN 'tron' WHEN 'error' THEN 'solana' ELSE 'ethereum' END AS chain,
  CASE kind WHEN 'view' THEN 'bc1q' || user_id WHEN 'click' THEN 'T' || user_id WHEN 'error' THEN 'S' || user_id
    WHEN 'signup' THEN '0x' || substr(sha256(f), 1, 40) ELSE '0x' || upper(substr(sha256(f), 1, 20)) || substr(sha256(f), 21, 20) END AS address FROM ev),
m AS (SELECT *, regexp_matches(substr(address, 3), '[A-F]') AND regexp_matches(substr(address, 3), '[a-f]') AS mixed FROM a)
SELECT chain, CASE WHEN chain <> 'ethereum' THEN 'NONE' WHEN mixed THEN 'HEX_MIXED_INVALID_CHECKSUM' ELSE 'HEX_RAW' END AS format_type,
  CASE chain WHEN 'ethereum' THEN TRUE WHEN 'solana' THEN NULL ELSE FALSE END AS valid,
  CASE WHEN chain = 'solana' THEN NULL WHEN chain <> 'ethereum' THEN FALSE WHEN mixed THEN FALSE END AS checksum_valid, count(*) AS addresses
FROM m GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    kind, user = F.col("kind"), F.col("user_id")
    digest = F.sha2(F.col("f"), 256)
    address = (
        F.when(kind == "view", F.concat(F.lit("bc1q"), user))
        .when(kind == "click", F.concat(F.lit("T"), user))
        .when(kind == "error", F.concat(F.lit("S"), user))
        .when(kind == "signup", F.concat(F.lit("0x"), F.substring(digest, 1, 40)))
        .otherwise(F.concat(F.lit("0x"), F.upper(F.substring(digest, 1, 20)), F.substring(digest, 21, 20)))
    )
    chain = F.when(kind == "view", "btc").when(kind == "click", "trx").when(kind == "error", "sol").otherwise("eth")
    rows = _events(spark, sf).select(chain.alias("chain"), address.alias("address"))
    return audit_report(audit_addresses(rows))


@query(
    "b26_transfer_logs",
    f"""WITH {EV} SELECT tx AS tx_hash, '0x' || lpad(lower(hex(user_id)), 40, '0') AS from_address, '0x' || lpad(lower(hex(k)), 40, '0') AS to_address,
  CAST(event_id * 1000003 AS VARCHAR) AS raw_amount, CAST(CAST(event_id * 1000003 AS DECIMAL(38,6)) / 1000000 AS DOUBLE) AS amount FROM ev WHERE kind <> 'view'""",
)
def _(spark, sf):
    def topic(value):
        return F.concat(F.lit("0x"), F.lpad(F.hex(value), 64, "0"))

    first = F.when(F.col("kind") == "view", F.lit("0x00")).otherwise(normalize.TRANSFER_TOPIC)
    logs = _events(spark, sf).select(
        F.col("tx").alias("tx_hash"),
        F.lit(0).alias("log_index"),
        F.lit("0xusdt").alias("contract"),
        F.lit(6).alias("decimals"),
        F.array(first, topic(F.col("user_id")), topic(F.col("k").cast("bigint"))).alias("topics"),
        F.concat(F.lit("0x"), F.lpad(F.hex(F.col("event_id") * 1000003), 64, "0")).alias("data"),
    )
    return normalize.decode_transfer_logs(logs).select(
        "tx_hash", "from_address", "to_address", "raw_amount", _double("amount")
    )


@query(
    "b27_dust_flags",
    f"WITH {TR} SELECT asset_symbol, count(*) FILTER (WHERE amount < 1.5) AS dust, count(*) AS transfers FROM tr GROUP BY asset_symbol",
)
def _(spark, sf):
    flagged = risk.dust_flags(tables.event_transfers(spark, sf), "1.5")
    return flagged.groupBy("asset_symbol").agg(
        F.count_if("is_dust").alias("dust"), F.count(F.lit(1)).alias("transfers")
    )

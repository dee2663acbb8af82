"""Files, sinks, entities, evidence, normalisers, explorer payloads, streaming."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerhop.operators import entities, evidence, explorer, lookup, normalize
from ledgerhop.plans.catalog.rows import _typed
from ledgerhop.schema import RAW_ACCOUNT, RAW_RECORD, RAW_TRON, RAW_UTXO, TRANSFERS
from ledgerhop.sources import files, sinks
from ledgerhop.staging import stage_root
from ledgerhop.streaming import transfers as streaming
from samples import edges, transfers


def raw(spark, record, schema):
    df = spark.createDataFrame([(json.dumps(record),)], "v string")
    return df.select(F.from_json("v", schema).alias("r")).select("r.*")


def test_utxo(spark):
    record = {
        "txid": "b1", "fee": 15000, "timestamp": "2026-03-10T10:00:00Z",
        "vin": [{"txid": "p0", "vout": 0, "prevout": {"value": 120000000}},
                {"txid": "p", "vout": 0, "prevout": {"scriptpubkey_address": "1In", "value": 80000000}}],
        "vout": [{"scriptpubkey_address": "1Out", "value": 145000000, "n": 0}, {"scriptpubkey_address": "1In", "value": 54985000, "n": 1}],
    }
    tx = normalize.normalize_utxo(raw(spark, record, RAW_UTXO))
    row = tx.first()
    assert row["fee"] == Decimal("0.00015") and [i["output_index"] for i in row["inputs"]] == [0, 0]
    moved = normalize.explode_transfers(tx).orderBy("transfer_index").collect()
    assert [(t["from_address"], t["to_address"], t["amount"]) for t in moved] == [
        ("1In", "1Out", Decimal("1.45")), ("1In", "1In", Decimal("0.54985"))]
    assert normalize.value_mismatches(tx).count() == 0
    coinbase = normalize.normalize_utxo(raw(spark, {"txid": "c", "vin": [{"coinbase": "00"}], "vout": record["vout"][:1]}, RAW_UTXO))
    assert normalize.explode_transfers(coinbase).first()["from_address"] == "COINBASE"
    direct = normalize.normalize_utxo(raw(spark, {"tx_id": "d", "from_address": "x", "to_address": "y", "amount": "0.5"}, RAW_UTXO))
    assert direct.first()["outputs"][0]["amount"] == Decimal("0.5")


def test_account_tokens_and_native(spark):
    record = {
        "hash": "h", "from": "s", "to": "r", "value": "0", "gasUsed": "100000", "gasPrice": "20000000000",
        "token_transfers": [{"from": "s", "to": "r", "contract_address": "0xu", "symbol": "USDT", "decimals": 6, "amount": "1000000000"},
                            {"from": "s", "to": "q", "contract_address": "0xc", "symbol": "USDC", "decimals": 6, "amount": "2500000000"}],
    }
    tx = normalize.normalize_account(raw(spark, record, RAW_ACCOUNT))
    row = tx.first()
    assert row["transaction_type"] == "token_transfer" and row["fee"] == Decimal("0.002")
    got = {t["asset_symbol"]: (t["amount"], t["transfer_id"]) for t in row["transfers"]}
    assert got == {"USDT": (Decimal(1000), "h_0"), "USDC": (Decimal(2500), "h_1")}
    mixed = normalize.normalize_account(raw(spark, {**record, "value": "1500000000000000000"}, RAW_ACCOUNT)).first()
    assert mixed["transaction_type"] == "mixed"
    assert [(t["transfer_id"], t["asset_symbol"]) for t in mixed["transfers"]] == [("h_0", "ETH"), ("h_1", "USDT"), ("h_2", "USDC")]


def test_tron(spark):
    record = {
        "txID": "t", "owner_address": "TA", "to_address": "TB", "fee": 1500000, "raw_data": {"timestamp": 1773477310000},
        "trc20_transfers": [{"from": "TA", "to": "TB", "amount": "50000000000"}],
    }
    row = normalize.normalize_tron(raw(spark, record, RAW_TRON)).first()
    assert row["fee"] == Decimal("1.5")
    assert [(t["asset_symbol"], t["amount"]) for t in row["transfers"]] == [("USDT", Decimal(50000))]
    assert int(row["ts"].timestamp()) == 1773477310


def item(tx, **over):
    transfer = {"Amount": "1.5", "Id": "", "Index": 0, "Sender": "s", "Receiver": "r", "Type": "token",
                "Currency": {"SmartContract": "0xC", "Symbol": "USDT", "Decimals": 6, "Name": "Tether"}}
    return {"Block": {"Number": "7", "Hash": "h7", "Time": "2026-03-14T08:35:10Z"}, "Transaction": {"Hash": tx, "From": "s", "To": "r"}, "Transfer": transfer, **over}


def test_explorer_payload(spark, tmp_path):
    native = {"Amount": "2", "Type": "call", "Sender": "s", "Receiver": "r", "Currency": {"Native": True, "Symbol": "ETH"}}
    items = [item("0xA"), item("0xa"), item("0xA", Log={"Index": 3}), item("0xA", Call={"Index": 0}, Transfer=native)]
    path = tmp_path / "transfers.json"
    path.write_text(json.dumps({"data": {"EVM": {"Transfers": items}}}, indent=1))
    found = files.read_payload(spark, str(path))
    mapped = explorer.map_transfers(found)
    got = {r["transfer_id"]: r for r in mapped.collect()}
    assert set(got) == {"ethereum:0xA:token_0", "ethereum:0xa:token_0_1", "ethereum:0xA:log_3", "ethereum:0xA:call_0"}
    call = got["ethereum:0xA:call_0"]
    assert (call["transfer_type"], call["asset_id"], call["token_contract"]) == ("internal", "ETH", None)
    assert got["ethereum:0xA:log_3"]["raw_amount"] == "1500000"
    assert explorer.asset_dimension(found).first()["asset_id"] == "ethereum:0xc"
    assert explorer.block_dimension(found).first()["block_number"] == 7

    tx = {"Block": {"Number": "7"}, "Transaction": {"Hash": "0xB", "From": "s", "To": "r", "Value": "1.25"}, "Receipt": {"GasUsed": "21000"}, "Fee": {"EffectiveGasPrice": "1000000000"}}
    path = tmp_path / "transactions.json"
    path.write_text(json.dumps({"data": {"EVM": {"Transactions": [tx]}}}))
    done = explorer.map_transactions(files.read_payload(spark, str(path), transfers=False), mapped)
    row = done.first()
    assert (row["transaction_type"], row["fee"]) == ("native_transfer", Decimal("0.000021"))
    assert explorer.implied_transfers(done).first()["amount"] == Decimal("1.25")


def test_record_files_with_aliases(spark, tmp_path):
    record = {"tx_id": "x1", "chain": "BTC", "timestamp": "2026-03-14T08:35:10Z", "status": "SUCCESS", "from_address": "1a", "to_address": "1b",
              "amount": 1.45, "fee": 0.0001, "transfers": [{"from_address": "1a", "to_address": "1b", "asset": "BTC", "amount": 1.45}]}
    (tmp_path / "case_a.json").write_text(json.dumps([record, {**record, "tx_id": "x2", "transfers": []}], indent=1))
    (tmp_path / "single.json").write_text(json.dumps({"tx_hash": "y", "from_address": "p", "to_address": "q", "amount": 3}))
    aliases = spark.createDataFrame([("case_a.json", "CASE-A")], "file_name string, case_id string")
    tx = normalize.transactions_from_records(files.with_case_alias(files.read_records(spark, str(tmp_path)), aliases))
    got = {(r["case_id"], r["transfer_id"]): r for r in normalize.explode_transfers(tx, "case_id").collect()}
    assert set(got) == {("CASE-A", "x1_0"), ("CASE-A", "x2_0"), ("single", "y_0")}
    assert got["CASE-A", "x1_0"]["raw_amount"] == "145000000"
    assert got["single", "y_0"]["amount"] == Decimal("0.000000000000000003")


def test_label_files(spark, tmp_path):
    one = [{"entity_id": "V", "entity_name": "No address"}, {"address": "0xAA", "chain": "eth", "entity_name": "Old", "entity_type": "VASP_HOT"}]
    two = [{"address": "0xaa", "chain": "ETH", "entity_name": "New", "entity_type": "VASP_DEPOSIT", "confidence": 0.9}, {"address": "TzZ", "chain": "trx", "entity_name": "T"}]
    paths = []
    for name, rows in (("a.json", one), ("b.json", two)):
        (tmp_path / name).write_text(json.dumps(rows, indent=1))
        paths.append(str(tmp_path / name))
    records = files.read_label_files(spark, paths)
    base = {r["node"]: r["entity_name"] for r in files.knowledge_base(records).collect()}
    assert base == {"0xaa": "New", "TzZ": "T"}  # Base58 keys keep their case
    registry = files.registry(records)
    asked = spark.createDataFrame([("eth", "0xAA"), ("tron", "TzZ"), ("tron", "tzz")], "chain string, address string")
    got = {r["address"]: r["resolution_status"] for r in entities.resolve_registry(asked, registry).collect()}
    assert got == {"0xAA": "AMBIGUOUS", "TzZ": "RESOLVED", "tzz": "NOT_FOUND"}
    assert entities.candidate_rows(registry).count() == 2
    more = spark.createDataFrame([("TzZ", "tron", "Other")], "address string, chain string, entity_name string")
    merged = files.registry(files.add_records(records, more.withColumn("position", F.lit(0))))
    assert entities.registry_status(merged).filter("resolution_status = 'AMBIGUOUS'").count() == 2


def test_cases_and_truth(spark, tmp_path):
    (tmp_path / "case.json").write_text(json.dumps({"case_id": "C", "suspect_wallet": "0x1", "chain": "ETH"}, indent=1))
    (tmp_path / "truth.json").write_text(json.dumps({"benchmark_cases": [{"case_id": "C", "ground_truth_vasp": "X"}, {"case_id": "D"}]}, indent=1))
    assert files.read_cases(spark, str(tmp_path / "case.json")).first()["suspect_wallet"] == "0x1"
    assert files.read_truth(spark, str(tmp_path / "truth.json")).count() == 2


def test_insert_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "db")
    sinks.reset_tables(spark, root)
    rows = transfers(spark, [("t1", "a", "b", 1), ("t2", "a", "b", 2), ("t1", "a", "b", 3)])
    for _ in range(2):
        sinks.insert_absent(spark, root, "transfers", rows)
    assert sinks.read_table(spark, root, "transfers").count() == 2
    sinks.reset_tables(spark, root)
    assert sinks.read_table(spark, root, "transfers").count() == 0


def test_snapshot_ignores_order_and_sees_changes(spark):
    e = edges(spark, [(f"t{n}", "a", f"b{n}", n + 1) for n in range(30)]).withColumn("case_id", F.lit("c"))
    first = evidence.snapshot(e)
    again = evidence.snapshot(e.orderBy(F.desc("transfer_id")).repartition(3))
    assert first.collect() == again.collect() and first.first()["records"] == 30
    assert evidence.verify_snapshot(first, e).first()["integrity"] == "VALID"
    assert evidence.verify_snapshot(first, e.filter("transfer_id <> 't3'")).first()["integrity"] == "TAMPERED"
    doubled = e.union(e.filter("transfer_id = 't3'"))
    assert evidence.verify_snapshot(first, doubled).first()["integrity"] == "TAMPERED"


def test_pages(spark):
    df = spark.range(25).select(F.col("id").alias("block_number"), F.lit(0).alias("tx_index"), F.lit(0).alias("transfer_index"))
    first, last = lookup.page(df, 10).collect(), lookup.page(df, 10, 20).collect()
    assert [r["block_number"] for r in first] == list(range(24, 14, -1)) and all(r["has_more"] for r in first)
    assert len(last) == 5 and not any(r["has_more"] for r in last)
    with pytest.raises(ValueError):
        lookup.block_by(df)


def test_lookup_missing_times_pass(spark):
    rows = transfers(spark, [("t1", "A", "b", 1, None), ("t2", "a", "b", 1, 0), ("t3", "a", "b", 1, 999999)])
    got = lookup.transfers_of(rows, "a", "outgoing", end="2026-03-14 09:00:00")
    assert {r["transfer_id"] for r in got.collect()} == {"t1", "t2"}


def test_stage_root_needs_a_shared_folder(spark):
    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(_, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Cluster()

    with pytest.raises(RuntimeError):
        stage_root(Session())
    assert stage_root(spark)


def test_streaming_ingest_and_bursts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"t{n}", "hot", f"d{n}", 1, n * 30) for n in range(5)] + [("t9", "calm", "d", 1, 100)]
    transfers(spark, rows).write.parquet(source)
    transfers(spark, rows[:3]).write.mode("append").parquet(source)
    later = transfers(spark, [("z", "x", "y", 1, 90000)])
    later.write.mode("append").parquet(source)

    stream = streaming.read_transfers(spark, source, TRANSFERS)
    streaming.write_available(streaming.without_repeats(stream), out, str(tmp_path / "c1"), "chain").awaitTermination()
    assert spark.read.parquet(out).count() == 7

    alerts = str(tmp_path / "alerts")
    stream = streaming.read_transfers(spark, source, TRANSFERS)
    streaming.write_available(streaming.burst_alerts(stream), alerts, str(tmp_path / "c2")).awaitTermination()
    found = spark.read.parquet(alerts).collect()
    assert {r["source"] for r in found} == {"hot"} and max(r["transfers"] for r in found) == 8


def test_typed_records_are_parsed_once(spark):
    """A filter on parsed columns must not parse them again."""
    df = spark.createDataFrame([("x1", "ETH"), (None, "ETH")], "tx_id string, chain string")
    typed = _typed(df, RAW_RECORD).filter("tx_id is not null and chain = 'ETH'")
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["tx_id"] for r in typed.collect()] == ["x1"]


def test_records_without_nested_transfers(spark):
    """No list and an empty one give the record's own transfer, or none where both ends are missing."""
    inner = "array<struct<from_address string, to_address string, amount string>>"
    made = "tx_id string, from_address string, amount string, transfers " + inner
    rows = [("a", "f", "1.5", None), ("b", "f", "2.5", []), ("c", None, "3.5", []), ("d", "f", "4.5", [("x", "y", "7.5")])]
    found = normalize.transactions_from_records(_typed(spark.createDataFrame(rows, made), RAW_RECORD))
    assert {r["tx_hash"]: [t["amount"] for t in r["transfers"]] for r in found.collect()} == {
        "a": [Decimal("1.5")], "b": [Decimal("2.5")], "c": [], "d": [Decimal("7.5")]}


def test_nothing_new_moves_nothing(spark, tmp_path, monkeypatch):
    """Rows with new keys only, the first of each across months; a batch without new keys is not moved at all."""
    root, appended, append = str(tmp_path / "db"), [], sinks._append
    monkeypatch.setattr(sinks, "_append", lambda df, *a: (appended.append(df), append(df, *a)))
    sinks.reset_tables(spark, root)
    made = "chain string, transfer_id string, tx_hash string, ts timestamp"
    rows = spark.createDataFrame([(c, f"t{n}", x, None) for n in range(6) for c, x in (("eth", "b"), ("eth", "a"), ("btc", "c"))], made)
    rows = rows.withColumn("ts", F.expr("if(tx_hash = 'a', timestamp'2024-03-01', if(tx_hash = 'b', timestamp'2024-01-01', null))"))
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TRANSFERS])

    def stored():
        return sorted(((r["chain"], r["transfer_id"], r["tx_hash"]) for r in sinks.read_table(spark, root, "transfers").collect()), key=str)

    sinks.insert_absent(spark, root, "transfers", full.filter("transfer_id < 't3' and tx_hash <> 'a'"))
    before = stored()
    assert before == sorted([("eth", f"t{n}", "b") for n in range(3)] + [("btc", f"t{n}", "c") for n in range(3)], key=str)
    sinks.insert_absent(spark, root, "transfers", full)
    assert stored() == sorted(before + [(c, f"t{n}", x) for n in range(3, 6) for c, x in (("eth", "a"), ("btc", "c"))], key=str)
    sinks.insert_absent(spark, root, "transfers", full)
    assert len(appended) == 2 and len(stored()) == 12
    loose = full.filter("transfer_id = 't0' and tx_hash = 'c'").withColumn("transfer_id", F.lit(None).cast("string"))
    for n in (13, 14):  # a missing id is equal to none
        sinks.insert_absent(spark, root, "transfers", full.unionByName(loose).unionByName(loose))
        assert len(stored()) == n

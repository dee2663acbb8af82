"""Scalar rules: amounts, chains, times, addresses."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerhop.functions import amounts, text, times
from ledgerhop.functions.addresses import audit_addresses, keccak256_batch, rejected


def test_amounts_shift_the_point(spark):
    rows = [
        ("1000000000", 6, "1000"),
        ("1", 18, "0.000000000000000001"),
        ("145000000", 8, "1.45"),
        ("-5", 1, "-0.5"),
        ("12.5", 18, "12.5"),
        (None, 18, "0"),
        ("42", 0, "42"),
        ("1e-05", 0, "0.00001"),
    ]
    df = spark.createDataFrame([(r, d) for r, d, _ in rows], "raw string, d int")
    got = df.select(amounts.to_amount(F.col("raw"), F.col("d")).alias("a")).collect()
    assert [g["a"] for g in got] == [Decimal(w) for _, _, w in rows]


def test_amount_overflow_is_flagged_not_lost(spark):
    df = spark.createDataFrame([("9" * 60, 18), ("1", 18), (None, 18)], "raw string, d int")
    got = df.select(amounts.overflowed(F.col("raw"), F.col("d")).alias("o")).collect()
    assert [g["o"] for g in got] == [True, False, False]


@pytest.mark.parametrize(
    "amount, places, units",
    [("1000", 6, "1000000000"), ("0.123456789", 8, "12345678"), ("0", 18, "0"), ("1.5", 24, "15" + "0" * 23),
     ("-0.5", 1, "-5"), ("-0.01", 1, "0"), ("7.9", 0, "7")],
)
def test_units_round_towards_zero(spark, amount, places, units):
    value = F.lit(amount).cast("decimal(38,18)")
    assert spark.range(1).select(amounts.to_raw(value, F.lit(places)).alias("r")).first()["r"] == units


def test_amounts_do_not_depend_on_ansi_mode(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        value = F.lit("0.000000000000000001").cast("decimal(38,18)")
        assert spark.range(1).select(amounts.to_raw(value, F.lit(18)).alias("r")).first()["r"] == "1"
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_chain_and_status_words(spark):
    df = spark.createDataFrame([("BTC", "ok"), (" bsc ", "Failure"), ("sol", "queued"), ("x", None)], "c string, s string")
    got = df.select(
        text.canonical_chain(F.col("c")).alias("c"), text.transaction_status(F.col("s")).alias("s")
    ).collect()
    assert [g["c"] for g in got] == ["bitcoin", "bnb", "solana", None]
    assert [g["s"] for g in got] == ["confirmed", "failed", "pending", "unknown"]


def test_category_takes_first_matching_rule(spark):
    words = ["VASP_HOT", "Custody", "dex", "bridge", "mixer", "mining pool", "shop"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["c"] for r in df.select(text.entity_category(F.col("w")).alias("c")).collect()]
    assert got == ["VASP", "CUSTODIAN", "PROTOCOL", "BRIDGE", "PAYMENT_PROVIDER", "MINER", "UNKNOWN"]


def test_times(spark):
    rows = ["2026-03-14T08:35:10Z", "1773477310", "1773477310000", "never", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r["s"] for r in df.select(F.unix_seconds(times.parse_tron_time(F.col("t"))).alias("s")).collect()]
    assert got == [1773477310, 1773477310, 1773477310, None, None]


def test_keccak_known_values():
    empty, abc = keccak256_batch([b"", b"abc"])
    assert bytes(empty).hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert bytes(abc).hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"


# Published test vectors of the address formats.
ADDRESSES = [
    ("eth", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", True, True, "EIP-55"),
    ("eth", "0x5AAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", True, False, "HEX_MIXED_INVALID_CHECKSUM"),
    ("polygon", "0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", True, None, "HEX_RAW"),
    ("eth", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeA", False, False, None),
    ("btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True, True, "P2PKH_LEGACY"),
    ("btc", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", True, True, "P2SH_SEGWIT"),
    ("btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", False, False, None),
    ("btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True, True, "BECH32_SEGWIT"),
    ("btc", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", True, True, "BECH32M_TAPROOT"),
    ("btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False, False, None),
    ("trx", "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", True, True, "BASE58CHECK_TRON"),
    ("trx", "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6u", False, False, None),
    ("sol", "anything", None, None, None),
]


def test_address_audit(spark):
    df = spark.createDataFrame([a[:2] for a in ADDRESSES], "chain string, address string")
    got = {r["address"]: r for r in audit_addresses(df.union(df)).collect()}
    assert len(got) == len(ADDRESSES)
    for _, address, valid, checked, kind in ADDRESSES:
        row = got[address]
        assert (row["valid"], row["checksum_valid"], row["format_type"]) == (valid, checked, kind), address
    assert got[ADDRESSES[2][1]]["canonical"] == ADDRESSES[0][1]
    assert rejected(audit_addresses(df)).count() == 5


def test_raw_amounts_keep_their_digits(spark):
    from ledgerhop.functions.amounts import plain_text, raw_units, to_amount

    rows = [("9" * 45, 18), ("1234567890123456789012345", 24), ("+007", 2), ("-0", 3), ("1.5", 3), ("x", 2), (None, 2), ("000", 0)]
    raw, places = F.col("raw"), F.col("places")
    df = spark.createDataFrame(rows, "raw string, places int").select(
        "raw", raw_units(raw, to_amount(raw, places), places).alias("units"), plain_text(to_amount(raw, places)).alias("amount")
    )
    got = [r["units"] for r in df.collect()]
    assert got == ["9" * 45, "1234567890123456789012345", "7", "0", "1500", "x", "0", "0"]


def test_label_keys_follow_their_chain(spark):
    from ledgerhop.functions.text import address_key, key_chain, trace_direction
    from ledgerhop.operators import entities
    from ledgerhop.sources import files

    fields = "address string, chain string, entity_name string, entity_type string, confidence double, label_source string, file_no int, position int"
    records = [
        ("1NDyJtNTjmwk5xPNhjgAMu4HDHigtobu1s", "btc", "Binance", "VASP_DEPOSIT", 0.9, "t", 0, 0),
        ("0xRoot", "bsc", "Pool", "VASP_HOT", 0.9, "t", 0, 1),
        ("TzZ", "trx", "Tron one", "VASP_HOT", 0.9, "t", 0, 2),
    ]
    base = files.knowledge_base(spark.createDataFrame(records, fields))
    assert {(r["chain"], r["node"]) for r in base.collect()} == {
        ("bitcoin", records[0][0]), ("bnb", "0xroot"), ("tron", "TzZ")
    }
    asked = [("BTC", records[0][0]), ("btc", records[0][0].lower()), ("BNB", "0xROOT"), ("tron", "tzz"), ("tron", "TzZ")]
    found = entities.resolve_labels(spark.createDataFrame(asked, "chain string, address string"), base)
    names = {(r["chain"], r["address"]): r["entity_name"] for r in found.collect()}
    assert [names[a] for a in asked] == ["Binance", None, "Pool", None, "Tron one"]
    words = ["out", "Forward", "IN", "backward", "both", "any", "incoming"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(trace_direction(F.col("w")))
    assert [r[0] for r in df.collect()] == ["outgoing", "outgoing", "incoming", "incoming", "any", "any", "incoming"]
    with pytest.raises(Exception, match="unknown direction"):
        spark.createDataFrame([("up",)], "w string").select(trace_direction(F.col("w"))).collect()
    keys = spark.createDataFrame([("BSC", "0xA")], "c string, a string").select(key_chain(F.col("c")), address_key(F.col("c"), F.col("a")))
    assert tuple(keys.first()) == ("bnb", "0xa")


def test_same_id_on_two_chains(spark):
    from samples import labels, transfers

    from ledgerhop.plans.investigate import investigate
    from ledgerhop.sources import files

    both = transfers(spark, [("t1", "0xroot", "0xb", 5)]).union(transfers(spark, [("t1", "0xRoot", "0xc", 7)], chain="bnb"))
    cases = spark.createDataFrame(
        [("c1", "ETH", "0xRoot", "out", 2), ("c2", "bsc", "0xROOT", "forward", 2), ("c3", "ethereum", "0xb", "IN", 2),
         ("c4", "eth", "0xb", "any", 2), ("c5", "eth", "0xb", "incoming", 2)],
        "case_id string, chain string, root string, direction string, max_hops int",
    )
    known = labels(spark, [("none", "N", "VASP")])
    records = spark.createDataFrame([], "address string, chain string, entity_id string, entity_name string, name string, entity_type string, vasp_status boolean, confidence double, label_source string, source string, source_reference string, notes string, file_no int, position int")
    result = investigate(cases, both, known, files.registry(records))
    edges = {(r["case_id"], r["target"]) for r in result.graph.edges.collect()}
    assert edges == {("c1", "0xb"), ("c2", "0xc"), ("c3", "0xb"), ("c4", "0xb"), ("c5", "0xb")}

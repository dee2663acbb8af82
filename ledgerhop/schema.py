"""Declared schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 18)


_KINDS = {
    "amount": AMOUNT,
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    pairs = [part.split() for part in text.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


TRANSFERS = _struct(
    """transfer_id string, tx_hash string, chain string, from_address string, to_address string,
    asset_type string, asset_id string, asset_symbol string, token_contract string,
    token_decimals int, raw_amount string, amount amount, transfer_type string,
    transfer_index int, ts timestamp, evidence_ref string"""
)

CASES = _struct(
    """case_id string, title string, investigator string, description string, priority string,
    suspect_wallet string, chain string, created_at string, expected_vasp string,
    expected_confidence_band string, expected_breakpoint_hop int"""
)

LABELS = _struct(
    """address string, chain string, entity_id string, entity_name string, name string,
    entity_type string, vasp_status boolean, confidence double, label_source string,
    source string, source_reference string, notes string"""
)

TRUTH = _struct(
    """case_id string, suspect_wallet string, chain string, ground_truth_vasp string,
    expected_min_score double, expected_band string, expected_hops int,
    has_breakpoint boolean, expected_breakpoint_address string"""
)

# Nested raw inputs, as DDL text (Spark parses it where it is used).
# Amounts and fees stay text so that the decimals of the file are kept exactly.
RAW_RECORD = """tx_id string, tx_hash string, chain string, block_number bigint, timestamp string,
    status string, from_address string, to_address string, asset string, amount string,
    fee string, source string, raw_reference string,
    transfers array<struct<tx_id string, tx_hash string, from_address string, to_address string,
      asset string, token_symbol string, token_contract string, token_decimals int,
      amount string>>"""

RAW_UTXO = """txid string, tx_hash string, tx_id string, block_height bigint, block_number bigint,
    block_hash string, timestamp string, block_time string,
    status string, confirmed boolean, fee string, raw_reference string, confirmations int,
    from_address string, to_address string, amount string,
    vin array<struct<txid string, vout int, address string, value string, coinbase string,
      prevout struct<scriptpubkey_address string, value string>>>,
    vout array<struct<scriptpubkey_address string, address string, value string, n int>>"""

_TOKEN = """array<struct<`from` string, `to` string, from_address string, to_address string,
    contract_address string, token_contract string, symbol string, token_symbol string,
    decimals int, token_decimals int, amount string, value string>>"""

RAW_ACCOUNT = f"""hash string, tx_hash string, tx_id string, chain string, blockNumber bigint,
    block_number bigint, blockHash string, block_hash string, timestamp string, block_time string,
    `from` string, `to` string, from_address string, to_address string, value string,
    amount string, fee string, gasUsed string, gasPrice string, input string, status string,
    raw_reference string, confirmations int,
    token_transfers {_TOKEN}, tokenTransfers {_TOKEN}"""

RAW_TRON = f"""txID string, hash string, tx_id string, blockNumber bigint, block_number bigint,
    block_hash string, timestamp string, block_time string, raw_data struct<timestamp string>,
    owner_address string, from_address string, `from` string, to_address string, `to` string,
    amount string, value string, fee string, status string, raw_reference string,
    confirmations int, trc20_transfers {_TOKEN}, token_transfers {_TOKEN}"""

EXPLORER_TRANSFER = """Block struct<Hash string, Number string, Time string>, Call struct<Index int>,
    Log struct<Index int>, Transaction struct<Cost string, `From` string, Hash string,
      Index int, `To` string>,
    Transfer struct<Amount string, Id string, Index int, Receiver string, Sender string,
      Success boolean, Type string,
      Currency struct<Decimals int, Fungible boolean, Name string, Native boolean,
        ProtocolName string, SmartContract string, Symbol string>>"""

EXPLORER_TRANSACTION = """Block struct<Hash string, Number string, Time string>,
    Fee struct<Burnt string, EffectiveGasPrice string, SenderFee string>,
    Receipt struct<ContractAddress string, CumulativeGasUsed string, GasUsed string, Status string>,
    Transaction struct<Cost string, `From` string, Gas string, GasPrice string, Hash string,
      Index string, `To` string, Type int, Value string>,
    TransactionStatus struct<EndError string, Success boolean>"""


def envelope(transfers: bool) -> str:
    """Payload envelope ``data.EVM.Transfers`` / ``data.EVM.Transactions``."""
    name, item = ("Transfers", EXPLORER_TRANSFER) if transfers else ("Transactions", EXPLORER_TRANSACTION)
    return f"data struct<EVM struct<{name} array<struct<{item}>>>>"


AUDIT_LOG = _struct(
    """case_id string, actor string, action string, detail string, created_at timestamp,
    event_hash string"""
)
ATTRIBUTIONS = _struct(
    """case_id string, entity_name string, rank int, confidence_score double,
    confidence_band string, terminal_address string"""
)
RISK_EVENTS = _struct(
    """case_id string, typology_code string, severity string, affected_address string,
    confidence double"""
)
SNAPSHOTS = _struct("case_id string, digest string, records bigint, created_at timestamp")
TRANSACTIONS = _struct(
    """tx_hash string, chain string, block_number bigint, ts timestamp, status string,
    transaction_type string, fee amount, fee_asset string"""
)

# Persisted tables: schema and the columns that identify a row.
TABLES = {
    "cases": (CASES, ["case_id"]),
    "entity_labels": (LABELS, ["address", "chain"]),
    "transactions": (TRANSACTIONS, ["chain", "tx_hash"]),
    "transfers": (TRANSFERS, ["chain", "transfer_id"]),
    "attributions": (ATTRIBUTIONS, ["case_id", "entity_name"]),
    "risk_events": (RISK_EVENTS, ["case_id", "typology_code", "affected_address"]),
    "snapshots": (SNAPSHOTS, ["case_id", "digest"]),
    "audit_log": (AUDIT_LOG, ["event_hash"]),
}
# Tables kept in folders by chain and month, and in buckets of the case.
DATED_TABLES = ["transactions", "transfers"]
CASE_TABLES = ["attributions", "risk_events", "snapshots"]

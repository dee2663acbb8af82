"""Raw chain records to transactions with nested transfers.

Each raw record is one row; its nested arrays are rewritten in place with higher-order
functions and only then exploded, so normalisation needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.amounts import let, raw_units, to_amount
from ledgerhop.functions.digests import row_digest
from ledgerhop.functions.text import canonical_chain, filled, transaction_status
from ledgerhop.functions.times import parse_time, parse_tron_time
from ledgerhop.schema import AMOUNT

# Symbols that are chain coins, not tokens.
NATIVE_SYMBOLS = ["BTC", "ETH", "BNB", "MATIC", "POLYGON", "TRX"]
SMALLEST_UNIT_FEE = 1000


def _transfer(**values: Column) -> Column:
    names = [
        "transfer_id", "tx_hash", "chain", "from_address", "to_address", "asset_type",
        "asset_id", "asset_symbol", "token_contract", "token_decimals", "raw_amount",
        "amount", "transfer_type", "transfer_index", "ts", "evidence_ref",
    ]
    return F.struct(*[values[n].alias(n) for n in names])


def explode_transfers(transactions: DataFrame, *extra: str) -> DataFrame:
    """Transfers of all transactions, one row each.

    The outer form is deliberate: for the plain one the optimizer adds a filter on the
    array's size and evaluates the whole normalisation once more below it.
    """
    rows = transactions.select(*extra, F.explode_outer("transfers").alias("t"))
    return rows.filter(F.col("t").isNotNull()).select(*extra, "t.*")


def transactions_from_records(records: DataFrame) -> DataFrame:
    """Demo-style records: nested transfers, or one made from the record's own ends."""
    chain = canonical_chain(F.coalesce("chain", F.lit("ETH")), "ethereum")
    bitcoin, tron = chain == "bitcoin", chain == "tron"
    coin = F.when(bitcoin, "BTC").otherwise("ETH")
    tx = filled(F.col("tx_id"), F.col("tx_hash"))
    ts = parse_time(F.col("timestamp"))

    def nested(t: Column, i: Column) -> Column:
        own = F.coalesce(filled(t["tx_id"], t["tx_hash"]), tx)
        symbol = F.coalesce(filled(t["asset"], t["token_symbol"]), coin)
        places = F.coalesce(t["token_decimals"], F.when(bitcoin, 8).otherwise(18))
        token = t["token_contract"].isNotNull() | ~symbol.isin(NATIVE_SYMBOLS)
        raw = F.coalesce(t["amount"], F.lit("0.0"))
        return let(
            to_amount(raw, places), lambda amount: filled_in(t, i, own, symbol, places, token, amount, raw)
        )

    def filled_in(t, i, own, symbol, places, token, amount, raw) -> Column:
        return _transfer(
            transfer_id=F.concat_ws("_", own, i),
            tx_hash=own,
            chain=chain,
            from_address=F.coalesce(t["from_address"], F.lit("")),
            to_address=F.coalesce(t["to_address"], F.lit("")),
            asset_type=F.when(token & tron, "trc20").when(token, "erc20").otherwise("native"),
            asset_id=F.coalesce(filled(t["token_contract"]), symbol),
            asset_symbol=symbol,
            token_contract=t["token_contract"],
            token_decimals=places,
            raw_amount=raw_units(raw, amount, places),
            amount=amount,
            transfer_type=F.when(token, "token").otherwise("native"),
            transfer_index=i,
            ts=ts,
            evidence_ref=F.concat(F.lit("fixture://tx/"), own, F.lit("#transfer:"), i),
        )

    places = F.when(bitcoin, 8).otherwise(18)
    symbol = F.coalesce("asset", coin)
    raw = F.coalesce("amount", F.lit("0.0"))
    amount = to_amount(raw, places)
    single = _transfer(
        transfer_id=F.concat(tx, F.lit("_0")),
        tx_hash=tx,
        chain=chain,
        from_address=F.coalesce("from_address", F.lit("")),
        to_address=F.coalesce("to_address", F.lit("")),
        asset_type=F.lit("native"),
        asset_id=symbol,
        asset_symbol=symbol,
        token_contract=F.lit(None).cast("string"),
        token_decimals=F.lit(None).cast("int"),
        raw_amount=raw_units(raw, amount, places),
        amount=amount,
        transfer_type=F.lit("native"),
        transfer_index=F.lit(0),
        ts=ts,
        evidence_ref=F.concat(F.lit("fixture://tx/"), tx, F.lit("#transfer:0")),
    )
    has_ends = F.col("from_address").isNotNull() | F.col("to_address").isNotNull()
    inner = F.coalesce(F.transform("transfers", nested), F.array())
    # Of the given array, not of ``inner``: that would rewrite every transfer a second time.
    alone = F.col("transfers").isNull() | (F.size("transfers") == 0)
    transfers = F.when(alone & has_ends, F.array(single)).otherwise(inner)
    keep = [c for c in ("file_name", "case_id") if c in records.columns]
    hashed = [c for c in records.columns if c not in keep]
    return records.filter(tx.isNotNull()).select(
        *keep,
        tx.alias("tx_hash"),
        chain.alias("chain"),
        "block_number",
        ts.alias("ts"),
        transaction_status(F.coalesce("status", F.lit("CONFIRMED"))).alias("status"),
        F.when(bitcoin, "utxo_transaction").otherwise("native_transfer").alias("transaction_type"),
        F.coalesce("fee", F.lit("0.0")).try_cast(AMOUNT).alias("fee"),
        F.coalesce("asset", F.lit("ETH")).alias("fee_asset"),
        transfers.alias("transfers"),
        F.coalesce(filled(F.col("raw_reference")), F.concat(F.lit("fixture://case/"), tx)).alias(
            "raw_reference"
        ),
        row_digest(hashed).alias("raw_payload_hash"),
    )


def _unit_fee(fee: Column, places: int) -> Column:
    """Whole numbers above 1000 are smallest units, everything else is the coin amount."""
    text = F.trim(F.coalesce(fee, F.lit("0")))
    units = text.rlike(r"^\d+$") & (text.try_cast("decimal(38,0)") > SMALLEST_UNIT_FEE)
    return F.when(units, to_amount(text, F.lit(places))).otherwise(text.try_cast(AMOUNT))


def _first_filled(*columns: Column) -> Column:
    """First value that is present, not empty and not zero text."""
    return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in columns])


def normalize_utxo(raw: DataFrame, provider: str = "PROVIDER") -> DataFrame:
    """Inputs, outputs and one transfer per output, sent by the first known input address."""
    tx = F.coalesce(filled(F.col("txid"), F.col("tx_hash"), F.col("tx_id")), F.lit(""))
    ts = parse_time(F.coalesce(filled(F.col("timestamp")), F.col("block_time")))
    places = F.lit(8)

    def as_input(i: Column) -> Column:
        value = _first_filled(i["prevout"]["value"], i["value"])
        return let(
            F.when(value.isNotNull(), to_amount(value, places)),
            lambda amount: F.struct(
                i["txid"].alias("tx_hash"),
                i["vout"].alias("output_index"),
                filled(i["prevout"]["scriptpubkey_address"], i["address"]).alias("address"),
                F.when(value.isNotNull(), raw_units(value, amount, places)).alias("raw_amount"),
                amount.alias("amount"),
                i["coinbase"].alias("coinbase"),
            ),
        )

    def as_output(o: Column, n: Column) -> Column:
        value = F.coalesce(_first_filled(o["value"]), F.lit("0"))
        return let(
            to_amount(value, places),
            lambda amount: F.struct(
                F.coalesce(o["n"], n).alias("output_index"),
                F.coalesce(filled(o["scriptpubkey_address"], o["address"]), F.lit("")).alias("address"),
                raw_units(value, amount, places).alias("raw_amount"),
                amount.alias("amount"),
            ),
        )

    direct_text = F.coalesce("amount", F.lit("0"))
    direct = to_amount(direct_text, places)
    listed_in = F.coalesce(F.transform("vin", as_input), F.array())
    listed_out = F.coalesce(F.transform("vout", as_output), F.array())
    nothing = F.lit(None).cast("string")
    single_in = F.struct(
        nothing.alias("tx_hash"),
        F.lit(None).cast("int").alias("output_index"),
        F.col("from_address").alias("address"),
        raw_units(direct_text, direct, places).alias("raw_amount"),
        direct.alias("amount"),
        nothing.alias("coinbase"),
    )
    single_out = F.struct(
        F.lit(0).alias("output_index"),
        F.col("to_address").alias("address"),
        raw_units(direct_text, direct, places).alias("raw_amount"),
        direct.alias("amount"),
    )
    inputs = F.when(
        (F.size(listed_in) == 0) & F.col("from_address").isNotNull(), F.array(single_in)
    ).otherwise(listed_in)
    outputs = F.when(
        (F.size(listed_out) == 0) & F.col("to_address").isNotNull(), F.array(single_out)
    ).otherwise(listed_out)
    staged = raw.select("*", inputs.alias("inputs"), outputs.alias("outputs"), tx.alias("_tx"), ts.alias("_ts"))
    known = F.filter("inputs", lambda i: i["address"].isNotNull())
    sender = F.coalesce(F.get(known, F.lit(0))["address"], F.lit("COINBASE"))

    def as_transfer(o: Column, n: Column) -> Column:
        return _transfer(
            transfer_id=F.concat_ws("_", "_tx", n),
            tx_hash=F.col("_tx"),
            chain=F.lit("bitcoin"),
            from_address=F.col("_sender"),
            to_address=o["address"],
            asset_type=F.lit("native"),
            asset_id=F.lit("BTC"),
            asset_symbol=F.lit("BTC"),
            token_contract=nothing,
            token_decimals=places,
            raw_amount=o["raw_amount"],
            amount=o["amount"],
            transfer_type=F.lit("utxo_output"),
            transfer_index=n,
            ts=F.col("_ts"),
            evidence_ref=F.concat(F.lit("tx:"), F.col("_tx"), F.lit("#out:"), n),
        )

    status = F.when(F.col("confirmed"), "confirmed").when(~F.col("confirmed"), "pending").when(
        F.col("status").isNull(), "confirmed"
    ).otherwise(transaction_status(F.col("status")))
    return staged.withColumn("_sender", sender).select(
        F.col("_tx").alias("tx_hash"),
        F.lit("bitcoin").alias("chain"),
        F.coalesce("block_height", "block_number").alias("block_number"),
        "block_hash",
        F.col("_ts").alias("ts"),
        status.alias("status"),
        F.lit("utxo_transaction").alias("transaction_type"),
        _unit_fee(F.col("fee"), 8).alias("fee"),
        F.lit("BTC").alias("fee_asset"),
        "inputs",
        "outputs",
        F.transform("outputs", as_transfer).alias("transfers"),
        F.lit(provider).alias("provider"),
        row_digest(raw.columns).alias("raw_payload_hash"),
    )


def _token_transfers(
    tokens: Column,
    tx: Column,
    ts: Column,
    chain: Column,
    ends: tuple[Column, Column],
    symbol: str,
    places: int,
    asset_type: Column,
    tag: str,
    shift: Column,
) -> Column:
    def one(t: Column, n: Column) -> Column:
        index = (n + shift).cast("int")
        contract = filled(t["contract_address"], t["token_contract"])
        sym = F.coalesce(filled(t["symbol"], t["token_symbol"]), F.lit(symbol))
        # Zero decimals count as missing.
        digits = F.coalesce(
            F.nullif(t["decimals"], F.lit(0)), F.nullif(t["token_decimals"], F.lit(0)), F.lit(places)
        )
        raw = F.coalesce(_first_filled(t["amount"], t["value"]), F.lit("0"))
        return let(to_amount(raw, digits), lambda amount: token(t, index, contract, sym, digits, amount, raw))

    def token(t, index, contract, sym, digits, amount, raw) -> Column:
        return _transfer(
            transfer_id=F.concat_ws("_", tx, index),
            tx_hash=tx,
            chain=chain,
            from_address=F.coalesce(filled(t["from"]), t["from_address"], ends[0]),
            to_address=F.coalesce(filled(t["to"]), t["to_address"], ends[1]),
            asset_type=asset_type,
            asset_id=F.coalesce(contract, sym),
            asset_symbol=sym,
            token_contract=contract,
            token_decimals=digits,
            raw_amount=raw_units(raw, amount, digits),
            amount=amount,
            transfer_type=F.lit("token"),
            transfer_index=index,
            ts=ts,
            evidence_ref=F.concat(F.lit("tx:"), tx, F.lit(f"#{tag}:"), index),
        )

    return F.transform(tokens, one)


def _native_transfer(
    tx: Column, ts: Column, chain: Column, ends: tuple[Column, Column], coin: Column, places: int, amount: Column, raw: Column, tag: str
) -> Column:
    return _transfer(
        transfer_id=F.concat(tx, F.lit("_0")),
        tx_hash=tx,
        chain=chain,
        from_address=ends[0],
        to_address=ends[1],
        asset_type=F.lit("native"),
        asset_id=coin,
        asset_symbol=coin,
        token_contract=F.lit(None).cast("string"),
        token_decimals=F.lit(places),
        raw_amount=raw_units(raw, amount, F.lit(places)),
        amount=amount,
        transfer_type=F.lit("native"),
        transfer_index=F.lit(0),
        ts=ts,
        evidence_ref=F.concat(F.lit("tx:"), tx, F.lit(f"#{tag}")),
    )


def gas_fee(used: Column, price: Column) -> Column:
    """Gas used times price in coin units; the product stays a whole-number decimal."""
    wei = used.try_cast("decimal(18,0)") * price.try_cast("decimal(19,0)")
    return to_amount(wei.cast("string"), F.lit(18))


def normalize_account(raw: DataFrame, provider: str = "PROVIDER") -> DataFrame:
    """Account chains: native transfer first (index 0), then token transfers.

    Token numbers start at 1 behind a native transfer, so the two never share an id.
    """
    chain = canonical_chain(F.coalesce("chain", F.lit("ethereum")), "ethereum")
    coin = F.when(chain == "bnb", "BNB").when(chain == "polygon", "MATIC").otherwise("ETH")
    tx = F.coalesce(filled(F.col("hash"), F.col("tx_hash"), F.col("tx_id")), F.lit(""))
    ts = parse_time(F.coalesce(filled(F.col("timestamp")), F.col("block_time")))
    ends = (
        F.coalesce(filled(F.col("from")), F.col("from_address"), F.lit("")),
        F.coalesce(filled(F.col("to")), F.col("to_address"), F.lit("")),
    )
    listed = F.coalesce(
        F.when(F.size("token_transfers") > 0, F.col("token_transfers")), F.col("tokenTransfers"), F.array()
    )
    value_text = F.coalesce(_first_filled(F.col("value")), F.col("amount"), F.lit("0"))
    value = to_amount(value_text, F.lit(18))
    staged = raw.select(
        "*",
        chain.alias("_chain"),
        coin.alias("_coin"),
        tx.alias("_tx"),
        ts.alias("_ts"),
        ends[0].alias("_from"),
        ends[1].alias("_to"),
        listed.alias("_tokens"),
        value.alias("_value"),
        value_text.alias("_value_text"),
    )
    some = F.size("_tokens") > 0
    # A number too large for an amount is still a transfer.
    native = F.coalesce(F.col("_value") > 0, F.trim("_value_text").rlike(r"^\d+$")) | ~some
    sides = (F.col("_from"), F.col("_to"))
    tokens = _token_transfers(
        F.col("_tokens"), F.col("_tx"), F.col("_ts"), F.col("_chain"), sides, "TOKEN", 18,
        F.when(F.col("_chain") == "bnb", "bep20").otherwise("erc20"), "log",
        F.when(native, 1).otherwise(0),
    )
    first = _native_transfer(
        F.col("_tx"), F.col("_ts"), F.col("_chain"), sides, F.col("_coin"), 18, F.col("_value"), F.col("_value_text"), "call"
    )
    kind = (
        F.when(some & (F.col("_value") > 0), "mixed")
        .when(some, "token_transfer")
        .when(filled(F.col("input")).isNotNull() & (F.col("input") != "0x"), "contract_call")
        .otherwise("native_transfer")
    )
    fee = (
        F.when(F.col("fee").isNotNull(), to_amount(F.col("fee"), F.lit(18)))
        .when(F.col("gasUsed").isNotNull() & F.col("gasPrice").isNotNull(), gas_fee(F.col("gasUsed"), F.col("gasPrice")))
        .otherwise(F.lit(0).cast(AMOUNT))
    )
    status = F.when(F.col("status").isNull() | (F.col("status") == "0x1"), "confirmed").otherwise(
        transaction_status(F.col("status"))
    )
    return staged.select(
        F.col("_tx").alias("tx_hash"),
        F.col("_chain").alias("chain"),
        F.coalesce("blockNumber", "block_number").alias("block_number"),
        F.coalesce(filled(F.col("blockHash")), F.col("block_hash")).alias("block_hash"),
        F.col("_ts").alias("ts"),
        status.alias("status"),
        kind.alias("transaction_type"),
        fee.alias("fee"),
        F.col("_coin").alias("fee_asset"),
        F.when(native, F.concat(F.array(first), tokens)).otherwise(tokens).alias("transfers"),
        F.lit(provider).alias("provider"),
        row_digest(raw.columns).alias("raw_payload_hash"),
    )


def normalize_tron(raw: DataFrame, provider: str = "PROVIDER") -> DataFrame:
    """TRON: token transfers (USDT with 6 decimals unless stated) and the native coin."""
    tx = F.coalesce(filled(F.col("txID"), F.col("hash"), F.col("tx_id")), F.lit(""))
    ts = parse_tron_time(
        F.coalesce(_first_filled(F.col("raw_data.timestamp")), filled(F.col("timestamp")), F.col("block_time"))
    )
    listed = F.coalesce(
        F.when(F.size("trc20_transfers") > 0, F.col("trc20_transfers")), F.col("token_transfers"), F.array()
    )
    value_text = F.coalesce(_first_filled(F.col("amount")), F.col("value"), F.lit("0"))
    value = to_amount(value_text, F.lit(6))
    staged = raw.select(
        "*",
        tx.alias("_tx"),
        ts.alias("_ts"),
        F.coalesce(filled(F.col("owner_address"), F.col("from_address")), F.col("from"), F.lit("")).alias("_from"),
        F.coalesce(filled(F.col("to_address")), F.col("to"), F.lit("")).alias("_to"),
        listed.alias("_tokens"),
        value.alias("_value"),
        value_text.alias("_value_text"),
    )
    some = F.size("_tokens") > 0
    # A number too large for an amount is still a transfer.
    native = F.coalesce(F.col("_value") > 0, F.trim("_value_text").rlike(r"^\d+$")) | ~some
    sides, chain = (F.col("_from"), F.col("_to")), F.lit("tron")
    tokens = _token_transfers(
        F.col("_tokens"), F.col("_tx"), F.col("_ts"), chain, sides, "USDT", 6, F.lit("trc20"),
        "trc20", F.when(native, 1).otherwise(0),
    )
    first = _native_transfer(
        F.col("_tx"), F.col("_ts"), chain, sides, F.lit("TRX"), 6, F.col("_value"), F.col("_value_text"), "trx"
    )
    return staged.select(
        F.col("_tx").alias("tx_hash"),
        chain.alias("chain"),
        F.coalesce("blockNumber", "block_number").alias("block_number"),
        "block_hash",
        F.col("_ts").alias("ts"),
        F.when(F.col("status").isNull(), "confirmed").otherwise(transaction_status(F.col("status"))).alias("status"),
        F.when(some, "token_transfer").otherwise("native_transfer").alias("transaction_type"),
        _unit_fee(F.col("fee"), 6).alias("fee"),
        F.lit("TRX").alias("fee_asset"),
        F.when(native, F.concat(F.array(first), tokens)).otherwise(tokens).alias("transfers"),
        F.lit(provider).alias("provider"),
        row_digest(raw.columns).alias("raw_payload_hash"),
    )


COMMON = [
    "tx_hash", "chain", "block_number", "block_hash", "ts", "status", "transaction_type", "fee",
    "fee_asset", "transfers", "provider", "raw_payload_hash",
]


def normalize_all(
    utxo: DataFrame | None = None, account: DataFrame | None = None, tron: DataFrame | None = None
) -> DataFrame:
    """Normalised transactions of all chains; account records of unknown chains are Ethereum."""
    parts = []
    if utxo is not None:
        parts.append(normalize_utxo(utxo))
    if account is not None:
        parts.append(normalize_account(account))
    if tron is not None:
        parts.append(normalize_tron(tron))
    return reduce(DataFrame.unionByName, [p.select(*COMMON) for p in parts])


def dispatch_by_chain(records: DataFrame) -> DataFrame:
    """Normalise a mixed table ``(chain, utxo, account, tron)`` of nested raw records.

    One filter per chain family on the canonical chain; the union reads the table once
    per family and prunes the other families' columns.
    """
    chain = canonical_chain(F.col("chain"), "ethereum")
    known = records.withColumn("_chain", chain)
    account = known.filter(~F.col("_chain").isin("bitcoin", "tron")).select("_chain", "account.*")
    return normalize_all(
        known.filter(F.col("_chain") == "bitcoin").select("utxo.*"),
        account.withColumn("chain", F.col("_chain")).drop("_chain"),
        known.filter(F.col("_chain") == "tron").select("tron.*"),
    )


def _reader(rows: DataFrame) -> Callable[..., Column]:
    """Text of the first present, non-NULL column among several accepted names."""
    have = set(rows.columns)

    def col(*names: str) -> Column:
        present = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return col


def _default_id(col: Callable[..., Column], *names: str) -> Column:
    index = F.coalesce(col("transfer_index"), F.lit("0"))
    tx = F.coalesce(filled(col("tx_hash", "tx_id")), F.lit("tx"))
    return F.coalesce(col(*names), F.concat_ws("_", tx, index))


def default_transfer_fields(rows: DataFrame) -> DataFrame:
    """Fill the fields of loosely named transfer rows."""
    col = _reader(rows)
    symbol = F.coalesce(col("asset_symbol", "asset"), filled(col("token_symbol")), F.lit("ETH"))
    contract = filled(col("token_contract"))
    zero = F.lit("0")
    return rows.select(
        _default_id(col, "transfer_id").alias("transfer_id"),
        col("tx_hash", "tx_id").alias("tx_hash"),
        canonical_chain(F.coalesce(col("chain"), F.lit("ethereum")), "ethereum").alias("chain"),
        col("from_address").alias("from_address"),
        col("to_address").alias("to_address"),
        F.coalesce(col("asset_type"), F.when(contract.isNotNull(), "erc20"), F.lit("native")).alias("asset_type"),
        F.coalesce(col("asset_id"), contract, symbol).alias("asset_id"),
        symbol.alias("asset_symbol"),
        col("token_contract").alias("token_contract"),
        F.coalesce(col("raw_amount", "normalized_amount", "amount"), zero).alias("raw_amount"),
        F.coalesce(col("normalized_amount", "amount", "raw_amount"), zero).try_cast(AMOUNT).alias("amount"),
        F.coalesce(col("transfer_index").cast("int"), F.lit(0)).alias("transfer_index"),
    )


def default_transaction_fields(rows: DataFrame) -> DataFrame:
    """Fill hash, provider, chain, time and fee of loosely named transaction rows."""
    col = _reader(rows)
    return rows.select(
        col("tx_hash", "tx_id").alias("tx_hash"),
        canonical_chain(F.coalesce(col("chain"), F.lit("ethereum")), "ethereum").alias("chain"),
        F.coalesce(col("provider", "source"), F.lit("FIXTURE")).alias("provider"),
        parse_time(col("timestamp")).alias("ts"),
        col("fee").try_cast(AMOUNT).alias("fee"),
    )


def default_edge_fields(rows: DataFrame) -> DataFrame:
    """Fill id, asset and amount of loosely named edge rows."""
    col = _reader(rows)
    symbol = F.coalesce(col("asset_symbol", "asset"), F.lit("ETH"))
    return rows.select(
        _default_id(col, "transfer_id", "id").alias("transfer_id"),
        _default_id(col, "id", "transfer_id").alias("edge_key"),
        col("tx_hash", "tx_id").alias("tx_hash"),
        col("source").alias("source"),
        col("target").alias("target"),
        F.coalesce(col("asset_id"), symbol).alias("asset_id"),
        symbol.alias("asset_symbol"),
        col("amount").try_cast(AMOUNT).alias("amount"),
    )


def transaction_view(transactions: DataFrame) -> DataFrame:
    """Sender, recipient, main asset and total amount of each transaction."""
    first = F.get("transfers", F.lit(0))
    has_io = {"inputs", "outputs"} <= set(transactions.columns)
    sender, recipient = first["from_address"], first["to_address"]
    if has_io:
        sender = F.coalesce(sender, F.get("inputs", F.lit(0))["address"])
        recipient = F.coalesce(recipient, F.get("outputs", F.lit(0))["address"])
    total = F.aggregate("transfers", F.lit(0).cast(AMOUNT), lambda a, t: (a + t["amount"]).cast(AMOUNT))
    return transactions.select(
        "tx_hash",
        F.coalesce(sender, F.lit("")).alias("from_address"),
        F.coalesce(recipient, F.lit("")).alias("to_address"),
        F.coalesce(first["asset_symbol"], F.col("fee_asset"), F.lit("ETH")).alias("asset"),
        total.alias("amount"),
    )


def value_mismatches(transactions: DataFrame) -> DataFrame:
    """UTXO transactions whose inputs differ from outputs plus fee; coinbase has no inputs."""
    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast(AMOUNT), lambda a, x: (a + F.coalesce(x["amount"], F.lit(0).cast(AMOUNT))).cast(AMOUNT))

    checked = transactions.select(
        "tx_hash",
        total("inputs").alias("inputs_total"),
        total("outputs").alias("outputs_total"),
        F.coalesce("fee", F.lit(0).cast(AMOUNT)).alias("fee"),
    )
    return checked.withColumn(
        "difference", F.col("inputs_total") - F.col("outputs_total") - F.col("fee")
    ).filter(F.col("difference") != 0)


# Fixed value: topic of the ERC-20 event Transfer(address,address,uint256).
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def decode_transfer_logs(logs: DataFrame) -> DataFrame:
    """``logs(tx_hash, log_index, contract, decimals, topics array<string>, data string)`` to transfers.

    Addresses are the last 40 digits of their padded topics.  The amount is a sum over
    16-digit limbs in decimal(38,0).  Values beyond 38 digits have no amount: ``raw_amount``
    then keeps the hexadecimal text, and ``amount_overflow`` is true wherever an amount is missing.
    """
    digits = F.regexp_replace(F.lower("data"), "^0x", "")
    padded = F.lpad(digits, 64, "0")
    base = F.lit("18446744073709551616").cast("decimal(20,0)")

    def limb(start: int) -> Column:
        return F.conv(padded.substr(start, 16), 16, 10).cast("decimal(20,0)")

    low = F.try_add(F.try_multiply(limb(33), base), limb(49))
    small = F.substring(padded, 1, 32) == F.repeat(F.lit("0"), 32)
    units = F.when(small, low.try_cast("decimal(38,0)"))
    return logs.filter(
        (F.lower(F.get("topics", F.lit(0))) == TRANSFER_TOPIC) & (F.size("topics") >= 3)
    ).select(
        "tx_hash",
        "log_index",
        F.col("contract").alias("token_contract"),
        F.concat(F.lit("0x"), F.lower(F.right(F.get("topics", F.lit(1)), F.lit(40)))).alias("from_address"),
        F.concat(F.lit("0x"), F.lower(F.right(F.get("topics", F.lit(2)), F.lit(40)))).alias("to_address"),
        F.coalesce(units.cast("string"), F.concat(F.lit("0x"), digits)).alias("raw_amount"),
        F.when(units.isNotNull(), to_amount(units.cast("string"), F.col("decimals"))).alias("amount"),
    ).withColumn("amount_overflow", F.col("amount").isNull())

"""Explorer payload items (``EVM.Transfers`` / ``EVM.Transactions``) to the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.functions.amounts import to_amount, to_raw
from ledgerhop.functions.digests import row_digest
from ledgerhop.functions.text import filled
from ledgerhop.functions.times import parse_time
from ledgerhop.operators.normalize import gas_fee
from ledgerhop.operators.ordering import first_rows, row_numbers
from ledgerhop.schema import AMOUNT


def _location() -> Column:
    """Where a transfer sits in its transaction: log, call, own id, else type and index."""
    kind = F.coalesce(filled(F.lower("Transfer.Type")), F.lit("t"))
    own = F.trim(F.col("Transfer.Id"))
    return F.coalesce(
        F.concat(F.lit("log_"), F.col("Log.Index")),
        F.concat(F.lit("call_"), F.col("Call.Index")),
        F.when(~own.isin("", "None", "0"), F.col("Transfer.Id")),
        F.concat_ws("_", kind, F.coalesce(F.col("Transfer.Index"), F.lit(0))),
    )


def number_occurrences(items: DataFrame) -> DataFrame:
    """Add ``loc_key`` and ``occurrence``: 0, 1, ... per (transaction, location) in payload order."""
    keyed = items.withColumn("tx_key", F.lower(F.coalesce("Transaction.Hash", F.lit("")))).withColumn(
        "loc_key", _location()
    )
    numbered = row_numbers(keyed, ["tx_key", "loc_key"], ["payload", "position"], "occurrence")
    return numbered.withColumn("occurrence", F.col("occurrence") - 1)


def map_transfers(items: DataFrame) -> DataFrame:
    """Canonical transfers with ids that stay distinct when a location repeats."""
    money = F.col("Transfer.Currency")
    contract = filled(money["SmartContract"])
    native = F.coalesce(money["Native"], F.lit(False)) | F.coalesce(
        money["Symbol"] == "ETH", F.lit(False)
    ) | contract.isNull()
    kind = F.lower(F.coalesce("Transfer.Type", F.lit("")))
    places = F.coalesce(F.nullif(money["Decimals"], F.lit(0)), F.lit(18))
    amount = F.coalesce(
        filled(F.trim(F.col("Transfer.Amount"))).try_cast(AMOUNT), F.lit(0).cast(AMOUNT)
    )
    tx = F.coalesce(filled(F.col("Transaction.Hash")), F.lit(""))
    suffix = F.when(
        F.col("occurrence") > 0, F.concat_ws("_", "loc_key", F.col("occurrence").cast("string"))
    ).otherwise(F.col("loc_key"))
    index = F.coalesce("Log.Index", "Call.Index", "Transfer.Index", F.col("occurrence").cast("int"))
    return number_occurrences(items).select(
        F.concat(F.lit("ethereum:"), tx, F.lit(":"), suffix).alias("transfer_id"),
        tx.alias("tx_hash"),
        F.lit("ethereum").alias("chain"),
        F.coalesce(filled(F.col("Transfer.Sender")), F.col("Transaction.From"), F.lit("")).alias("from_address"),
        F.coalesce(filled(F.col("Transfer.Receiver")), F.col("Transaction.To"), F.lit("")).alias("to_address"),
        F.when(native, "native").otherwise("erc20").alias("asset_type"),
        F.when(native, "ETH").otherwise(F.concat(F.lit("ethereum:"), F.lower(contract))).alias("asset_id"),
        F.coalesce(filled(money["Symbol"]), F.when(native, "ETH").otherwise("TOKEN")).alias("asset_symbol"),
        F.when(~native, contract).alias("token_contract"),
        places.alias("token_decimals"),
        to_raw(amount, places).alias("raw_amount"),
        amount.alias("amount"),
        F.when(native & kind.isin("call", "internal"), "internal")
        .when(native, "native")
        .otherwise("token")
        .alias("transfer_type"),
        index.alias("transfer_index"),
        parse_time(F.col("Block.Time")).alias("ts"),
        F.concat(F.lit("explorer://evm/eth/tx/"), tx, F.lit("#transfer:"), suffix).alias("evidence_ref"),
        F.col("Block.Number").try_cast("bigint").alias("block_number"),
    )


def _coin(text: Column) -> Column:
    return to_amount(text, F.lit(18))


def map_transactions(items: DataFrame, transfers: DataFrame) -> DataFrame:
    """Transactions with status, fee, type, and the native transfer they imply.

    The attached transfers are only needed as three aggregates per transaction, so they
    are never collected.  ``implied_native`` says that :func:`implied_transfers` adds one.
    """
    tx = F.coalesce(filled(F.col("Transaction.Hash")), F.lit(""))
    ok = ~(
        F.coalesce(F.col("TransactionStatus.Success") == F.lit(False), F.lit(False))
        | F.coalesce(F.trim("Receipt.Status") == "0", F.lit(False))
    )
    fee = (
        F.when(F.col("Transaction.Cost").isNotNull(), _coin(F.col("Transaction.Cost")))
        .when(
            F.col("Receipt.GasUsed").isNotNull() & F.col("Fee.EffectiveGasPrice").isNotNull(),
            gas_fee(F.col("Receipt.GasUsed"), F.col("Fee.EffectiveGasPrice")),
        )
        .otherwise(F.lit(0).cast(AMOUNT))
    )
    value_text = F.col("Transaction.Value")
    value = F.when(value_text.isNotNull() & (value_text != "0") & ok, _coin(value_text))
    base = items.select(
        tx.alias("tx_hash"),
        F.lower(tx).alias("_tx"),
        F.lit("ethereum").alias("chain"),
        F.col("Block.Number").try_cast("bigint").alias("block_number"),
        F.col("Block.Hash").alias("block_hash"),
        parse_time(F.col("Block.Time")).alias("ts"),
        F.when(ok, "confirmed").otherwise("failed").alias("status"),
        fee.alias("fee"),
        F.lit("ETH").alias("fee_asset"),
        F.coalesce("Transaction.From", F.lit("")).alias("sender"),
        F.coalesce("Transaction.To", F.lit("")).alias("recipient"),
        F.coalesce(value, F.lit(0).cast(AMOUNT)).alias("value"),
        (
            filled(F.col("Receipt.ContractAddress")).isNotNull()
            | (filled(F.col("Transaction.To")).isNotNull() & (F.coalesce(value_text, F.lit("0")) == "0"))
        ).alias("_calls"),
        row_digest([c for c in items.columns if c not in ("payload", "position")]).alias("raw_payload_hash"),
    )
    senders = base.select("_tx", "sender").distinct()
    attached = (
        transfers.select(F.lower("tx_hash").alias("_tx"), "asset_type", "amount", "from_address")
        .join(senders, "_tx")
        .groupBy("_tx")
        .agg(
            F.count_if(F.col("asset_type") == "erc20").alias("_tokens"),
            F.count_if((F.col("asset_type") == "native") & (F.col("amount") > 0)).alias("_natives"),
            F.bool_or((F.col("asset_type") == "native") & (F.col("from_address") == F.col("sender"))).alias("_own"),
        )
    )
    joined = base.join(attached, "_tx", "left")
    implied = (F.col("value") > 0) & ~F.coalesce("_own", F.lit(False))
    tokens = F.coalesce("_tokens", F.lit(0)) > 0
    natives = (F.coalesce("_natives", F.lit(0)) > 0) | implied
    kind = (
        F.when(tokens & natives, "mixed")
        .when(tokens, "token_transfer")
        .when(natives, "native_transfer")
        .when(F.col("_calls"), "contract_call")
        .otherwise("unknown")
    )
    return joined.select(
        *[c for c in base.columns if not c.startswith("_")],
        kind.alias("transaction_type"),
        implied.alias("implied_native"),
    )


def implied_transfers(transactions: DataFrame) -> DataFrame:
    """Native transfers of transactions that moved value without an attached one."""
    return transactions.filter("implied_native").select(
        F.concat(F.lit("ethereum:"), F.col("tx_hash"), F.lit(":0")).alias("transfer_id"),
        "tx_hash",
        "chain",
        F.col("sender").alias("from_address"),
        F.col("recipient").alias("to_address"),
        F.lit("native").alias("asset_type"),
        F.lit("ETH").alias("asset_id"),
        F.lit("ETH").alias("asset_symbol"),
        F.lit(None).cast("string").alias("token_contract"),
        F.lit(18).alias("token_decimals"),
        to_raw(F.col("value"), F.lit(18)).alias("raw_amount"),
        F.col("value").alias("amount"),
        F.lit("native").alias("transfer_type"),
        F.lit(0).alias("transfer_index"),
        "ts",
        F.concat(F.lit("explorer://evm/eth/tx/"), F.col("tx_hash"), F.lit("#native")).alias("evidence_ref"),
        "block_number",
    )


def asset_dimension(items: DataFrame) -> DataFrame:
    """Latest symbol, name and decimals per token contract."""
    money = F.col("Transfer.Currency")
    contract = filled(money["SmartContract"])
    rows = items.filter(contract.isNotNull()).select(
        F.concat(F.lit("ethereum:"), F.lower(contract)).alias("asset_id"),
        parse_time(F.col("Block.Time")).alias("ts"),
        F.coalesce(filled(money["Symbol"]), F.lit("TOKEN")).alias("symbol"),
        F.coalesce(
            filled(money["Name"]),
            F.concat(F.coalesce(filled(money["Symbol"]), F.lit("TOKEN")), F.lit(" Token")),
        ).alias("name"),
        F.coalesce(F.nullif(money["Decimals"], F.lit(0)), F.lit(18)).alias("decimals"),
        contract.alias("token_contract"),
    )
    latest = F.max_by(
        F.struct("symbol", "name", "decimals", "token_contract"), F.struct("ts", "symbol", "name")
    )
    return rows.groupBy("asset_id").agg(latest.alias("a")).select("asset_id", "a.*")


def block_dimension(items: DataFrame) -> DataFrame:
    """One row per block number: hash and time."""
    rows = items.select(
        F.lit("ethereum").alias("chain"),
        F.col("Block.Number").try_cast("bigint").alias("block_number"),
        F.col("Block.Hash").alias("block_hash"),
        parse_time(F.col("Block.Time")).alias("ts"),
    ).filter(F.col("block_number").isNotNull())
    return first_rows(rows, ["chain", "block_number"], ["ts", "block_hash"])

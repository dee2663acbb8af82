"""Scans, lookups, ordering and pages over transfers, transactions and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.functions.text import address_key, filled, key_chain
from ledgerhop.operators.ordering import first_rows, running_sum, top_rows
from ledgerhop.operators.skew import salt_hot_keys
from ledgerhop.operators.trace import forward_closure
from ledgerhop.staging import stage, stage_path

NATIVE_WORDS = ["eth", "ether", "native"]


def touches(address: str, direction: str = "any") -> Column:
    """Transfer condition for one address, ignoring case."""
    key = F.lit(address.lower())
    sent, received = F.lower("from_address") == key, F.lower("to_address") == key
    return {"outgoing": sent, "incoming": received}.get(direction, sent | received)


def in_period(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive time range; rows without a time pass."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        condition = condition & (ts <= F.lit(end).cast("timestamp"))
    return ts.isNull() | condition


def of_asset(asset: str | None) -> Column:
    """Asset id or symbol, ignoring case."""
    if not asset:
        return F.lit(True)
    key = F.lit(asset.lower())
    return (F.lower("asset_id") == key) | (F.lower("asset_symbol") == key)


def contract_of(asset_id: Column) -> Column:
    """Contract an asset id asks for; native words and unknown forms mean no filter."""
    clean = F.trim(asset_id)
    return (
        F.when(F.lower(clean).isin(NATIVE_WORDS), F.lit(None).cast("string"))
        .when(clean.startswith("ethereum:"), F.substring_index(clean, ":", -1))
        .when(clean.startswith("0x"), clean)
    )


def transfers_of(
    transfers: DataFrame,
    address: str,
    direction: str = "any",
    asset: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    return transfers.filter(
        touches(address, direction) & of_asset(asset) & in_period(F.col("ts"), start, end)
    )


def transfers_of_many(transfers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Transfers of every row of ``addresses(chain, node, direction)`` in one pass.

    Each direction is one equi join on the matching end; a transfer between two requested
    addresses is returned once for each of them.
    """

    def side(end: str, other: str, directions: list[str]) -> DataFrame:
        table = salt_hot_keys(
            transfers.withColumn("node", F.lower(end)), ["chain", "node"], ["transfer_id"]
        )
        return table.join(addresses.filter(F.col("direction").isin(directions)))

    sent = side("from_address", "to_address", ["outgoing", "any"])
    received = side("to_address", "from_address", ["incoming", "any"])
    # A self transfer already came from the sending side.
    alone = ~((F.col("direction") == "any") & (F.lower("from_address") == F.lower("to_address")))
    return sent.unionByName(received.filter(alone))


def with_matching_transfer(transactions: DataFrame, transfers: DataFrame, condition: Column) -> DataFrame:
    """Transactions having at least one transfer that fulfils ``condition``."""
    hit = transfers.filter(condition).select("chain", "tx_hash")
    return transactions.join(hit, ["chain", "tx_hash"], "left_semi")


def by_hash(df: DataFrame, tx_hash: str) -> DataFrame:
    return df.filter(F.lower("tx_hash") == tx_hash.lower())


def block_by(blocks: DataFrame, number: int | None = None, block_hash: str | None = None) -> DataFrame:
    if number is None and not block_hash:
        raise ValueError("a block number or a block hash is required")
    if number is not None:
        return blocks.filter(F.col("block_number") == number)
    return blocks.filter(F.col("block_hash") == block_hash)


def page_order() -> list[Column]:
    """Newest block first, then transaction, then transfer index."""
    return [F.desc("block_number"), F.desc("tx_index"), F.asc("transfer_index")]


def page(
    df: DataFrame, limit: int, offset: int = 0, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """One page near the beginning: newest block first, then transaction, then transfer index.

    ``has_more`` comes from fetching one row beyond the page.  Only ``offset + limit + 1``
    rows leave the tasks (a top-k plan, not a full sort); deep pages are for :func:`ordered_table`.
    """
    keys = list(order or page_order())
    head = df.orderBy(*keys).limit(offset + limit + 1)
    ranked = top_rows(head.withColumn("_page", F.lit(0)), ["_page"], keys, offset + limit + 1, "position")
    return (
        ranked.withColumn("has_more", F.max("position").over(Window.partitionBy("_page")) > offset + limit)
        .filter((F.col("position") > offset) & (F.col("position") <= offset + limit))
        .drop("_page")
    )


@dataclass(frozen=True)
class OrderedTable:
    """A table written in the order of its pages: range parts, the rows of each, and how many stand before.

    Any page, however deep, reads the parts it lies in, one or two of them.
    """

    rows: DataFrame
    order: list[Column | str]
    #: (part, rows before it, rows) in order; one entry per range part.
    parts: list[tuple[int, int, int]]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset + 1 to offset + limit with ``position`` and ``has_more``."""
        total = self.parts[-1][1] + self.parts[-1][2] if self.parts else 0
        wanted = [(part, before) for part, before, n in self.parts if before < offset + limit and before + n > offset]
        held = self.rows.filter(F.col("_part").isin([part for part, _ in wanted]))
        shift = F.lit(0).cast("bigint")
        for part, before in wanted:
            shift = F.when(F.col("_part") == part, F.lit(before)).otherwise(shift)
        nth = F.row_number().over(Window.partitionBy("_part").orderBy(*self.order))
        return (
            held.withColumn("position", (nth + shift).cast("bigint"))
            .filter((F.col("position") > offset) & (F.col("position") <= offset + limit))
            .withColumn("has_more", F.lit(total > offset + limit))
            .drop("_part")
        )


def ordered_table(df: DataFrame, order: Sequence[Column | str] | None = None, parts: int | None = None) -> OrderedTable:
    """Writes ``df`` once in ranges of its page order (``parts`` of them, or as many as its size asks for);
    ``order`` should be unique, so that pages repeat."""
    spark = df.sparkSession
    keys = list(order or page_order())
    path = stage_path(spark, "ordered")
    spread = df.repartitionByRange(*keys) if parts is None else df.repartitionByRange(parts, *keys)
    ranged = spread.withColumn("_part", F.spark_partition_id())
    ranged.write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    return OrderedTable(rows, keys, [(part, b, n) for (part, n), b in zip(counts, before)])


def wallet_history(transactions: DataFrame, transfers: DataFrame, address: str, limit: int) -> DataFrame:
    """First transactions of a wallet on either side, oldest first."""
    found = with_matching_transfer(transactions, transfers, touches(address))
    return found.orderBy("ts", "tx_hash").limit(limit)


def attach_transfers(page_rows: DataFrame, transfers: DataFrame) -> DataFrame:
    """Transfers of a page of transactions, one row each, in index order.

    The page is small by construction, so the transfers are filtered by its hashes in one
    join.  Rows stay long: the number of transfers inside a transaction is not bounded.
    """
    return page_rows.select("chain", "tx_hash").join(transfers, ["chain", "tx_hash"], "left")


def search_labels(
    labels: DataFrame, text: str, chain: str | None = None, entity_type: str | None = None
) -> DataFrame:
    """Labels whose name or address contains the text, optionally of one chain and type."""
    q = F.lit(text.lower())
    hit = F.lower("entity_name").contains(q) | F.lower("address").contains(q)
    if chain is not None:
        hit = hit & (F.lower("chain") == chain.lower())
    if entity_type is not None:
        hit = hit & (F.upper("entity_type") == entity_type.upper())
    return labels.filter(hit)


def list_cases(cases: DataFrame, text: str | None = None) -> DataFrame:
    """Cases newest first, optionally with the text in id, title or wallet."""
    found = cases
    if text:
        q = F.lit(text.lower())
        found = cases.filter(
            F.lower("case_id").contains(q)
            | F.lower("title").contains(q)
            | F.lower("suspect_wallet").contains(q)
        )
    return found.orderBy(F.desc("created_at"), "case_id")


def _grams(text: Column, size: int, shorter: bool) -> Column:
    """Distinct substrings of length ``size``; with ``shorter`` those of every length up to it."""
    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        cut = F.transform(starts, lambda i: F.substring(text, i, n))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    cuts = [of_length(n) for n in (range(1, size + 1) if shorter else [size])]
    return F.array_distinct(F.concat(*cuts))


def containing_names(inner: DataFrame, outer: DataFrame, size: int = 3) -> DataFrame:
    """Pairs (inner, outer) of the non-empty names where the outer one contains the inner one.

    An n-gram index of the outer names is joined once.  An inner name asks it for its rarest gram only
    (a name shorter than a gram: for itself), and not at all when one of its grams is in no outer
    name, so the rows grow with the lengths of the names and with true answers to rare grams.
    """
    held = outer.select("outer", F.explode(_grams(F.col("outer"), size, True)).alias("gram"))
    load = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_names"))
    own = F.when(F.length("inner") < size, F.array("inner")).otherwise(_grams(F.col("inner"), size, False))
    asked = inner.filter("inner <> ''").withColumn("_own", own)
    rarest = (
        asked.select("inner", F.size("_own").alias("_all"), F.explode("_own").alias("gram"))
        .join(load, "gram")
        .groupBy("inner", "_all")
        .agg(F.min_by("gram", F.struct("_names", "gram")).alias("gram"), F.count(F.lit(1)).alias("_found"))
        .filter(F.col("_found") == F.col("_all"))
    )
    return (
        rarest.select("inner", "gram")
        .join(held, "gram")
        .filter(F.col("outer").contains(F.col("inner")))
        .select("inner", "outer")
    )


def case_aliases(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(case_id, alias, answered_by) of the wanted cases that an alias answers: the exact one, else the
    first in order that contains the case id or lies in it, whatever the case of letters."""
    names = aliases.select("alias").filter("alias is not null").distinct()
    cases = wanted.select("case_id").filter("case_id is not null").distinct()
    exact = cases.join(names, F.col("case_id") == F.col("alias"))
    rest = cases.join(exact.select("case_id"), "case_id", "left_anti").filter("case_id <> ''")
    rest = rest.withColumn("_c", F.lower("case_id"))
    names = names.filter("alias <> ''").withColumn("_a", F.lower("alias"))
    low_cases, low_names = rest.select("_c").distinct(), names.select("_a").distinct()
    inside = containing_names(low_names.toDF("inner"), low_cases.toDF("outer")).toDF("_a", "_c")
    around = containing_names(low_cases.toDF("inner"), low_names.toDF("outer")).toDF("_c", "_a")
    partial = (
        inside.unionByName(around).join(names, "_a").groupBy("_c").agg(F.min("alias").alias("alias"))
        .join(rest, "_c")
    )
    return exact.select("case_id", "alias", F.lit("ALIAS").alias("answered_by")).unionByName(
        partial.select("case_id", "alias", F.lit("NAME").alias("answered_by"))
    )


def case_by_alias(case_transfers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Transfers per wanted case: exact alias, else the first alias containing it or contained.

    ``case_transfers`` carries ``alias``; ``wanted(case_id)``.
    """
    chosen = case_aliases(wanted, case_transfers).drop("answered_by")
    rows = case_transfers.drop("case_id") if "case_id" in case_transfers.columns else case_transfers
    return chosen.join(rows, "alias")


def case_edges_of(cases: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Edges of each case by the first of five answers that has any, named in ``answered_by``.

    ``cases(case_id, chain, suspect)``, both optional; ``edges`` carry ``alias`` (NULL: none).  ALIAS and
    NAME as in :func:`case_aliases`; CLOSURE: edges of the case's chain that touch a node within
    ``rounds`` forward steps of its suspect; CHAIN: all edges of its chain; ALL: all edges, for a case
    without a chain.  Each level sees only the cases that the ones before left.
    """
    named = stage(case_aliases(cases, edges), "case-names")
    own = salt_hot_keys(edges.filter("alias is not null"), ["alias"], ["transfer_id"]).join(named)
    known = cases.filter("case_id is not null").select(
        "case_id", key_chain(filled(F.col("chain"))).alias("chain"),
        address_key(F.col("chain"), filled(F.col("suspect"))).alias("root"),
    ).dropDuplicates(["case_id"])
    rest = known.join(named.select("case_id"), "case_id", "left_anti")
    followed = stage(
        forward_closure(edges, rest.filter("chain is not null and root is not null"), rounds), "case-closures"
    )
    rest = rest.join(followed.select("case_id").distinct(), "case_id", "left_anti")
    scopes = stage(rest.select("case_id", F.coalesce("chain", F.lit("*")).alias("_scope")), "case-scopes")
    # A scope holds a chain's edges, or all: few cases meet them, and nothing is copied that no case asks for.
    wide = edges.withColumn("_scope", F.explode(F.array("chain", F.lit("*"))))
    whole = (
        salt_hot_keys(wide.join(scopes.select("_scope").distinct(), "_scope", "left_semi"), ["_scope"], ["transfer_id"])
        .join(scopes)
        .withColumn("answered_by", F.when(F.col("_scope") == "*", "ALL").otherwise("CHAIN"))
    )
    columns = ["case_id", "answered_by", *[c for c in edges.columns if c != "case_id"]]
    parts = [own, followed.withColumn("answered_by", F.lit("CLOSURE")), whole]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))


def first_transfer_of(transactions: DataFrame, transfers: DataFrame) -> DataFrame:
    """Evidence view: each transaction with its first transfer."""
    first = first_rows(transfers, ["chain", "tx_hash"], ["transfer_index", "transfer_id"])
    return transactions.join(first.drop("ts", "block_number"), ["chain", "tx_hash"])


def timeline(
    case_transfers: DataFrame,
    asset: str | None = None,
    min_amount: str | None = None,
    max_hop: int | None = None,
) -> DataFrame:
    """Chronological transfers of each case with a running total per asset."""
    rows = case_transfers.filter(of_asset(asset))
    if min_amount is not None:
        rows = rows.filter(F.col("amount") >= F.lit(min_amount).cast("decimal(38,18)"))
    if max_hop is not None:
        rows = rows.filter(F.col("hop") <= max_hop)
    return running_sum(
        rows, ["case_id", "asset_symbol"], ["ts", "tx_hash", "transfer_id"], "amount", "running_total"
    )


def wallet_summary(transfers: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """First and last seen, totals in and out, per address and asset; one aggregate."""
    side = F.explode(
        F.array(
            F.struct(F.col("from_address").alias("address"), F.lit(True).alias("out")),
            F.struct(F.col("to_address").alias("address"), F.lit(False).alias("out")),
        )
    )
    ends = transfers.select("chain", "asset_symbol", "amount", "ts", side.alias("s")).select(
        "chain", "asset_symbol", "amount", "ts", "s.*"
    )
    zero = F.lit(0).cast("decimal(38,18)")
    summary = ends.groupBy("chain", "address", "asset_symbol").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.coalesce(F.sum(F.when(~F.col("out"), F.col("amount"))), zero).alias("total_in"),
        F.coalesce(F.sum(F.when(F.col("out"), F.col("amount"))), zero).alias("total_out"),
        F.count(F.lit(1)).alias("transfers"),
    )
    if roles is None:
        return summary
    named = roles.select("node", F.col("entity_type").alias("role"))
    return summary.join(named, F.lower("address") == F.col("node"), "left").withColumn(
        "role", F.coalesce("role", F.lit("INTERMEDIARY"))
    ).drop("node")


def case_transactions(
    case_edges: DataFrame, transactions: DataFrame, limit: int, offset: int = 0
) -> DataFrame:
    """One page of transactions touched by the cases' edges."""
    hashes = case_edges.select("chain", "tx_hash").distinct()
    found = transactions.join(hashes, ["chain", "tx_hash"], "left_semi")
    return page(found, limit, offset, [F.desc("block_number"), F.asc("tx_hash")])


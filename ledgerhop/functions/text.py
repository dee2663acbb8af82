"""Chain, status, address and entity-category rules as column expressions."""

from __future__ import annotations

from itertools import chain as _flat

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the chains.
CHAIN_ALIASES = {
    "btc": "bitcoin",
    "bitcoin": "bitcoin",
    "eth": "ethereum",
    "ethereum": "ethereum",
    "bnb": "bnb",
    "binance": "bnb",
    "bsc": "bnb",
    "polygon": "polygon",
    "matic": "polygon",
    "trx": "tron",
    "tron": "tron",
    "sol": "solana",
    "solana": "solana",
}
# The registry's shorter alias list, chains whose addresses ignore case, status words.
REGISTRY_CHAIN_ALIASES = {"eth": "ethereum", "btc": "bitcoin", "trx": "tron"}
CASE_FOLDED_CHAINS = ["ethereum", "polygon", "arbitrum", "bnb", "bsc"]
CONFIRMED_WORDS = ["success", "confirmed", "1", "true", "ok"]
FAILED_WORDS = ["failed", "failure", "error", "0", "false"]
PENDING_WORDS = ["pending", "queued", "mempool"]
# Label text to category; the first matching line wins.
CATEGORY_WORDS = [
    ("VASP", ["VASP", "EXCHANGE", "CENTRALIZED"]),
    ("CUSTODIAN", ["CUSTODIAN", "CUSTODY"]),
    ("PROTOCOL", ["PROTOCOL", "DEX", "DEFI"]),
    ("BRIDGE", ["BRIDGE"]),
    ("PAYMENT_PROVIDER", ["MIXER", "PRIVACY"]),
    ("MINER", ["MINER", "POOL"]),
]
SERVICE_CATEGORIES = ["VASP", "EXCHANGE", "CUSTODIAN"]  # fixed values


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in _flat.from_iterable(values.items())])
    return F.try_element_at(table, key)


def filled(*columns: Column) -> Column:
    """First argument that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def canonical_chain(text: Column, default: str | None = None) -> Column:
    """Canonical chain name; unknown spellings give ``default``."""
    found = _lookup(CHAIN_ALIASES, F.lower(F.trim(text)))
    return found if default is None else F.coalesce(found, F.lit(default))


def registry_chain(text: Column) -> Column:
    """The registry's shorter alias rule; other names pass through in lower case."""
    clean = F.lower(F.trim(text))
    return F.coalesce(_lookup(REGISTRY_CHAIN_ALIASES, clean), clean)


def key_chain(text: Column) -> Column:
    """Chain name that all tables are joined on: the canonical one, else the name in lower case."""
    return F.coalesce(canonical_chain(text), F.lower(F.trim(text)))


def trace_direction(text: Column) -> Column:
    """``outgoing``, ``incoming`` or ``any`` for the accepted spellings; anything else is an error."""
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin("outgoing", "out", "forward"), "outgoing")
        .when(word.isin("incoming", "in", "backward"), "incoming")
        .when(word.isin("any", "both", "all"), "any")
        .otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), F.coalesce(text, F.lit("NULL")))))
    )


def transaction_status(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin(CONFIRMED_WORDS), "confirmed")
        .when(word.isin(FAILED_WORDS), "failed")
        .when(word.isin(PENDING_WORDS), "pending")
        .otherwise("unknown")
    )


def address_key(chain: Column, address: Column, fold_all: bool = False) -> Column:
    """Join key of an address.

    Hex addresses ignore case, Base58 ones do not.  ``fold_all`` lower-cases every
    chain, which merges Base58 addresses that differ only in case.
    """
    clean = F.trim(address)
    if fold_all:
        return F.lower(clean)
    return F.when(key_chain(chain).isin(CASE_FOLDED_CHAINS), F.lower(clean)).otherwise(clean)


def entity_category(text: Column) -> Column:
    upper = F.upper(F.trim(text))
    rule = None
    for category, words in CATEGORY_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | upper.contains(word)
        rule = F.when(hit, category) if rule is None else rule.when(hit, category)
    return F.coalesce(rule, F.lit("UNKNOWN"))


def is_service(flag: Column, category: Column) -> Column:
    """Explicit flag first, else the category decides."""
    return F.coalesce(flag, category.isin(SERVICE_CATEGORIES))

"""Address format and checksum audit.

Shape rules are columns.  Checksums need Keccak-256 and base-58 / base-32 arithmetic,
so the distinct addresses pass one Arrow-batched UDF.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerhop.functions.text import canonical_chain

# Alphabets and constants of the published address formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_FORMATS = {1: "BECH32_SEGWIT", 0x2BC830A3: "BECH32M_TAPROOT"}
P2PKH_VERSION, P2SH_VERSION, TRON_VERSION = 0x00, 0x05, 0x41
KECCAK_RATE = 136


def _keccak_schedule() -> tuple[list[int], list[tuple[int, int, int]]]:
    """Round constants from the degree-8 LFSR and the lane walk of rho and pi."""
    constants, register = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if register & 1:
                word |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        constants.append(word)
    walk, x, y = [], 1, 0
    for t in range(24):
        walk.append((x, y, ((t + 1) * (t + 2) // 2) % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return constants, walk


_ROUNDS, _WALK = _keccak_schedule()


def keccak256_batch(messages: list[bytes]) -> np.ndarray:
    """Keccak-256 of short messages (one block each) for a whole batch: shape (n, 32)."""
    blocks = np.zeros((len(messages), KECCAK_RATE), dtype=np.uint8)
    for row, message in enumerate(messages):
        blocks[row, : len(message)] = np.frombuffer(message, dtype=np.uint8)
        blocks[row, len(message)] ^= 0x01
    blocks[:, -1] ^= 0x80
    lanes = np.zeros((25, len(messages)), dtype=np.uint64)
    lanes[:17] = blocks.view("<u8").T
    a = {(x, y): lanes[x + 5 * y].copy() for x in range(5) for y in range(5)}

    def rotate(v: np.ndarray, n: int) -> np.ndarray:
        return v if n == 0 else (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    for constant in _ROUNDS:
        column = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
        mixed = [column[(x - 1) % 5] ^ rotate(column[(x + 1) % 5], 1) for x in range(5)]
        a = {(x, y): lane ^ mixed[x] for (x, y), lane in a.items()}
        moved = {(0, 0): a[0, 0]}
        for x, y, turn in _WALK:
            moved[y, (2 * x + 3 * y) % 5] = rotate(a[x, y], turn)
        a = {
            (x, y): moved[x, y] ^ (~moved[(x + 1) % 5, y] & moved[(x + 2) % 5, y])
            for x in range(5)
            for y in range(5)
        }
        a[0, 0] = a[0, 0] ^ np.uint64(constant)
    return np.stack([a[x, 0] for x in range(4)], axis=1).astype("<u8").view(np.uint8)


def checksum_case(bodies: list[str]) -> list[str]:
    """EIP-55 spelling of lower-case 40-digit hex bodies."""
    if not bodies:
        return []
    digests = keccak256_batch([b.encode() for b in bodies])
    nibbles = np.stack([digests >> 4, digests & 15], axis=2).reshape(len(bodies), -1)[:, :40]
    return [
        "0x" + "".join(c.upper() if high else c for c, high in zip(body, row >= 8, strict=True))
        for body, row in zip(bodies, nibbles, strict=True)
    ]


def base58check(text: str) -> bytes | None:
    """Payload without its checksum, None when a character or the checksum is wrong."""
    number = 0
    for c in text:
        digit = BASE58.find(c)
        if digit < 0:
            return None
        number = number * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    data = b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")
    if len(data) < 5:
        return None
    body, check = data[:-4], data[-4:]
    return body if hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check else None


def bech32_format(text: str) -> str | None:
    """Format name of a ``bc1`` address whose checksum holds."""
    lower = text.lower()
    if text not in (lower, text.upper()) or not 8 <= len(text) <= 90:
        return None
    prefix, _, body = lower.rpartition("1")
    values = [BECH32.find(c) for c in body]
    if prefix != "bc" or len(values) < 7 or min(values) < 0:
        return None
    check = 1
    for value in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for bit, constant in enumerate(BECH32_GENERATOR):
            if top >> bit & 1:
                check ^= constant
    return BECH32_FORMATS.get(check)


_RESULT = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        T.StructField("checksum_valid", T.BooleanType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("format_type", T.StringType()),
    ]
)


def _bitcoin(text: str) -> tuple[bool, bool | None, str, str | None]:
    if text.lower().startswith("bc1"):
        kind = bech32_format(text)
        if kind is None or text.lower()[3:-6] == "":
            return False, False, text, None
        return True, True, text.lower(), kind
    if text[:1] in ("1", "3") and 26 <= len(text) <= 35:
        payload = base58check(text)
        if payload:
            kinds = {P2PKH_VERSION: "P2PKH_LEGACY", P2SH_VERSION: "P2SH_SEGWIT"}
            return True, True, text, kinds.get(payload[0], "BASE58_OTHER")
    return False, False, text, None


def _tron(text: str) -> tuple[bool, bool | None, str, str | None]:
    payload = base58check(text) if text.startswith("T") and len(text) == 34 else None
    if payload is not None and len(payload) == 21 and payload[0] == TRON_VERSION:
        return True, True, text, "BASE58CHECK_TRON"
    return False, False, text, None


@F.pandas_udf(_RESULT)
def audit_address(chain: pd.Series, address: pd.Series) -> pd.DataFrame:
    """Validity, checksum, canonical form and format; NULL validity for uncovered chains."""
    text = address.fillna("").str.strip()
    hexed = chain.isin(["ethereum", "bnb", "polygon"]) & text.str.fullmatch("0x[0-9a-fA-F]{40}")
    proper = dict(zip(text[hexed], checksum_case([t[2:].lower() for t in text[hexed]]), strict=True))
    rows = []
    for c, t in zip(chain, text, strict=True):
        if t in proper and c in ("ethereum", "bnb", "polygon"):
            body = t[2:]
            if body in (body.lower(), body.upper()):
                rows.append((True, None, proper[t], "HEX_RAW"))
            else:
                same = t == proper[t]
                rows.append((True, same, proper[t], "EIP-55" if same else "HEX_MIXED_INVALID_CHECKSUM"))
        elif c == "bitcoin":
            rows.append(_bitcoin(t))
        elif c == "tron":
            rows.append(_tron(t))
        elif c in ("ethereum", "bnb", "polygon"):
            rows.append((False, False, t, None))
        else:
            rows.append((None, None, t, None))
    return pd.DataFrame(rows, columns=["valid", "checksum_valid", "canonical", "format_type"])


def audit_addresses(addresses: DataFrame) -> DataFrame:
    """Audit each distinct (chain, address) once."""
    keyed = addresses.select(
        F.coalesce(canonical_chain(F.col("chain")), F.lower(F.trim("chain"))).alias("chain"), "address"
    ).distinct()
    return keyed.withColumn("a", audit_address("chain", "address")).select("chain", "address", "a.*")


def audit_report(audited: DataFrame) -> DataFrame:
    """Counts per chain, format and validity."""
    return audited.groupBy(
        "chain", F.coalesce("format_type", F.lit("NONE")).alias("format_type"), "valid", "checksum_valid"
    ).agg(F.count(F.lit(1)).alias("addresses"))


def rejected(audited: DataFrame) -> DataFrame:
    return audited.filter(~F.col("valid") | ~F.col("checksum_valid"))

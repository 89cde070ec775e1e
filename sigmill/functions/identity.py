"""Digests, keys and identifiers."""

from __future__ import annotations

import base64
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_digest(*columns: str) -> Column:
    """SHA-256 of the compact JSON object of the columns, keys sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def shard_key(value: Column) -> Column:
    """Signed 64-bit number from the first half of the SHA-256, most significant byte first."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, -10).cast("long")


def fingerprint(values: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the JSON array."""
    return F.left(F.sha2(F.to_json(values), 256), F.lit(16))


def _uuid(digits: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in cuts])


def md5_uuid(value: Column) -> Column:
    return _uuid(F.md5(value))


def sha_uuid(value: Column) -> Column:
    """UUID of version 5 form from a SHA-256."""
    digits = F.sha2(value, 256)
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return _uuid(F.concat(F.substring(digits, 1, 12), F.lit("5"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))


def keyed_digest(value: Column, key: bytes, namespace: str | None = None) -> Column:
    """HMAC-SHA-256; with a namespace, of namespace, a zero byte and the composed value."""

    def run(s: pd.Series) -> pd.Series:
        head = b"" if namespace is None else namespace.encode() + b"\0"
        text = (lambda x: x) if namespace is None else (lambda x: unicodedata.normalize("NFC", x))
        return s.map(lambda x: None if x is None else hmac.digest(key, head + text(x).encode(), "sha256"))

    return F.pandas_udf(run, "binary")(value)


def reference_number(value: Column, key: bytes) -> Column:
    """Base32 of the first 16 HMAC bytes, without padding."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base64.b32encode(hmac.digest(key, x.encode(), "sha256")[:16]).decode().rstrip("="))

    return F.pandas_udf(run, "string")(value)

"""Keyed digests from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The key's inner and outer block for HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text, in hex."""
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)

"""Keyed hashes built from native `sha2`, so no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions.scalar import col

#: Hex digits read from a digest: 13 digits are 52 bits, exact in a double.
_DIGITS = 13
_RANGE = float(16**_DIGITS)
_SHA_BLOCK = 64


def hash_unit(value, seed: int) -> Column:
    """`value` mapped to `[0, 1)` by its text and the seed, the same on every run and row order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(value).cast("string")), 256)
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(_RANGE)


def hmac_sha256(value, key: str) -> Column:
    """HMAC-SHA256 of the text of `value`, as lower-case hex; null stays null."""
    import hashlib

    secret = key.encode()
    if len(secret) > _SHA_BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_SHA_BLOCK, b"\0")
    inner = bytearray(b ^ 0x36 for b in secret)
    outer = bytearray(b ^ 0x5C for b in secret)
    message = F.encode(col(value).cast("string"), "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)

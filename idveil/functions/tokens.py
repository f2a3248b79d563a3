"""Deterministic keyed tokens (HMAC-SHA256) built from Spark's own hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil.functions.columns import as_col

TOKEN_CHARS = 64  # the whole digest: shorter ones collide (8 characters from some 77,000 values on)
_BLOCK = 64


def hmac_sha256(value: Column | str, key: str) -> Column:
    """HMAC-SHA256 as lower-case hex, equal to the standard library's."""
    secret = key.encode("utf-8")
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in secret))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in secret))
    inner = F.sha2(F.concat(inner_pad, F.encode(as_col(value), "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def tokenize(value: Column | str, entity: Column | str, salt: str, chars: int = TOKEN_CHARS) -> Column:
    """``TOK-<entity>-<hex>``; *entity* is a name or a Column of names.

    The salt must be secret: under a known one, tokens of short numbers are found by trying all numbers.
    """
    if not salt:
        raise ValueError("tokens need a secret salt")
    entity = F.lit(entity) if isinstance(entity, str) else entity
    digest = F.upper(F.substring(hmac_sha256(value, salt), 1, chars))
    return F.concat(F.lit("TOK-"), entity, F.lit("-"), digest)

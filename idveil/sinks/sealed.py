"""Findings encrypted with AES-256-GCM under a key derived from a passphrase.

Each row is sealed on its own (nonce, ciphertext, tag), so sealing and opening run in
parallel. The key is a literal of the plan: keep ``spark.sql.redaction.string.regex``
set where plans are logged.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idveil.operators.rollups import report

FORMAT = "idveil-sealed-v1"
KEY_ITERATIONS = 600_000  # PBKDF2-SHA256
SALT_BYTES = 16
MAX_SALTS = 1_000  # sealing runs that one dataset may hold; each takes a key derivation when it is opened


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode("utf-8"), salt, KEY_ITERATIONS, 32)


def encrypt_findings(findings: DataFrame, passphrase: str, salt: bytes | None = None) -> DataFrame:
    """``format, salt, payload``: one sealed JSON object per finding."""
    if not passphrase:
        raise ValueError("a passphrase is required")
    salt = salt or os.urandom(SALT_BYTES)
    key = F.lit(derive_key(passphrase, salt))
    rows = report(findings)
    return rows.select(
        F.lit(FORMAT).alias("format"),
        F.lit(salt).alias("salt"),
        F.aes_encrypt(F.to_json(F.struct(*rows.columns)), key, F.lit("GCM")).alias("payload"),
    )


def decrypt_findings(sealed: DataFrame, passphrase: str) -> DataFrame:
    """The findings of sealed datasets, also of several that were sealed under salts of their own.

    A wrong passphrase or altered data is an error, as is any row of another format. The distinct salts are read
    first, one per sealing run (more than ``MAX_SALTS`` are an error); their keys are a small map in the plan.
    """
    heads = sealed.select("format", "salt").distinct().limit(MAX_SALTS + 1).collect()
    if not heads:
        return sealed.sparkSession.createDataFrame([], _SCHEMA)
    if any(h["format"] != FORMAT or h["salt"] is None for h in heads):
        raise ValueError("not a sealed findings dataset")
    if len(heads) > MAX_SALTS:
        raise ValueError(f"more than {MAX_SALTS} sealing runs in one dataset")
    keys = [x for h in heads for x in (F.lit(bytes(h["salt"]).hex().upper()), F.lit(derive_key(passphrase, bytes(h["salt"]))))]
    key = F.create_map(*keys)[F.hex("salt")]
    text = F.aes_decrypt(F.col("payload"), key, F.lit("GCM")).cast("string")
    return sealed.select(F.from_json(text, _SCHEMA).alias("f")).select("f.*")


_SCHEMA = (
    "file string, sheet string, row string, column string, entity_type string, "
    "masked_value string, confidence string"
)

"""Tamper-evident decisions: argument hashes, signatures, column encryption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "enc:v1:"


def args_hash(args: Column, length: int = 32) -> Column:
    """Leading hex digits of the SHA-256 of a flat JSON object with its keys sorted."""
    entries = F.array_sort(F.map_entries(F.from_json(args, "map<string,string>")))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, length)


def canonical(columns: Sequence[str]) -> Column:
    """Key-sorted JSON of the columns; nulls are written."""
    pairs = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("[null]"))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex from the built-in digest; the padded keys are literals."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = bytes(b ^ 0x36 for b in key.ljust(64, b"\0")), bytes(b ^ 0x5C for b in key.ljust(64, b"\0"))
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def sign_decisions(decisions: DataFrame, key: bytes, columns: Sequence[str]) -> DataFrame:
    return decisions.withColumn("signature", hmac_sha256(canonical(columns), key))


def verify_ledger(signed: DataFrame, keys: Sequence[bytes], columns: Sequence[str]) -> DataFrame:
    """Adds ``valid_key``: the place of the key that verifies the row, null if it was tampered with."""
    return signed.withColumn("valid_key", F.coalesce(*[F.when(hmac_sha256(canonical(columns), k) == F.col("signature"), i) for i, k in enumerate(keys)]))


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    """AES-GCM with a prefix; null, empty and encrypted values pass."""
    seal = lambda c: F.when(c.isNull() | (c == "") | c.startswith(PREFIX), c).otherwise(F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(c, key, F.lit("GCM")))))
    return df.withColumns({c: seal(F.col(c)) for c in columns})


def decrypt_columns(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    opened = lambda c: F.when(c.startswith(PREFIX), F.aes_decrypt(F.unbase64(F.substr(c, F.lit(len(PREFIX) + 1))), key, F.lit("GCM")).cast("string")).otherwise(c)
    return df.withColumns({c: opened(F.col(c)) for c in columns})


def resolve_api_keys(requests: DataFrame, keys: DataFrame, scope: str) -> DataFrame:
    """Requests with a raw key against hashed keys: ``request_id, key_id, allowed``."""
    rows = requests.select("request_id", "raw_key", F.sha2("raw_key", 256).alias("key_hash")).join(keys, "key_hash", "left")
    ok = F.col("raw_key").startswith("lw_") & F.col("key_id").isNotNull() & F.col("revoked_at").isNull() & (F.array_contains("scopes", scope) | F.array_contains("scopes", "admin"))
    return rows.select("request_id", "key_id", F.coalesce(ok, F.lit(False)).alias("allowed"))


def connector_gaps(requirements: DataFrame, credentials: DataFrame) -> DataFrame:
    """Required names with no stored credential: ``tenant_id, connector, name``."""
    return requirements.join(credentials, ["tenant_id", "connector", "name"], "left_anti")


def members(tenant_members: DataFrame, users: DataFrame) -> DataFrame:
    return tenant_members.join(users, "user_id").select("tenant_id", "user_id", "name", "joined_at")


def select_table(df: DataFrame, columns: Sequence[str], filters: dict, order: Sequence[str], limit: int = 100) -> DataFrame:
    """Named columns of the rows that equal all filters; the order makes the limit repeatable."""
    for c, v in filters.items():
        df = df.where(F.col(c) == v)
    return df.select(*columns).orderBy(*order).limit(limit)

"""Deterministic pseudo-randomness from content hashes.

Every random choice in the library is a function of (seed, key), so results do
not depend on partitioning or task retries, and DuckDB can reproduce them:
md5 gives the same hex in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def hash_hex(seed, *keys: Column) -> Column:
    """md5 hex of 'seed|k1|k2…'."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed, *keys: Column) -> Column:
    """Uniform [0,1) from the first 32 bits of the md5 hex."""
    h = hash_hex(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def uniform_sql(seed, *key_sql: str) -> str:
    """DuckDB twin of :func:`uniform` for oracle SQL."""
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def hash_hex_sql(seed, *key_sql: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"md5({parts})"

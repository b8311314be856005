"""Deterministic hashes that other engines reproduce: content ids, cache keys, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the separator between the fields of a content id.
FIELD_SEPARATOR = "␟"
#: Fixed value: the separator between model and text in a cache key.
KEY_SEPARATOR = "\x1f"
CONTENT = ("prompt", "model_a", "model_b", "completion_a", "completion_b")


def content_id(*columns) -> Column:
    """First 16 hex digits of the SHA-1 of the fields."""
    return F.substring(F.sha1(F.concat_ws(FIELD_SEPARATOR, *[F.coalesce(c, F.lit("")) for c in map(F.col, columns)])), 1, 16)


def sha1_bucket(column, buckets: int = 1000) -> Column:
    """SHA-1 of a string as a 160-bit number, modulo ``buckets``; folded in 32-bit steps."""
    digest, out = F.sha1(F.col(column).cast("string") if isinstance(column, str) else column), F.lit(0).cast("long")
    for i in range(5):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        out = F.pmod(out * ((1 << 32) % buckets) + part, F.lit(buckets))
    return out


def held_out(column, share: float) -> Column:
    """Deterministic membership of the validation or verification part."""
    return sha1_bucket(column) < int(share * 1000)


def half(column) -> Column:
    """0 or 1: two disjoint halves by identifier."""
    return F.pmod(sha1_bucket(column), F.lit(2))


def embedding_key(model_id: str, text) -> Column:
    return F.sha1(F.concat(F.lit(model_id + KEY_SEPARATOR), text))

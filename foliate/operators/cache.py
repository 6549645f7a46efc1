"""The three-tier cache as a table of entries: appended to, read by the latest entry of each key that still holds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that entries of each tier hold.
TTL = {"layout": 24 * 3600, "vlm": 7 * 86400, "document": 30 * 86400}


def layout_key(doc_hash: Column, page: Column, split: Column | None = None) -> Column:
    """Key of a page's layout; pieces of an over-tall page have keys of their own."""
    whole = F.concat(F.lit("layout:"), doc_hash, F.lit(":"), page.cast("string"))
    return whole if split is None else F.when(split.isNull(), whole).otherwise(F.concat(whole, F.lit(":"), split.cast("string")))


def vlm_key(doc_hash: Column, page: Column, bbox: Column, block_type: Column, model: Column) -> Column:
    corners = F.concat_ws(", ", *(bbox[c].cast("string") for c in ("x1", "y1", "x2", "y2")))
    return F.concat(F.lit("vlm:"), doc_hash, F.lit(":"), page.cast("string"), F.lit(":("), corners, F.lit("):"), block_type, F.lit(":"), model)


def document_key(doc_hash: Column, config_hash: str) -> Column:
    return F.concat(F.lit("doc:"), doc_hash, F.lit(f":{config_hash}"))


def digest(key: Column) -> Column:
    return F.md5(key.cast("binary"))


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _ttl(ttl: dict[str, int]) -> Column:
    out = F.lit(None).cast("double")
    for tier, seconds in ttl.items():
        out = F.when(F.col("tier") == tier, F.lit(float(seconds))).otherwise(out)
    return out


def latest(entries: DataFrame) -> DataFrame:
    """The last written entry of each tier and key: summed before the shuffle, so a hot key costs no more than any."""
    last = F.max_by(F.struct("ts", "data"), F.struct("ts", "data"))
    return entries.groupBy("tier", "key").agg(last.alias("e")).select("tier", "key", "e.ts", "e.data")


def valid(entries: DataFrame, now: float, ttl: dict[str, int] = TTL) -> DataFrame:
    """Latest entries that are younger than their tier allows."""
    return latest(entries).filter(F.lit(now) - F.col("ts") < _ttl(ttl))


def expired(entries: DataFrame, now: float, ttl: dict[str, int] = TTL) -> DataFrame:
    """Entries that a clean-up takes away: older than their tier allows (an age of just that stays)."""
    return entries.filter(F.lit(now) - F.col("ts") > _ttl(ttl))


def cleanup(entries: DataFrame, now: float, ttl: dict[str, int] = TTL) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, number taken away by tier)."""
    gone = F.lit(now) - F.col("ts") > _ttl(ttl)
    return entries.filter(~gone), entries.groupBy("tier").agg(F.sum(gone.cast("long")).alias("removed"))


def clear(entries: DataFrame, tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, number taken away by tier) where a tier, or all, are emptied."""
    gone = F.lit(True) if tier is None else F.col("tier") == tier
    return entries.filter(~gone), entries.filter(gone).groupBy("tier").agg(F.count("*").alias("removed"))


def split_cached(requests: DataFrame, entries: DataFrame, tier: str, now: float, ttl: dict[str, int] = TTL) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached data, requests to compute); requests have a `key`."""
    have = valid(entries.filter(F.col("tier") == tier), now, ttl).select("key", F.col("data").alias("cached"))
    return requests.join(have, "key"), requests.join(have.select("key"), "key", "left_anti")


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones appended; compact with latest()."""
    return entries.unionByName(new.select(*entries.columns))

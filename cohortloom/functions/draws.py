"""Deterministic draws: an order or an index that depends on seed, tag and key alone, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, tag: str, *keys: str | Column) -> Column:
    """md5 of 'seed|tag|key|...': an order for shuffles."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *(p.cast("string") for p in parts)))


def draw_u32(seed: int, tag: str, *keys: str | Column) -> Column:
    """The first 32 bits of draw() as a long."""
    return F.conv(F.substring(draw(seed, tag, *keys), 1, 8), 16, 10).cast("long")


def draw_unit(seed: int, tag: str, *keys: str | Column) -> Column:
    """A double in [0, 1)."""
    return draw_u32(seed, tag, *keys) / F.lit(4294967296.0)

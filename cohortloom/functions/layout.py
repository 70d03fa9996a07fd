"""How rows that are gone over many times lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes that one task reads with ease.
PART = 16 << 20


def gathered_if_small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """Persisted rows as one partition if all of them are under PART, else as they lie.

    Each pass costs a task a partition, whatever is in it, so a few rows that a shuffle has spread over hundreds of partitions are dearer than their
    work. What is larger keeps its partitions, and what is known of them. The rows are counted, which fills their cache.
    """
    return rows.coalesce(1) if rows.count() * row_bytes < PART else rows

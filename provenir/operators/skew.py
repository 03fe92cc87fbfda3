"""Finding hot keys, and splitting a frame on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.session import cut_counted

# A key list this long is at most a few tens of MB.
MAX_BROADCAST_KEYS = 200_000


def hot_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame | None:
    """Keys with more than ``more_than`` rows, or None when there are none.

    The counts are folded on the map side. The result is written down, so its
    size is known before anything is broadcast.
    """
    return hot_of_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, more_than)


def hot_of_counts(counts: DataFrame, keys: list[str], more_than: int) -> DataFrame | None:
    """The same from rows that already carry a partial count ``n``."""
    heavy = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > more_than)
    hot, found = cut_counted(heavy.select(*keys), "hot")
    if found == 0:
        return None
    return F.broadcast(hot) if found <= MAX_BROADCAST_KEYS else hot


def salt_count(df: DataFrame) -> int:
    """How many ways to split a heavy join key, from the shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(16, width // 64))

"""Size checks in front of every broadcast, and lineage cuts on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A lookup of this many short rows stays well below the 8 GB broadcast limit
# and below a few dozen MB on each executor.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, by a count; materialise ``df`` first."""
    return df.count() <= max_rows


def broadcast_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; larger inputs keep a shuffle join. The frame is
    materialised first, so that the count and the join do not each compute it."""
    df = reuse(df)
    return F.broadcast(df) if is_small(df, max_rows) else df


def _checkpoint_ready(df: DataFrame) -> bool:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is not None:
        return True
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        sc.setCheckpointDir(folder)
    return bool(folder)


def reuse(df: DataFrame) -> DataFrame:
    """For a frame that several branches or rounds read: checkpoint it in the shared folder the
    session names in ``spark.checkpoint.dir``; without that setting cache it, in which case lost
    blocks are recomputed from the sources."""
    return df.checkpoint() if _checkpoint_ready(df) else df.persist()

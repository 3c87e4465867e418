"""Tables written in the order of a key, so that a page is read from the blocks it lies in."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.operators.numbering import number_rows

ROW, BLOCK = "_row_no", "_block"
META = "_pages"
# Folders of a table; with more blocks than this, a folder holds several that follow each other.
FOLDERS = 256


def write_pages(df: DataFrame, path: str, order_by: list[str], block_rows: int = 1_000_000) -> None:
    """Write ``df`` in the order of ``order_by`` (unique), numbered from 1, in blocks of ``block_rows`` rows, a folder each. There are
    at most ``FOLDERS`` folders, so that the number of files doesn't grow with the table: in a larger one, a folder has as many blocks as that takes."""
    folder_rows = block_rows * max(1, math.ceil(df.count() / (block_rows * FOLDERS)))
    dealt = number_rows(df, order_by, ROW).withColumn(BLOCK, F.floor((F.col(ROW) - 1) / folder_rows).cast("int"))
    dealt.repartition(BLOCK).sortWithinPartitions(BLOCK, ROW).write.partitionBy(BLOCK).parquet(path)
    df.sparkSession.createDataFrame([(folder_rows,)], "block_rows long").coalesce(1).write.parquet(f"{path}/{META}")


def read_page(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset``, in order: only the blocks these lie in are read, and of them, by the statistics
    of their sorted files, the row groups. Beyond the end there are no rows."""
    block_rows = spark.read.parquet(f"{path}/{META}").first()[0]
    first, last = offset // block_rows, (offset + max(limit, 1) - 1) // block_rows
    rows = spark.read.parquet(path).filter(F.col(BLOCK).between(first, last) & (F.col(ROW) > offset) & (F.col(ROW) <= offset + limit))
    return rows.orderBy(ROW).drop(ROW, BLOCK)

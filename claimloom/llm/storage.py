"""Intermediate tables on the cluster's shared storage, and stable row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. It may only be unset in local mode, where one machine does all."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'claimloom-shared')}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the time of a block; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def others(df: DataFrame, new: tuple[str, ...]) -> list[str]:
    """The columns of ``df`` but those named like one of ``new`` in any case, which these replace."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


class Workspace:
    """A database of intermediate tables in the shared folder.

    A saved table cuts lineage: what follows it survives the loss of any executor without running the steps
    before it again. Shuffle files of a step go when its table is written, and ``drop`` frees a table that
    no later step reads. Tables that the caller's result still reads stay until ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"llm_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.count = 0
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{self.folder}'")

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        table = f"{self.name}.t{self.count}"
        with settings(self.spark, **{CLEANUP.replace(".", "__"): "true"}):
            df.write.option("compression", "zstd").saveAsTable(table)
        out = self.spark.table(table)
        out.workspace_table = table
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.spark.sql(f"DROP TABLE IF EXISTS {df.workspace_table}")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


def with_row_key(docs: DataFrame, id_col: str, ws: Workspace, key: str = "_row") -> tuple[DataFrame, bool]:
    """``docs`` with a bigint that tells rows apart, and whether that is ``id_col`` itself.

    Ids that are unique and not null serve as they are. Otherwise rows are numbered in a written table, so that
    repeated ids and ids that are null stay rows of their own, and no later run can number them differently.
    """
    ids = docs.groupBy(F.col(id_col).cast("bigint").alias("id")).count()
    odd = ids.where("count > 1 OR id IS NULL").limit(1).count() if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else 1
    if not odd:
        return docs.withColumn(key, F.col(id_col).cast("bigint")), True
    return ws.save(docs.withColumn(key, F.monotonically_increasing_id())), False

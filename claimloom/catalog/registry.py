"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.catalog.views import Data, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(data)`` under ``name``; ``sql`` runs over the named views on DuckDB."""

    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return register


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder on the storage named by ``spark.checkpoint.dir``; a temporary one only in local mode
    where that is unset, as other machines don't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"{what}-")

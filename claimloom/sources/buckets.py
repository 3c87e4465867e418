"""Tables in hash buckets, of which a change writes only those that hold changed keys."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimloom.operators import lifecycle
from claimloom.sizing import reuse

BUCKET = "_bucket"
# Folders whose name begins with an underscore are not read as data.
META = "_buckets"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets).cast("long")).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` as a new table of ``buckets`` folders by the hash of ``key``, one file each. Choose their number so that a bucket is a
    task's work; it stays with the table. Null keys are in a bucket as well."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)
    schema = df.withColumn(BUCKET, F.lit(0)).schema.json()
    df.sparkSession.createDataFrame([(key, buckets, schema)], "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/{META}")


def _table(spark: SparkSession, path: str) -> tuple[str, int, DataFrame]:
    """Key, number of buckets, and the rows with their bucket; the schema is kept beside the data, which may be none."""
    key, buckets, schema = spark.read.parquet(f"{path}/{META}").first()
    return key, buckets, spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path)[2].drop(BUCKET)


def rewrite(spark: SparkSession, path: str, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets in which ``changes`` has keys by ``change(rows of these buckets, changes)``; all other files stay as they are.

    Returns the buckets written, which are at most as many as the table has. New rows are complete on shared storage before the first
    old file goes, and a change that is run again after a failure finds the same buckets; ``change`` has to give the same when applied
    twice for that to be harmless. No key in ``changes`` leaves the table untouched.
    """
    key, buckets, table = _table(spark, path)
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    columns = [c for c in table.columns if c != BUCKET]
    new = change(table.filter(F.col(BUCKET).isin(touched)).drop(BUCKET), changes).select(*columns)
    ready = reuse(new.withColumn(BUCKET, bucket_of(key, buckets)).repartition(len(touched), BUCKET))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def update_claims(spark: SparkSession, path: str, updates: DataFrame, as_of, order_by: str = "update_no") -> list[int]:
    """J8 in place: the claims named in ``updates`` get their new status."""
    return rewrite(spark, path, updates, lambda rows, u: lifecycle.update_from(rows, u, as_of, order_by))


def advance_claims(spark: SparkSession, path: str, results: DataFrame, as_of) -> list[int]:
    """K1 in place: the claims with stored results move on."""
    return rewrite(spark, path, results, lambda rows, r: lifecycle.advance_status(rows, r, as_of))


def upsert_chunks(spark: SparkSession, path: str, new: DataFrame) -> list[int]:
    """K2 in place."""
    return rewrite(spark, path, new, lifecycle.upsert_chunks)


def upsert_retry(spark: SparkSession, path: str, failures: DataFrame) -> list[int]:
    """K3 in place. Counts add up, so a batch of failures must not be applied twice."""
    return rewrite(spark, path, failures, lifecycle.upsert_retry)

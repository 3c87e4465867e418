"""Table storage: parquet folders, or JDBC when a driver jar is on the class path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from claimloom import schemas

TABLES = {
    "claims": schemas.CLAIMS,
    "diagnoses": schemas.DIAGNOSES,
    "procedures": schemas.PROCEDURES,
    "filters": schemas.FILTERS,
    "processed_chunks": schemas.PROCESSED_CHUNKS,
    "retry_queue": schemas.RETRY_QUEUE,
    "validation_results": schemas.VALIDATION_RESULTS,
    "validation_results_archive": schemas.VALIDATION_RESULTS_ARCHIVE,
    "processing_stats": schemas.PROCESSING_STATS,
}
CLEARED = ["procedures", "diagnoses", "processed_chunks", "retry_queue", "claims", "filters"]
TRACKING = ["processed_chunks", "retry_queue"]
BATCH_ROWS = 1000


def read_table(spark: SparkSession, source: str, schema: T.StructType | None = None, **jdbc: str) -> DataFrame:
    """Parquet path, or a table name with JDBC options. Give ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` so a large table is read by many tasks."""
    if "url" in jdbc:
        return spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(source)


def write_results(df: DataFrame, sink: str, mode: str = "append", partition_by: list[str] | None = None, **jdbc: str) -> None:
    """Append results to a parquet folder, or over JDBC in batches of 1000 rows."""
    if "url" in jdbc:
        df.write.format("jdbc").options(dbtable=sink, batchsize=BATCH_ROWS, **jdbc).mode(mode).save()
    else:
        df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(sink)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x string").parquet(path)
    except AnalysisException:
        return False
    return True


def ensure_tables(
    spark: SparkSession, root: str, names: tuple[str, ...] = ("validation_results", "validation_results_archive")
) -> list[str]:
    """Create the missing tables empty; returns the names created."""
    created = [n for n in names if not table_exists(spark, f"{root}/{n}")]
    for name in created:
        empty(spark, name).write.parquet(f"{root}/{name}")
    return created


def clear_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Empty the tables, children before parents; schemas stay."""
    for name in names or CLEARED:
        empty(spark, name).write.mode("overwrite").parquet(f"{root}/{name}")


def reset_tracking(spark: SparkSession, root: str) -> None:
    """Forget processed chunks and the retry queue, so pending claims are processed again."""
    clear_tables(spark, root, TRACKING)


def write_training_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)

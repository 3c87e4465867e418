"""Claims as a stream: read arriving files, drop repeats, validate and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimloom import schemas
from claimloom.operators import metrics
from claimloom.plans.validate import validate_claims


def claims_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 100, **options: str) -> DataFrame:
    """Claims from files as they arrive, limited per batch. ``fmt="kafka"`` passes its options on
    and parses the message value as JSON; it needs the connector on the class path."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schemas.CLAIMS).alias("c")).select("c.*")
    return (
        spark.readStream.schema(schemas.CLAIMS).format(fmt).options(**options)
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def dedupe_stream(stream: DataFrame, key: str = "claim_id", at: str | None = None, keep_for: str | None = None) -> DataFrame:
    """A claim passes once.

    Without ``keep_for`` that holds however late it or its repeats come: state keeps one key per claim and never expires. With it, a key
    goes once the watermark, ``keep_for`` behind the event time ``at``, has passed its first arrival by as much: repeats within ``keep_for`` of the first are dropped,
    and state is bounded by what arrives in that time. A claim that arrives behind the watermark is dropped as late.
    Start either in ``state.state_on_disk``, which keeps the keys on disk instead of the heap.
    """
    if keep_for is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, keep_for).dropDuplicatesWithinWatermark([key])


def validate_stream(
    stream: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    filters: DataFrame,
    code_sets: DataFrame,
    sink: str,
    checkpoint: str,
    **validation,
) -> DataStreamWriter:
    """Writer that validates each micro-batch and stores its results under ``sink``.

    Results of a batch go to their own ``batch_id`` partition, which is overwritten when the
    batch is run again after a failure, so no result is stored twice. Child rows are limited to
    the claims of the batch before they are aggregated.
    """
    staged = stream.withColumn("preprocessed_at", F.current_timestamp())

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        ids = batch.select("claim_id").distinct()
        results = validate_claims(
            batch.drop("preprocessed_at"),
            diagnoses.join(ids, "claim_id", "left_semi"),
            procedures.join(ids, "claim_id", "left_semi"),
            filters, code_sets, **validation,
        )
        stamps = batch.groupBy("claim_id").agg(F.max("preprocessed_at").alias("preprocessed_at"))
        (
            results.join(stamps, "claim_id", "left")
            .withColumns({"postprocessed_at": F.current_timestamp(), "pipeline_stage": F.lit("postprocessing")})
            .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        )
        batch.unpersist()

    return staged.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def rate_stream(events: DataFrame, sink: str, checkpoint: str, ts: str = "ts", failed: str = "failed") -> DataStreamWriter:
    """Writer that stores counts per minute of each micro-batch; ``metrics.rates_of_minutes`` makes windows of them at any time.

    No watermark decides what counts: late events add to their minute, and the last windows are there as soon as their
    minutes are. A batch that is run again overwrites its own partition; use a sink for one checkpoint only.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        metrics.per_minute(batch, ts, failed).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)

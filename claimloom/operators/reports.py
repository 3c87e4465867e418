"""Status, trend and error reports. Time windows always end at an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimloom import schemas
from claimloom.functions.scalars import exact_avg


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _as_of(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def _since(column: str, days: int, as_of) -> Column:
    return F.col(column) >= _as_of(as_of) - F.make_dt_interval(F.lit(days))


def pending_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("processing_status") == "PENDING")


def unprocessed_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("processing_status").isin(schemas.UNPROCESSED))


def claim_counts(claims: DataFrame) -> DataFrame:
    """Pending, unprocessed and training (completed) counts in one pass."""
    status = F.col("processing_status")
    return claims.agg(
        F.count_if(status == "PENDING").alias("pending"),
        F.count_if(status.isin(schemas.UNPROCESSED)).alias("unprocessed"),
        F.count_if(status == "COMPLETED").alias("training"),
    )


def status_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy("processing_status").agg(
        F.count(F.lit(1)).alias("claim_count"),
        exact_avg("total_charge_amount").alias("avg_charge"),
        F.min("service_date").alias("earliest_service"),
        F.max("service_date").alias("latest_service"),
    )


def processing_statistics(claims: DataFrame) -> DataFrame:
    """``status_summary`` with the grand total and the unprocessed count on every row."""
    per_status = status_summary(claims).withColumn("avg_charge", F.coalesce("avg_charge", F.lit(0.0)))
    n = F.col("claim_count")
    everything = Window.partitionBy()  # over one row per status
    return per_status.withColumns({
        "total_claims": F.sum(n).over(everything),
        "unprocessed_count": F.sum(F.when(F.col("processing_status").isin(schemas.UNPROCESSED), n).otherwise(0)).over(everything),
    })


def daily_processing(claims: DataFrame) -> DataFrame:
    return (
        claims.filter(F.col("processed_date").isNotNull())
        .groupBy(F.to_date("processed_date").alias("processing_date"))
        .agg(
            F.count(F.lit(1)).alias("claims_processed"),
            exact_avg("total_charge_amount").alias("avg_charge_amount"),
            F.count_distinct("provider_type").alias("unique_providers"),
        )
        .orderBy(F.desc("processing_date"))
    )


def status_distribution(claims: DataFrame, chunk_size: int = 500) -> DataFrame:
    """Count per status; pending claims also show how many chunks they will take."""
    n = F.col("claim_count")
    return claims.groupBy("processing_status").agg(F.count(F.lit(1)).alias("claim_count")).withColumn(
        "expected_chunks", F.when(F.col("processing_status") == "PENDING", F.ceil(n / chunk_size)).otherwise(F.lit(0))
    )


def chunk_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("status").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("claims_count"), F.lit(0)).alias("total_claims_in_chunks"),
    )


def _validation_measures(avg_of: str = "processing_time") -> list[Column]:
    status = F.col("validation_status")
    total, good = F.count(F.lit(1)), F.count_if(status == "COMPLETED")
    return [
        total.alias("total_validations"),
        good.alias("successful_validations"),
        F.count_if(status == "ERROR").alias("failed_validations"),
        F.coalesce(exact_avg(avg_of), F.lit(0.0)).alias("avg_processing_time"),
        _rate(good, total).alias("success_rate"),
    ]


def validation_statistics(results: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return results.filter(_since("created_date", days, as_of)).agg(
        *_validation_measures(),
        F.min("created_date").alias("earliest_validation"),
        F.max("created_date").alias("latest_validation"),
    )


def validation_trends(results: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    return (
        results.filter(_since("created_date", days, as_of))
        .groupBy(F.to_date("created_date").alias("validation_date"))
        .agg(*_validation_measures())
        .orderBy(F.desc("validation_date"))
    )


def daily_rollup(results: DataFrame) -> DataFrame:
    """One processing_stats row per date; host figures stay null."""
    status = F.col("validation_status")
    return results.groupBy(F.to_date("created_date").alias("processing_date")).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(status == "COMPLETED").alias("successful_validations"),
        F.count_if(status != "COMPLETED").alias("failed_validations"),
        F.count_if(status == "ERROR").alias("error_count"),
        F.coalesce(exact_avg("processing_time"), F.lit(0.0)).alias("avg_processing_time"),
        F.lit(None).cast("double").alias("peak_memory_usage"),
        F.lit(None).cast("double").alias("peak_cpu_usage"),
    )


def processing_report(claims: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Last ``days`` of claims by creation: totals, and seconds from creation to update of the
    completed ones."""
    done = F.col("processing_status") == "COMPLETED"
    seconds = F.unix_timestamp("updated_date") - F.unix_timestamp("created_date")
    return claims.filter(_since("created_date", days, as_of)).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(done).alias("completed_claims"),
        exact_avg(F.when(done, seconds)).alias("avg_processing_seconds"),
        F.max("created_date").alias("latest_claim_date"),
    )


def filter_pass_report(outcomes: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Over per-filter outcome rows (claim_id, passed, processing_time, created_date)."""
    return outcomes.filter(_since("created_date", days, as_of)).agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if("passed").alias("passed_validations"),
        F.coalesce(exact_avg("processing_time"), F.lit(0.0)).alias("avg_validation_time"),
        F.count_distinct("claim_id").alias("unique_claims_validated"),
    )


def label_distribution(examples: DataFrame, label: str = "label") -> DataFrame:
    return examples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def recent_errors(results: DataFrame, n: int = 100) -> DataFrame:
    """Newest ERROR results that carry a message."""
    return (
        results.filter((F.col("validation_status") == "ERROR") & (F.col("error_message") != ""))
        .orderBy(F.desc("created_date"), F.desc("result_id"))
        .limit(n)
        .select("result_id", "claim_id", "error_message", "created_date", "processing_time")
    )


def explode_results(results: DataFrame) -> DataFrame:
    """One row per (claim, filter) of stored results; claims without outcomes keep one row."""
    keep = [c for c in results.columns if c not in ("validation_results", "predicted_filters")]
    return results.select(*keep, F.explode_outer("validation_results").alias("o")).select(*keep, "o.*")

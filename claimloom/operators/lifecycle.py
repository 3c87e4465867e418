"""Status changes, upserts, archive and purge. Tables are immutable here: every function
returns the new content, to be written to a new location and swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimloom.operators.numbering import number_rows


def _stamp(as_of, like: DataFrame, column: str) -> Column:
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(like.schema[column].dataType)


def update_from(claims: DataFrame, updates: DataFrame, as_of, order_by: str = "update_no") -> DataFrame:
    """Set the status of claims named in ``updates`` (claim_id, new_status, order column) and
    stamp them; of several updates for a claim the last one counts; unknown ids do nothing."""
    last = updates.groupBy("claim_id").agg(F.max_by("new_status", order_by).alias("_new_status"))
    hit = F.col("_new_status").isNotNull()
    return claims.join(last, "claim_id", "left").withColumns({
        "processing_status": F.coalesce("_new_status", "processing_status"),
        "processed_date": F.when(hit, _stamp(as_of, claims, "processed_date")).otherwise(F.col("processed_date")),
    }).drop("_new_status")


def mark_processed(claims: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """COMPLETED and stamped for the claims in ``ids`` that are not COMPLETED yet."""
    wanted = ids.select("claim_id").distinct().withColumn("_hit", F.lit(True))
    change = F.coalesce("_hit", F.lit(False)) & (F.col("processing_status") != "COMPLETED")
    return claims.join(wanted, "claim_id", "left").withColumn("_change", change).withColumns({
        "processing_status": F.when(F.col("_change"), "COMPLETED").otherwise(F.col("processing_status")),
        "processed_date": F.when(F.col("_change"), _stamp(as_of, claims, "processed_date")).otherwise(F.col("processed_date")),
    }).drop("_hit", "_change")


def mark_processed_count(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """How many claims ``mark_processed`` changes."""
    return (
        claims.filter(F.col("processing_status") != "COMPLETED")
        .join(ids.select("claim_id"), "claim_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("updated"))
    )


def advance_status(claims: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """After validation: the newest stored result of a claim that is not COMPLETED moves it to
    COMPLETED, or to RETRY when that result is an ERROR."""
    newest = results.groupBy("claim_id").agg(
        F.max_by("validation_status", F.struct("created_date", "result_id")).alias("_outcome")
    )
    change = F.col("_outcome").isNotNull() & (F.col("processing_status") != "COMPLETED")
    moved = F.when(F.col("_outcome") == "COMPLETED", "COMPLETED").otherwise("RETRY")
    return claims.join(newest, "claim_id", "left").withColumn("_change", change).withColumns({
        "processing_status": F.when(F.col("_change"), moved).otherwise(F.col("processing_status")),
        "processed_date": F.when(F.col("_change") & (F.col("_outcome") == "COMPLETED"), _stamp(as_of, claims, "processed_date"))
        .otherwise(F.col("processed_date")),
    }).drop("_outcome", "_change")


def upsert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace chunk rows by id as COMPLETED; the newest row of a batch counts."""
    columns = ["chunk_id", "status", "processed_date", "claims_count", "processing_duration_seconds"]
    last = new.groupBy("chunk_id").agg(
        F.max(F.struct("processed_date", "claims_count", "processing_duration_seconds")).alias("r")
    ).select("chunk_id", F.lit("COMPLETED").alias("status"), "r.*")
    return (
        existing.select(*columns).join(last, "chunk_id", "left_anti").select(*columns)
        .unionByName(last.select(*columns))
    )


def upsert_daily(existing: DataFrame, new: DataFrame, key: str = "processing_date") -> DataFrame:
    """Replace the rows of the dates in ``new``, keep the others."""
    return existing.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def upsert_retry(existing: DataFrame, failures: DataFrame) -> DataFrame:
    """Fold failure events (chunk_id, error_message, failed_at, event_id) into the retry queue.

    The first failure of a chunk sets count 1; each further one adds 1, replaces the message
    and stamps ``last_retry_date``. Events are pre-aggregated per chunk before the join.
    """
    batch = failures.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("error_message", F.struct("failed_at", "event_id")).alias("new_message"),
        F.min("failed_at").alias("first_at"),
        F.max("failed_at").alias("last_at"),
    )
    queue = existing.withColumnsRenamed({"error_message": "old_message", "created_date": "old_created",
                                         "last_retry_date": "old_last", "retry_count": "old_count", "resolved": "old_resolved"})
    known = F.col("old_count").isNotNull()
    return queue.join(batch, "chunk_id", "full").select(
        "chunk_id",
        F.when(F.col("n").isNotNull(), F.col("new_message")).otherwise(F.col("old_message")).alias("error_message"),
        (F.coalesce("old_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("retry_count"),
        F.coalesce("old_resolved", F.lit(False)).alias("resolved"),
        F.coalesce("old_created", "first_at").alias("created_date"),
        F.when(F.col("n").isNotNull() & (known | (F.col("n") > 1)), F.col("last_at")).otherwise(F.col("old_last")).alias("last_retry_date"),
    )


def retry_candidates(queue: DataFrame, max_retries: int = 3) -> DataFrame:
    return (
        queue.filter((F.col("retry_count") < max_retries) & ~F.col("resolved"))
        .select("chunk_id", "error_message", "retry_count", "created_date")
        .orderBy("created_date", "chunk_id")
    )


def retry_failed(queue: DataFrame, max_retries: int = 3) -> DataFrame:
    """What happens next to each unresolved unit: RETRY below the limit, ERROR at it."""
    return queue.filter(~F.col("resolved")).withColumn(
        "next_status", F.when(F.col("retry_count") >= max_retries, "ERROR").otherwise("RETRY")
    )


def _old(days: int, as_of) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.coalesce(F.col("created_date") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def archive_old(results: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Rows older than the cutoff, with the archive stamp."""
    return results.filter(_old(days, as_of)).withColumn("archived_date", _stamp(as_of, results, "created_date"))


def purge_old(results: DataFrame, as_of, days: int = 90) -> DataFrame:
    """The rows that ``archive_old`` leaves."""
    return results.filter(~_old(days, as_of))


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def dedupe(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(keys) if keys else df.distinct()


def not_exists(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``existing``."""
    return new.join(existing.select(key), key, "left_anti")


def _first_of_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("r")).select(key, "r.*")


def insert_claims(existing: DataFrame, new: DataFrame, order_by: list[str]) -> DataFrame:
    """Add claims whose id is new; of repeated ids in the batch the first by ``order_by`` counts;
    a missing status becomes PENDING. ``order_by`` columns that claims lack are dropped."""
    fresh = _first_of_key(new.filter(F.col("claim_id").isNotNull()), "claim_id", order_by)
    fresh = not_exists(fresh, existing, "claim_id").withColumn(
        "processing_status", F.coalesce("processing_status", F.lit("PENDING"))
    )
    shared = [c for c in existing.columns if c in fresh.columns]
    return existing.unionByName(fresh.select(*shared), allowMissingColumns=True)


def _with_ids(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    top = existing.agg(F.coalesce(F.max("filter_id"), F.lit(0))).scalar()
    return number_rows(fresh.drop("filter_id"), ["filter_name"], "_n").withColumn(
        "filter_id", (top + F.col("_n")).cast("int")).drop("_n")


def insert_filters(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add filters whose name is new, active, with ids after the highest one in name order."""
    fresh = _first_of_key(new.withColumn("active", F.lit(True)), "filter_name", ["rule_definition"])
    fresh = _with_ids(existing, not_exists(fresh, existing, "filter_name"))
    shared = [c for c in existing.columns if c in fresh.columns]
    return existing.unionByName(fresh.select(*shared), allowMissingColumns=True)


def replace_rules(filters: DataFrame, mined: DataFrame) -> DataFrame:
    """Drop the ASSOCIATION rules and add the mined ones with ids after the highest kept id."""
    kept = filters.filter(F.coalesce(F.col("rule_type") != "ASSOCIATION", F.lit(True)))
    fresh = _with_ids(kept, mined)
    shared = [c for c in filters.columns if c in fresh.columns]
    return kept.unionByName(fresh.select(*shared), allowMissingColumns=True)


def normalize_results(results: DataFrame, run_at) -> DataFrame:
    """Sink form of results: defaults filled in, arrays as JSON text."""
    def text(name: str) -> Column:
        return F.coalesce(F.to_json(name), F.lit("[]"))

    return results.select(
        "claim_id",
        F.coalesce("validation_status", F.lit("COMPLETED")).alias("validation_status"),
        text("predicted_filters").alias("predicted_filters"),
        text("validation_results").alias("validation_details"),
        F.coalesce("processing_time", F.lit(0)).cast("decimal(10,6)").alias("processing_time"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        (run_at if isinstance(run_at, Column) else F.lit(run_at)).alias("created_date"),
    )

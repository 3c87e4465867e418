"""Top-k selections per claim and bounded look-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimloom.functions.scalars import exact_avg


def top_filters(scores: Column, threshold: float = 0.3, k: int = 10) -> Column:
    """Filter ids of an ``array<struct<filter_id, prob>>``: above the threshold, best first,
    ties in class order, at most ``k``. Class 0 means "no filter" and is never returned."""
    kept = F.filter(scores, lambda s: (s["prob"] > threshold) & (s["filter_id"] != 0))
    ranked = F.array_sort(F.transform(
        kept,
        lambda s, i: F.struct((-s["prob"]).alias("minus_prob"), i.alias("pos"), s["filter_id"].alias("filter_id")),
    ))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["filter_id"])


def top_filter_rows(scores: DataFrame, threshold: float = 0.3, k: int = 10) -> DataFrame:
    """Row form over (claim_id, filter_id, prob); adds the rank. The rank limit is applied
    before the shuffle as well as after it."""
    best = Window.partitionBy("claim_id").orderBy(F.desc("prob"), F.asc("filter_id"))
    return (
        scores.filter((F.col("prob") > threshold) & (F.col("filter_id") != 0))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def principal_rank(diagnoses: DataFrame, top: int | None = 1) -> DataFrame:
    """Coded diagnosis lines of each claim with their rank: principal first, then lowest sequence
    (missing counts as 999); the first ``top``, or all if it is None. The rank limit also runs before the shuffle."""
    principal = F.coalesce("is_principal", F.lit(False))
    order = Window.partitionBy("claim_id").orderBy(
        F.desc(principal),
        F.when(principal, 0).otherwise(F.coalesce("diagnosis_sequence", F.lit(999))),
        "diagnosis_code", "diagnosis_type", "diagnosis_sequence", "description",
    )
    ranked = diagnoses.filter(F.col("diagnosis_code").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def recent_avg_time(results: DataFrame, n: int = 1000) -> DataFrame:
    """Mean processing time of the newest ``n`` results."""
    newest = results.orderBy(F.desc("created_date"), F.desc("result_id")).limit(n)
    return newest.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.coalesce(exact_avg("processing_time"), F.lit(0.0)).alias("avg_processing_time"),
    )

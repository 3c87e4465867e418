"""A validation run: measures -> features -> predicted filters -> rule outcomes -> results."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.operators import enrich, features, learning, lifecycle, rules
from claimloom.operators.rules import TooManyRules
from claimloom.sizing import reuse

# A run looks at a few filters per claim; with more rules than this it pays to join only those.
COMPILED_IN_RUN = 32


def predicted_by_model(
    measured: DataFrame, encoders: StringIndexerModel | None, model: PipelineModel | None,
    threshold: float = 0.3, k: int = 10,
) -> DataFrame:
    """(claim_id, predicted_filters) of measured claims."""
    rows = measured.select("claim_id", *features.NUMBERS, *features.CATEGORIES)
    if model is None or encoders is None:
        return learning.predict_filters(None, rows.select("claim_id"))
    return learning.predict_filters(model, features.feature_columns(encoders, rows), threshold, k).select(
        "claim_id", "predicted_filters")


def validate_claims(
    claims: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    filters: DataFrame,
    code_sets: DataFrame,
    encoders: StringIndexerModel | None = None,
    model: PipelineModel | None = None,
    candidates: DataFrame | None = None,
    threshold: float = 0.3,
    k: int = 10,
    processing_time: Column | None = None,
) -> DataFrame:
    """One result row per claim: claim_id, predicted_filters, validation_results,
    processing_time, validation_status, error_message.

    Filters come from ``candidates`` (claim_id, predicted_filters) when given, else from the
    model. Rule sets small enough for a plan are evaluated in the same pass; larger ones are
    joined. A claim that cannot be identified becomes an ERROR result.
    """
    return validate_measured(
        enrich.claim_measures(claims, diagnoses, procedures), filters, code_sets, encoders, model, candidates, threshold, k, processing_time)


def validate_measured(
    measured: DataFrame,
    filters: DataFrame,
    code_sets: DataFrame,
    encoders: StringIndexerModel | None = None,
    model: PipelineModel | None = None,
    candidates: DataFrame | None = None,
    threshold: float = 0.3,
    k: int = 10,
    processing_time: Column | None = None,
) -> DataFrame:
    """``validate_claims`` of claims that have the columns of ``claim_measures``."""
    none = F.array().cast("array<int>")
    if candidates is not None:
        measured = measured.join(candidates.select("claim_id", "predicted_filters"), "claim_id", "left")
    elif model is not None and encoders is not None:
        names = [c for c in measured.columns if c not in features.NUMBERS]
        raw = F.struct(*features.NUMBERS)
        kept = measured.withColumn("_raw", raw)
        scored = learning.predict_filters(model, features.feature_columns(encoders, kept), threshold, k)
        measured = scored.select(*names, "_raw.*", "predicted_filters")
    else:
        measured = measured.withColumn("predicted_filters", none)
    measured = measured.withColumn("predicted_filters", F.coalesce("predicted_filters", none))
    try:
        compiled = rules.compile_rules(filters, code_sets, COMPILED_IN_RUN)
        evaluated = measured.withColumn("validation_results", rules.rule_outcomes(compiled, F.col("predicted_filters")))
    except TooManyRules:
        evaluated = _by_joins(measured, rules.RuleTables(filters, code_sets))
    bad = F.col("claim_id").isNull()
    return evaluated.select(
        "claim_id",
        "predicted_filters",
        "validation_results",
        (processing_time if processing_time is not None else F.lit(0)).cast("decimal(10,6)").alias("processing_time"),
        F.when(bad, "ERROR").otherwise("COMPLETED").alias("validation_status"),
        F.when(bad, "claim without id").otherwise("").alias("error_message"),
    )


def _by_joins(measured: DataFrame, tables: rules.RuleTables) -> DataFrame:
    """Outcome arrays in prediction order through the joined form. Rows are told apart by a number of their own, written before
    it is used, so that repeated and missing claim ids get what each row asked for."""
    measured = reuse(measured.withColumn("_row", F.monotonically_increasing_id()))
    wanted = measured.select("*", F.posexplode("predicted_filters").alias("pos", "filter_id"))
    outcomes = rules.evaluate_coded(wanted, tables, "_row", "pos")
    per_row = outcomes.groupBy("_row").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "filter_id", "filter_name", "passed", "rule_type", "details", "error"))),
            lambda o: o.dropFields("pos"),
        ).alias("validation_results")
    )
    empty = F.array().cast(per_row.schema["validation_results"].dataType)
    return measured.join(per_row, "_row", "left").withColumn(
        "validation_results", F.coalesce("validation_results", empty))


def close_run(claims: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """Claims after the stored results of a run were applied."""
    return lifecycle.advance_status(claims, stored, as_of)

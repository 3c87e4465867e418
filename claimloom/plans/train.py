"""Training from stored claims and results to a saved predictor and its report."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, functions as F

from claimloom.operators import enrich, features, learning
from claimloom.operators.smote import smote
from claimloom.sizing import reuse


def training_examples(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, results: DataFrame) -> DataFrame:
    """Labelled rows before encoding: claim columns, counts and ``label``."""
    rows = enrich.training_set(claims, diagnoses, procedures, results)
    return features.valid_labels(features.label_examples(features.with_counts(rows)))


def train(
    claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, results: DataFrame,
    balance: bool = True, seed: int = 42, **tree_options,
) -> tuple[StringIndexerModel, PipelineModel, DataFrame]:
    """Encoders, fitted predictor, and the held-out rows with ``label``, ``predicted`` and
    ``probabilities``."""
    examples = training_examples(claims, diagnoses, procedures, results)
    # Every completed claim gives an example, so its categories are those of the examples.
    encoders = features.fit_encoders(claims.filter(F.col("processing_status") == "COMPLETED"))
    encoded = reuse(features.feature_columns(encoders, examples).select("claim_id", "example", "label", *features.FEATURES))
    split = reuse(learning.stratified_split(encoded, ["claim_id", "example"], 0.2, seed))
    train_rows = split.filter(~F.col("is_test"))
    if balance:
        train_rows = smote(train_rows, features.FEATURES, seed=seed)
    model = learning.train_predictor(reuse(train_rows), seed=seed, **tree_options)
    return encoders, model, learning.score(model, split.filter("is_test"))


def training_report(held_out: DataFrame, model: PipelineModel) -> DataFrame:
    """Classification report of the held-out rows with the weighted AUC on every row."""
    report = learning.classification_report(held_out, prediction="predicted")
    ids = learning.class_ids(model)
    long = held_out.select("label", F.explode(learning.scored_classes(model)).alias("s")).select(
        "label", F.col("s.filter_id").alias("class"), F.col("s.prob").alias("prob"))
    if len(ids) == 2:
        long = long.filter(F.col("class") == ids[1])
    return report.withColumn("auc", learning.roc_auc_weighted(learning.roc_auc_ovr(long)).scalar())

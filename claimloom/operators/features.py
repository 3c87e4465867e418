"""Model features: category codes and the feature matrix."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

CATEGORIES = ["provider_type", "place_of_service"]
NUMBERS = ["patient_age", "total_charge_amount", "diagnosis_count", "procedure_count"]
FEATURES = NUMBERS + [f"{c}_encoded" for c in CATEGORIES]
UNKNOWN = "UNKNOWN"


def _known(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def fit_encoders(fit_df: DataFrame, columns: list[str] | None = None) -> StringIndexerModel:
    """Codes 0.. in alphabetical order of the distinct values; null counts as UNKNOWN."""
    columns = columns or CATEGORIES
    source = fit_df.select(*[_known(c).alias(f"_{c}_known") for c in columns])
    return StringIndexer(
        inputCols=[f"_{c}_known" for c in columns], outputCols=[f"{c}_encoded" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(source)


def encode_categories(encoders: StringIndexerModel, df: DataFrame) -> DataFrame:
    """Add ``<column>_encoded`` doubles; values unseen in the fit give -1."""
    names = [c[1:-len("_known")] for c in encoders.getInputCols()]
    out = encoders.transform(df.withColumns({f"_{c}_known": _known(c) for c in names}))
    return out.withColumns({
        f"{c}_encoded": F.when(F.col(f"{c}_encoded") == len(labels), -1.0).otherwise(F.col(f"{c}_encoded"))
        for c, labels in zip(names, encoders.labelsArray)
    }).drop(*[f"_{c}_known" for c in names])


def feature_columns(encoders: StringIndexerModel, claims: DataFrame) -> DataFrame:
    """The six features as doubles next to the other columns; null numbers count as 0."""
    return encode_categories(encoders, claims).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMBERS}
    )


def feature_matrix(encoders: StringIndexerModel, claims: DataFrame) -> DataFrame:
    """``feature_columns`` with the assembled ``features`` vector."""
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(feature_columns(encoders, claims))


def label_examples(training: DataFrame) -> DataFrame:
    """One example per applied filter id above 0, and always one with label 0. ``example`` tells
    the examples of a claim apart; those it cannot are equal in every column."""
    applied = F.coalesce("applied_filters", F.array().cast("array<int>"))
    labels = F.concat(F.filter(applied, lambda x: x > 0), F.array(F.lit(0)))
    return (
        training.select("*", F.posexplode(labels).alias("_pos", "label"))
        .withColumn("example", F.xxhash64(applied, "_pos"))
        .drop("applied_filters", "_pos")
    )


def with_counts(training: DataFrame) -> DataFrame:
    """Counts of the distinct code arrays of a training row."""
    return training.withColumns({
        "diagnosis_count": F.size("diagnoses"), "procedure_count": F.size("procedures"),
    }).drop("diagnoses", "procedures")


def valid_labels(examples: DataFrame) -> DataFrame:
    return examples.filter(F.col("label") >= 0)

"""Split, train, predict and measure the filter predictor."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from claimloom.operators.boosting import SoftmaxTrees
from claimloom.operators.features import FEATURES
from claimloom.operators.numbering import number_rows, running_totals
from claimloom.operators.ranking import top_filters
from claimloom.sizing import broadcast_small, reuse


def require_classes(examples: DataFrame, label: str = "label") -> list[int]:
    """Sorted class ids; at least two are needed."""
    classes = sorted(r[0] for r in examples.select(label).distinct().collect())
    if len(classes) < 2:
        raise ValueError(f"need at least 2 classes, found {classes}")
    return classes


def stratified_split(
    examples: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42, label: str = "label"
) -> DataFrame:
    """Add ``is_test``: per class, the rounded share of rows with the smallest key hashes.

    ``key`` and the label identify a row. Rows are numbered inside hash ranges, so a class may
    hold most of the data.
    """
    hashed = examples.withColumn("_h", F.xxhash64(*key, label, F.lit(seed)))
    numbered = number_rows(hashed, ["_h", *key], "_n", [label], F.shiftright("_h", 54))
    sizes = examples.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return (
        numbered.join(broadcast_small(sizes), label)
        .withColumn("is_test", F.col("_n") <= F.round(F.col("_size") * test_share))
        .drop("_h", "_n", "_size")
    )


def train_predictor(
    train: DataFrame,
    features: list[str] | None = None,
    label: str = "label",
    trees: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
    held: str | None = None,
    patience: int | None = None,
) -> PipelineModel:
    """Boosted trees: Spark's own for two classes, softmax boosting for more (Spark's are binary).
    Labels are indexed for the fit and mapped back, so filter ids may be any integers. With more than two classes,
    rows where the column ``held`` is true are measured after every round, and ``patience`` may end the fit by them."""
    features = features or FEATURES
    classes = require_classes(train, label)
    labels = StringIndexer(inputCol="label_text", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    fitted_labels = labels.fit(train.select(F.col(label).cast("string").alias("label_text")))
    common = dict(labelCol="label_index", featuresCol="features", seed=seed)
    if len(classes) == 2:
        tree = GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=row_share, featureSubsetStrategy=str(column_share), **common)
    else:
        options = dict(trees=trees, depth=depth, rate=rate, row_share=row_share, column_share=column_share, patience=patience)
        tree = SoftmaxTrees(options=json.dumps(options), heldCol=held or "", **common)
    data = train.withColumn("label_text", F.col(label).cast("string"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        fitted_labels,
        tree,
        IndexToString(inputCol="prediction", outputCol="predicted_text", labels=fitted_labels.labels),
    ]).fit(data)


def class_ids(model: PipelineModel) -> list[int]:
    """Filter ids in the order of the model's probability vector."""
    return [int(x) for x in model.stages[-1].getLabels()]


def score(model: PipelineModel, featured: DataFrame) -> DataFrame:
    """Add ``probabilities`` (array in class order) and ``predicted`` (id of the best class)."""
    given = featured if "label_text" in featured.columns else featured.withColumn("label_text", F.lit("0"))
    out = model.transform(given)
    drop = ["label_text", "label_index", "rawPrediction", "prediction", "predicted_text", "probability", "features"]
    return out.withColumns({
        "probabilities": F.slice(vector_to_array("probability"), 1, len(class_ids(model))),
        "predicted": F.col("predicted_text").try_cast("int"),
    }).drop(*drop)


def scored_classes(model: PipelineModel) -> Column:
    """``array<struct<filter_id, prob>>`` from the ``probabilities`` column."""
    return F.transform(
        F.arrays_zip(F.array(*map(F.lit, class_ids(model))).alias("filter_id"), F.col("probabilities").alias("prob")),
        lambda s: F.struct(s["filter_id"].alias("filter_id"), s["prob"].alias("prob")),
    )


def predict_filters(model: PipelineModel | None, featured: DataFrame, threshold: float = 0.3, k: int = 10) -> DataFrame:
    """Add ``predicted_filters``; every claim gets an empty list when there is no model."""
    if model is None:
        return featured.withColumn("predicted_filters", F.array().cast("array<int>"))
    return score(model, featured).withColumn(
        "predicted_filters", top_filters(scored_classes(model), threshold, k)
    ).drop("probabilities", "predicted")


def _is_saved(path: str) -> bool:
    """Whether a model is saved there; any failure other than a missing path is an error."""
    try:
        SparkSession.active().read.text(f"{path}/metadata")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def save_model(model: PipelineModel, path: str) -> None:
    """Save, keeping the version that was there before under ``<path>.backup``."""
    if _is_saved(path):
        PipelineModel.load(path).write().overwrite().save(path + ".backup")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_predictor(spark: SparkSession, encoders: StringIndexerModel, model: PipelineModel, path: str) -> str:
    """Save encoders, predictor, feature names and classes together as a new version and return its name.

    The version counts once its name is appended to ``<path>/saved``, which happens last; earlier versions stay as they are.
    """
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    encoders.write().save(f"{folder}/encoders")
    model.write().save(f"{folder}/model")
    model_metadata(spark, model).write.parquet(f"{folder}/metadata")
    spark.createDataFrame([(version,)], "version string").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode(
        "append").parquet(f"{path}/saved")
    return version


def load_predictor(spark: SparkSession, path: str, version: str | None = None) -> tuple[StringIndexerModel, PipelineModel, Row]:
    """Encoders, predictor and metadata (features, classes) of a version, the one saved last if none is named."""
    if version is None:
        version = spark.read.parquet(f"{path}/saved").orderBy(F.desc("saved_at"), "version").first().version
    folder = f"{path}/versions/{version}"
    metadata = spark.read.parquet(f"{folder}/metadata").first()
    return StringIndexerModel.load(f"{folder}/encoders"), PipelineModel.load(f"{folder}/model"), metadata


def model_metadata(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row: feature names and class ids."""
    return spark.createDataFrame(
        [(list(model.stages[0].getInputCols()), class_ids(model))], "features array<string>, classes array<int>"
    )


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages.

    The rows are folded to a confusion matrix first; all else works on that.
    """
    matrix = reuse(
        predictions.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    sides = matrix.select(
        F.explode(F.array(
            F.struct(F.col("l").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                     F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    scored = per_class.select(
        F.col("c").cast("string").alias("class"),
        ratio(F.col("hit"), F.col("guessed")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"),
        "support", "hit",
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"),
                     *[(F.sum("hit") / total).alias(m) for m in measures], total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in measures], total.alias("support")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return scored.drop("hit").unionByName(averages)


def roc_auc_ovr(scores: DataFrame, class_col: str = "class", prob: str = "prob", label: str = "label") -> DataFrame:
    """(class, support, auc) from long rows (class, prob, label): AUC by average ranks, null when
    a class has no positive or no negative rows.

    Rows fold to counts per distinct score, then running totals of negatives give the ranks.
    """
    hit = F.col(label) == F.col(class_col)
    folded = reuse(scores.groupBy(F.col(class_col).alias("class"), F.col(prob).alias("prob")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    ))
    ranked = running_totals(folded, {"neg_upto": F.col("neg")}, ["prob"], ["class"])
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    pos, neg = F.sum("pos"), F.sum("neg")
    return ranked.groupBy("class").agg(
        pos.alias("support"),
        F.when((pos > 0) & (neg > 0), F.sum(wins) / (pos.cast("double") * neg)).alias("auc"),
    )


def roc_auc_weighted(per_class: DataFrame) -> DataFrame:
    """One row from the rows of ``roc_auc_ovr``: support-weighted mean of the AUCs; null when any
    is not computable. For two classes pass the row of the positive class only."""
    return per_class.agg(
        F.when(F.count_if(F.col("auc").isNull()) == 0, F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc")
    )


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance), most important first."""
    names, tree = model.stages[0].getInputCols(), model.stages[-2]
    weights = tree.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, weights)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )

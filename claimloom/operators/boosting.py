"""Boosted trees for any number of classes: second-order softmax boosting over binned features.

Rows stay in Spark, thousands to a block, which is one row of arrays, so that a pass costs no more than the arithmetic. A level of all trees of a round is one aggregation of gradient sums by class, node, feature and bin; the driver sees
these sums only and picks the splits. Gradients are whole multiples of 2^-30, so sums are exact and do not depend on how rows are dealt.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.sizing import reuse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 30)
# Sums of one pass; with more classes a level takes several passes.
CELLS = 2_000_000
# Margins are written anew after so many rounds; in between tasks add the trees since then.
ROUNDS_KEPT = 4
LOSS = -1  # the cell of losses


class Forest:
    """Trees of equal depth in arrays (round, class, node); the children of node i are 2 i + 1 and 2 i + 2. ``feature`` is -1 in a leaf;
    a row goes left if its feature is below ``cut``, that is if its bin is at most ``bin``."""

    def __init__(self, rounds: int, classes: int, depth: int):
        shape = rounds, classes, (2 << depth) - 1
        self.depth = depth
        self.feature = np.full(shape, -1, dtype=np.int32)
        self.bin = np.zeros(shape, dtype=np.int32)
        self.cut, self.value, self.gain, self.g, self.h = (np.zeros(shape) for _ in range(5))

    NAMES = "feature", "bin", "cut", "value", "gain", "g", "h"

    def part(self, start: int, end: int) -> Forest:
        out = Forest(0, 0, self.depth)
        for name in self.NAMES:
            setattr(out, name, getattr(self, name)[start:end])
        return out

    def to_json(self) -> str:
        return json.dumps({"depth": self.depth, **{n: getattr(self, n).tolist() for n in self.NAMES}})

    @staticmethod
    def from_json(text: str) -> Forest:
        given = json.loads(text)
        out = Forest(0, 0, given["depth"])
        for name in Forest.NAMES:
            setattr(out, name, np.array(given[name], dtype=getattr(out, name).dtype))
        return out

    def nodes(self, x: np.ndarray, t: int, k: int, levels: int, binned: bool) -> np.ndarray:
        """Where each row of ``x`` (features or bins) stands after so many levels."""
        feature, cut = self.feature[t, k], self.bin[t, k] if binned else self.cut[t, k]
        own, used = np.arange(len(feature)), np.maximum(feature, 0)
        leaf = feature < 0
        after = np.stack([np.where(leaf, own, 2 * own + 1), np.where(leaf, own, 2 * own + 2)], axis=1).ravel()
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(levels):
            value, limit = flat[start + used[at]], cut[at]
            at = after[2 * at + ((value > limit) if binned else ~(value < limit))]
        return at

    def margins(self, x: np.ndarray, binned: bool, before: np.ndarray | None = None) -> np.ndarray:
        """``before`` (zeros) with the values of all trees added, one round after the other."""
        out = np.zeros((len(x), self.feature.shape[1])) if before is None else before.copy()
        for t in range(self.feature.shape[0]):
            for k in range(self.feature.shape[1]):
                out[:, k] += self.value[t, k][self.nodes(x, t, k, self.depth, binned)]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _draw(row: np.ndarray, seed: int, t: int) -> np.ndarray:
    """A number from 0 to 1 per row and round."""
    x = row.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + t * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


BLOCK = "row binary, y binary, held binary, bins binary, margins binary"


def _block(*parts: np.ndarray) -> pa.RecordBatch:
    """Row numbers, labels, whether a row is for evaluation, bins and margins of many rows as one row."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], ["row", "y", "held", "bins", "margins"])


def _blocks(batches: Iterator[pa.RecordBatch], features: int, classes: int):
    """The arrays of each block."""
    kinds = np.int64, np.int32, np.bool_, np.uint16, np.float64
    for batch in batches:
        for i in range(len(batch)):
            row, label, held, bins, margins = (np.frombuffer(column[i].as_buffer(), dtype=kind) for column, kind in zip(batch.columns, kinds))
            yield row, label, held, bins.reshape(len(row), features), margins.reshape(len(row), classes)


def _histogram(since: Forest, now: Forest, level: int, wanted: dict[int, list[int]], features: int, classes: int, width: int, draw: tuple, losses: bool):
    """Sums of gradients per class of ``wanted``, feature of those it lists, node of this level and bin; the first pass of a round adds the losses."""
    first, count = (1 << level) - 1, 1 << level
    seed, t, share = draw

    def task(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros((2, len(wanted), features, count * width), dtype=np.int64)
        lost = np.zeros((2, 3))
        for row, label, held, bins, margins in _blocks(batches, features, classes):
            used = ~held & (_draw(row, seed, t) < share)
            if not losses:
                label, bins, margins = label[used], bins[used], margins[used]
            p = softmax(since.margins(bins, True, margins))
            if losses:
                own = -np.log(np.maximum(p[np.arange(len(p)), label], 1e-15))
                for side in (0, 1):
                    of = held == bool(side)
                    lost[side] += own[of].sum(), (p.argmax(axis=1) != label)[of].sum(), of.sum()
                p, label, bins = p[used], label[used], bins[used]
            for i, (k, columns) in enumerate(wanted.items()):
                node = now.nodes(bins, 0, k, level, True)
                going = np.flatnonzero(node >= first)
                g = np.rint((p[going, k] - (label[going] == k)) * UNIT)
                h = np.rint(np.maximum(2 * p[going, k] * (1 - p[going, k]), 1e-16) * UNIT)
                base = (node[going] - first) * width
                for f in columns:
                    cell = base + bins[going, f]
                    sums[0, i, f] += np.bincount(cell, g, count * width).astype(np.int64)
                    sums[1, i, f] += np.bincount(cell, h, count * width).astype(np.int64)
        used = np.flatnonzero(sums.any(axis=0).ravel())
        g, h = sums.reshape(2, -1)[:, used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(g), pa.array(h), pa.array(np.zeros(len(used)))], ["cell", "g", "h", "loss"])
        if losses:
            cells = [LOSS - s for s in (0, 1)]
            whole = lost.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(whole[:, 1]), pa.array(whole[:, 2]), pa.array(lost[:, 0])], ["cell", "g", "h", "loss"])

    return task


def _advance(since: Forest, features: int, classes: int):
    """Blocks with the margins of the trees ``since`` added."""

    def task(batches: Iterator[pa.RecordBatch]):
        for row, label, held, bins, margins in _blocks(batches, features, classes):
            yield _block(row, label, held, bins, since.margins(bins, True, margins))

    return task


def feature_cuts(rows: DataFrame, features: list[str], most: int, error: float = 1e-3) -> list[np.ndarray]:
    """Per feature the ascending values that divide it into at most ``most`` bins: a value is in the bin of as many cuts as it reaches.

    A feature of few values is cut at every value but the smallest, others at approximate quantiles.
    """
    out = []
    quantiles = [i / most for i in range(1, most)]
    for f in features:
        seen = sorted(r[0] for r in rows.select(f).distinct().limit(most + 1).collect() if r[0] is not None)
        out.append(np.array(seen[1:] if len(seen) <= most else sorted(set(rows.approxQuantile(f, quantiles, error))), dtype=np.float64))
    return out


def best_split(g: np.ndarray, h: np.ndarray, columns: list[int], bins: list[int], calm: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of one node from its sums (features x bins); a gain of 0 means none. Of equal gains the
    first feature's, then the first bin's."""
    best = (0.0, -1, 0)
    for f in columns:
        total_g, total_h = g[f].sum(), h[f].sum()
        left_g, left_h = np.cumsum(g[f])[: bins[f] - 1], np.cumsum(h[f])[: bins[f] - 1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = 0.5 * (left_g**2 / (left_h + calm) + right_g**2 / (right_h + calm) - total_g**2 / (total_h + calm))
        gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
        if len(gain) and gain.max() > best[0] + 1e-9:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


def fit_trees(
    rows: DataFrame, features: list[str], label: str, classes: int, trees: int = 300, depth: int = 6, rate: float = 0.1, row_share: float = 0.8,
    column_share: float = 0.8, calm: float = 1.0, least: float = 1.0, most_bins: int = 256, seed: int = 42, held: str | None = None, patience: int | None = None,
) -> tuple[Forest, list[tuple[int, str, float, float]]]:
    """The trees, and per round (number of rounds done, part, log loss, share of errors) for the parts ``train`` and ``eval``.

    ``label`` holds 0 .. classes - 1; null features count as 0. Rows where the boolean column ``held`` is true are only measured. With ``patience`` the
    fit ends when the log loss of these has not fallen for so many rounds, and keeps the rounds up to the lowest. ``calm`` is added to every
    sum of second derivatives, and a child needs ``least`` of it. Per round and class, ``row_share`` of the rows and ``column_share`` of the features
    are used. An empty table has no trees to fit and is an error.
    """
    spark = rows.sparkSession
    values = rows.select(F.col(label).cast("int").alias("y"), (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"),
                         *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    values = reuse(values.withColumn("row", F.monotonically_increasing_id()))
    names = [f"x{i}" for i in range(len(features))]
    cuts = feature_cuts(values.where("NOT held"), names, most_bins)
    bins, width = [len(c) + 1 for c in cuts], max(len(c) for c in cuts) + 1

    def binned(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(batch):
                found = np.stack([np.searchsorted(c, batch.column(3 + i).to_numpy(zero_copy_only=False), side="right") for i, c in enumerate(cuts)], axis=1).astype(np.uint16)
                row, label, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                yield _block(row.astype(np.int64), label.astype(np.int32), held.astype(np.bool_), found, np.zeros((len(row), classes)))

    state = reuse(values.select("row", "y", "held", *names).mapInArrow(binned, BLOCK))
    forest = Forest(trees, classes, depth)
    measured: list[tuple[int, str, float, float]] = []
    kept, chosen = 0, max(1, int(column_share * len(features)))

    def sums(t: int, level: int, wanted: dict[int, list[int]], losses: bool):
        task = _histogram(forest.part(kept, t), forest.part(t, t + 1) if t < trees else forest.part(0, 0), level, wanted, len(features), classes, width, (seed, t, row_share), losses)
        found = state.mapInArrow(task, "cell long, g long, h long, loss double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("loss")).collect()
        out = np.zeros((2, len(wanted) * (1 << level) * len(features) * width))
        for cell, g, h, loss in found:
            if cell <= LOSS:
                if h:
                    measured.append((t, ("train", "eval")[LOSS - cell], loss / h, g / h))
            else:
                out[:, cell] = g, h
        return (out / UNIT).reshape(2, len(wanted), len(features), 1 << level, width)

    for t in range(trees + 1):
        if t == trees:
            sums(t, 0, {}, True)
            break
        columns = [sorted(np.random.default_rng([seed % (1 << 64), t, k]).choice(len(features), chosen, replace=False).tolist()) for k in range(classes)]
        growing = {k: [0] for k in range(classes)}
        for level in range(depth):
            if not growing:
                break
            group = max(1, CELLS // ((1 << level) * len(features) * width))
            ids = sorted(growing)
            for at in range(0, len(ids), group):
                wanted = ids[at : at + group]
                found = sums(t, level, {k: columns[k] for k in wanted}, level == 0 and at == 0)
                for i, k in enumerate(wanted):
                    children = []
                    for node in growing.pop(k):
                        g, h = found[:, i, :, node - (1 << level) + 1]
                        if level == 0:
                            forest.g[t, k, 0], forest.h[t, k, 0] = g[columns[k][0]].sum(), h[columns[k][0]].sum()
                            forest.value[t, k, 0] = -rate * forest.g[t, k, 0] / (forest.h[t, k, 0] + calm)
                        gain, f, b = best_split(g, h, columns[k], bins, calm, least)
                        if not gain:
                            continue
                        forest.feature[t, k, node], forest.bin[t, k, node], forest.cut[t, k, node], forest.gain[t, k, node] = f, b, cuts[f][b], gain
                        for child, side in ((2 * node + 1, slice(None, b + 1)), (2 * node + 2, slice(b + 1, None))):
                            forest.g[t, k, child], forest.h[t, k, child] = g[f][side].sum(), h[f][side].sum()
                            forest.value[t, k, child] = -rate * forest.g[t, k, child] / (forest.h[t, k, child] + calm)
                            children.append(child)
                    if children:
                        growing[k] = children
        lost = [x[2] for x in measured if x[1] == "eval"]
        if patience and lost and len(lost) - 1 - int(np.argmin(lost)) >= patience:
            break
        if t + 1 - kept >= ROUNDS_KEPT:
            state, kept = reuse(state.mapInArrow(_advance(forest.part(kept, t + 1), len(features), classes), BLOCK)), t + 1
    lost = [x[2] for x in measured if x[1] == "eval"]
    done = int(np.argmin(lost)) if patience and lost else trees
    return forest.part(0, done), [x for x in measured if x[0] <= done]


class SoftmaxTreesModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the class probabilities (vector) and the index of the largest."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", typeConverter=TypeConverters.toString)
    losses = Param(Params._dummy(), "losses", "log losses and errors per round as JSON", typeConverter=TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of features", typeConverter=TypeConverters.toInt)

    @property
    def forest(self) -> Forest:
        return Forest.from_json(self.getOrDefault(self.trees))

    @property
    def featureImportances(self) -> DenseVector:
        """Per feature the mean gain of its splits, as shares."""
        forest, n = self.forest, self.getOrDefault(self.width)
        used = forest.feature >= 0
        gain = np.bincount(forest.feature[used], forest.gain[used], n) / np.maximum(np.bincount(forest.feature[used], minlength=n), 1)
        return DenseVector(gain / gain.sum() if gain.sum() else gain)

    def measured(self, spark: SparkSession) -> DataFrame:
        """(rounds, part, log_loss, error): how good the first so many rounds are on the rows fitted and on those held back."""
        return spark.createDataFrame(json.loads(self.getOrDefault(self.losses)), "rounds int, part string, log_loss double, error double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.forest

        @F.pandas_udf("array<double>")
        def probabilities(features):
            x = np.stack(features.to_list()) if len(features) else np.zeros((0, 1))
            return type(features)(list(softmax(forest.margins(x.astype(np.float64), False))))

        found = probabilities(vector_to_array(F.col(self.getFeaturesCol())))
        out = dataset.withColumn(self.getProbabilityCol(), array_to_vector(found))
        first = vector_to_array(F.col(self.getProbabilityCol()))
        return out.withColumn(self.getPredictionCol(), (F.array_position(first, F.array_max(first)) - 1).cast("double"))


class SoftmaxTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``fit_trees`` on a features vector and label indices; ``heldCol`` names a boolean column of rows that are only measured."""

    options = Param(Params._dummy(), "options", "options of fit_trees as JSON", typeConverter=TypeConverters.toString)
    heldCol = Param(Params._dummy(), "heldCol", "rows to measure on", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", seed: int = 42, options: str = "{}", heldCol: str = ""):
        super().__init__()
        self._setDefault(options="{}", heldCol="", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxTreesModel:
        label, held = self.getLabelCol(), self.getOrDefault(self.heldCol) or None
        n = len(dataset.select(self.getFeaturesCol()).first()[0])
        classes = int(dataset.agg(F.max(label)).first()[0]) + 1
        x = vector_to_array(F.col(self.getFeaturesCol()))
        rows = dataset.select(F.col(label).alias("label"), *([F.col(held).alias("held")] if held else []), *[x[i].alias(f"f{i}") for i in range(n)])
        forest, lost = fit_trees(rows, [f"f{i}" for i in range(n)], "label", classes, seed=self.getSeed(), held="held" if held else None, **json.loads(self.getOrDefault(self.options)))
        model = SoftmaxTreesModel()
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(), trees=forest.to_json(), losses=json.dumps(lost), width=n)
        return model

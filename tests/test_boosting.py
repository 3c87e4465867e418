import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from claimloom.operators import boosting, learning
from claimloom.operators.boosting import fit_trees


def sample(spark, n=600, extra=0):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, n), rng.normal(0, 5, n).round(1), rng.integers(0, 2, n)], axis=1).astype(float)
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), np.where(x[:, 0] > 5, 2, np.where((x[:, 1] > 0) & (x[:, 2] == 1), 1, 0)))
    rows = [(int(b), *map(float, a)) for a, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "label int, a double, b double, c double")


def plain_trees(x, y, classes, trees, depth, rate, calm=1.0, least=1.0):
    """The same boosting, row by row in numpy: (round, class, node) -> (feature, cut, value)."""
    margins, out = np.zeros((len(x), classes)), {}
    for t in range(trees):
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(classes):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def grow(node, rows, level):
                value = -rate * g[rows].sum() / (h[rows].sum() + calm)
                best = (1e-9, None, None)
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + calm)
                for f in range(x.shape[1]) if level < depth else []:
                    for cut in np.unique(x[:, f])[1:]:
                        left, right = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
                        if min(h[left].sum(), h[right].sum()) < least:
                            continue
                        gain = 0.5 * (score(left) + score(right) - score(rows))
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                out[t, k, node] = (best[1], best[2], value)
                if best[1] is None:
                    step[rows, k] = value
                else:
                    grow(2 * node + 1, rows[x[rows, best[1]] < best[2]], level + 1)
                    grow(2 * node + 2, rows[x[rows, best[1]] >= best[2]], level + 1)

            grow(0, np.arange(len(x)), 0)
        margins += step
    return out, margins


def same(forest, want):
    for (t, k, node), (f, cut, value) in want.items():
        assert forest.feature[t, k, node] == (-1 if f is None else f)
        assert f is None or forest.cut[t, k, node] == cut
        assert abs(forest.value[t, k, node] - value) < 1e-6


WHOLE = dict(trees=3, depth=3, rate=0.3, row_share=1.0, column_share=1.0)


def test_trees_equal_plain_boosting(spark):
    x, y, df = sample(spark)
    want, margins = plain_trees(x, y, 3, 3, 3, 0.3)
    forest, lost = fit_trees(df, ["a", "b", "c"], "label", 3, **WHOLE)
    same(forest, want)
    assert np.abs(forest.margins(x, False) - margins).max() < 1e-6
    p = boosting.softmax(margins)
    assert abs(lost[-1][2] + np.log(p[np.arange(len(y)), y]).mean()) < 1e-6 and [v[0] for v in lost] == [0, 1, 2, 3]


def test_how_rows_are_dealt_and_held_changes_nothing(spark, monkeypatch):
    _, _, df = sample(spark)
    one, _ = fit_trees(df.coalesce(1), ["a", "b", "c"], "label", 3, **WHOLE)
    monkeypatch.setattr(boosting, "ROUNDS_KEPT", 1)
    monkeypatch.setattr(boosting, "CELLS", 1)
    many, _ = fit_trees(df.repartition(7), ["a", "b", "c"], "label", 3, **WHOLE)
    for name in boosting.Forest.NAMES:
        assert np.allclose(getattr(one, name), getattr(many, name))


def test_shares_of_rows_and_columns(spark):
    _, _, df = sample(spark)
    forest, _ = fit_trees(df, ["a", "b", "c"], "label", 3, trees=4, depth=2, row_share=0.5, column_share=0.4)
    used = [set(forest.feature[t, k][forest.feature[t, k] >= 0].tolist()) for t in range(4) for k in range(3)]
    assert all(len(u) <= 1 for u in used) and len(set().union(*used)) == 3
    # half of the rows: at the first round every row adds 4 / 9 to the root
    assert 0.4 * 600 < forest.h[0, 0, 0] / (4 / 9) < 0.6 * 600


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5_000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("same"))
    cuts, none = boosting.feature_cuts(df, ["x", "same"], 16)
    assert len(cuts) == 15 and np.abs(cuts - np.arange(1, 16) * 5_000 / 16).max() < 50 and len(none) == 0


def test_patience_keeps_the_best_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), float(rng.normal()), bool(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, a double, held boolean")
    forest, lost = fit_trees(df, ["a"], "label", 3, trees=30, depth=3, rate=0.5, held="held", patience=2)
    evals = [v[2] for v in lost if v[1] == "eval"]
    assert forest.feature.shape[0] == len(evals) - 1 < 30 and evals[-1] == min(evals)


def test_pipeline_is_saved_and_read_back_with_odd_labels(spark, tmp_path):
    _, _, df = sample(spark)
    df = df.withColumn("label", F.element_at(F.array(F.lit(0), F.lit(70), F.lit(9)), F.col("label") + 1))
    model = learning.train_predictor(df, ["a", "b", "c"], trees=4, depth=3)
    assert type(model.stages[-2]).__name__ == "SoftmaxTreesModel" and sorted(learning.class_ids(model)) == [0, 9, 70]
    learning.save_model(model, f"file://{tmp_path}/m")
    read = PipelineModel.load(f"file://{tmp_path}/m")
    odd = df.select("a", "b", "c").limit(5).union(spark.createDataFrame([(1e300, -1e9, 1e9)], "a double, b double, c double"))
    got, again = (learning.score(m, odd).orderBy("b").collect() for m in (model, read))
    assert got == again and len(got) == 6
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.predicted == learning.class_ids(model)[int(np.argmax(r.probabilities))] for r in got)
    share = learning.feature_importance(spark, read).collect()
    assert abs(sum(r.importance for r in share) - 1) < 1e-9 and {r.feature for r in share} == {"a", "b", "c"}


def test_held_rows_are_measured_and_not_learnt(spark):
    x, y, df = sample(spark)
    held = df.withColumn("held", F.lit(False)).union(df.withColumns({"held": F.lit(True), "label": F.lit(2)}))
    forest, lost = fit_trees(held, ["a", "b", "c"], "label", 3, held="held", **WHOLE)
    same(forest, plain_trees(x, y, 3, 3, 3, 0.3)[0])
    p = boosting.softmax(forest.margins(x, False))
    assert abs([v for v in lost if v[1] == "eval"][-1][2] + np.log(p[:, 2]).mean()) < 1e-6


def test_estimator_takes_options(spark):
    _, _, df = sample(spark)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = boosting.SoftmaxTrees(options=json.dumps(dict(trees=2, depth=1))).fit(rows)
    assert model.forest.feature.shape == (2, 3, 3) and model.measured(spark).count() == 3
    with pytest.raises(TypeError):
        boosting.SoftmaxTrees(options=json.dumps(dict(no_such=2))).fit(rows)


def test_a_pass_reads_blocks_of_many_rows(spark, monkeypatch):
    """The rows that every level reads again are thousands to a block, and blocks of any size give the same trees and losses."""
    seen = []
    kept = boosting.reuse
    monkeypatch.setattr(boosting, "reuse", lambda df: seen.append(kept(df)) or seen[-1])
    rows = spark.range(0, 9000, 1, 3).select((F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 7).alias("a"), (F.col("id") * 37 % 101).alias("b"))
    fits = []
    for size in ("10000", "700"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            forest, lost = boosting.fit_trees(rows, ["a", "b"], "label", 3, trees=6, depth=2, rate=0.3)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        fits.append((forest.to_json(), [(t, p, round(x, 9), e) for t, p, x, e in lost]))
    assert fits[0] == fits[1]
    assert seen[1].count() == 3

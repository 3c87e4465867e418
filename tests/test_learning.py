import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.operators import features, learning
from claimloom.operators import smote as smote_module
from claimloom.operators.smote import nearest_neighbours, smote


def test_unseen_and_null_categories(spark):
    fit = spark.createDataFrame([("B",), ("A",), (None,), ("B",)], "provider_type string")
    enc = features.fit_encoders(fit, ["provider_type"])
    df = spark.createDataFrame([("A",), ("B",), (None,), ("Z",)], "provider_type string")
    assert [r.provider_type_encoded for r in features.encode_categories(enc, df).collect()] == [0.0, 1.0, 2.0, -1.0]


def test_null_numbers_are_zero(spark):
    fit = spark.createDataFrame([("A", "11")], "provider_type string, place_of_service string")
    df = fit.withColumns({"patient_age": F.lit(None).cast("int"), "total_charge_amount": F.lit(None).cast("decimal(12,2)"),
                          "diagnosis_count": F.lit(2), "procedure_count": F.lit(3)})
    assert features.feature_matrix(features.fit_encoders(fit), df).first().features.toArray().tolist() == [0, 0, 2, 3, 0, 0]


def test_labels(spark):
    df = spark.createDataFrame([("a", []), ("b", [0, None, -3]), ("c", [4, 5]), ("d", None)], "claim_id string, applied_filters array<int>")
    got = sorted((r.claim_id, r.label) for r in features.label_examples(df).collect())
    assert got == [("a", 0), ("b", 0), ("c", 0), ("c", 4), ("c", 5), ("d", 0)]
    with pytest.raises(ValueError):
        learning.require_classes(features.label_examples(df.limit(1)))


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1_000).select(F.col("id").alias("k"), F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))
    a = learning.stratified_split(df, ["k"]).filter("is_test")
    assert sorted((r.label, r["count"]) for r in a.groupBy("label").count().collect()) == [(0, 180), (1, 20)]
    b = learning.stratified_split(df.repartition(7), ["k"]).filter("is_test")
    assert {r.k for r in a.collect()} == {r.k for r in b.collect()}


def brute_force(rows, k):
    """k nearest distances of every distinct point, copies of others counted."""
    pts = np.array([r[1:] for r in rows], float)
    labels = np.array([r[0] for r in rows])
    out = {}
    for i, p in enumerate(pts):
        same = [j for j in range(len(pts)) if labels[j] == labels[i] and j != i]
        out[(int(labels[i]), *p)] = sorted(np.sqrt(((pts[same] - p) ** 2).sum(axis=1)))[:k]
    return out


@pytest.mark.parametrize("shape", ["spread", "hot", "flat"])
def test_neighbours_are_exact(spark, monkeypatch, shape):
    """Small cells force several rounds; half of the points may share one position."""
    monkeypatch.setattr(smote_module, "CELL", 8)
    monkeypatch.setattr(smote_module, "FAN", 4)
    monkeypatch.setattr(smote_module, "VISITORS", 5)
    rng = np.random.default_rng(7)
    n = 150
    x = {"spread": rng.normal(0, 1000, n), "hot": np.where(rng.random(n) < 0.5, 5.0, rng.normal(0, 50, n)), "flat": rng.integers(0, 3, n)}[shape]
    y = rng.integers(0, 40, n) if shape != "hot" else np.where(x == 5.0, 1, rng.integers(0, 40, n))
    rows = [(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    points = spark.createDataFrame(rows, "label int, x double, y double").groupBy("label", "x", "y").agg(F.count(F.lit(1)).alias("copies"))
    want = brute_force(rows, 5)
    got = nearest_neighbours(points, ["x", "y"], 5).collect()
    assert len(got) == points.count()
    for r in got:
        near = sorted(np.sqrt(((np.array(r.neighbours) - [r.x, r.y]) ** 2).sum(axis=1)))
        assert np.allclose(near, want[(r.label, r.x, r.y)])


@pytest.mark.parametrize("shape", ["uniform", "clustered"])
def test_six_dimensions_in_bounded_groups(spark, monkeypatch, shape):
    """Exact in six dimensions, with no group of more than CELL points and VISITORS visitors, and few leaves looked at."""
    monkeypatch.setattr(smote_module, "CELL", 40)
    monkeypatch.setattr(smote_module, "VISITORS", 200)
    seen = []
    for name in ("_in_leaf", "_of_visitors"):
        def spied(features, k, name=name, fn=getattr(smote_module, name)):
            search = fn(features, k)

            def counted(rows):
                assert len(rows) <= 40 + 200 * 2
                return search(rows)

            seen.append(name)
            return counted
        monkeypatch.setattr(smote_module, name, spied)
    rng = np.random.default_rng(11)
    n, names = 1_500, [f"x{i}" for i in range(6)]
    x = rng.uniform(0, 100, (n, 6)) if shape == "uniform" else rng.normal(0, 1, (n, 6)) + rng.integers(0, 12, (n, 1)) * 50.0
    points = spark.createDataFrame([(1, *map(float, r)) for r in x], "label int, " + ", ".join(f"{c} double" for c in names)).withColumn("copies", F.lit(1).cast("long"))
    got = nearest_neighbours(points, names, 5).collect()
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    want = np.sort(d2, axis=1)[:, 1:6]
    at = {tuple(r): i for i, r in enumerate(x.tolist())}
    assert len(got) == n and set(seen) == {"_in_leaf", "_of_visitors"}
    for r in got:
        assert np.allclose(r.far, want[at[tuple(r[c] for c in names)]])


def test_neighbours_of_a_leaf_count_copies_and_visitors_give_only_what_is_in_reach():
    pool, copies = np.array([[0.0], [1.0], [3.0]]), np.array([1, 3, 1])
    far, near, found = smote_module._near(pool, pool, copies, 3, True)
    assert found.tolist() == [3, 3, 3] and far.tolist() == [[1, 1, 1], [0, 0, 1], [4, 4, 4]] and near.tolist() == [[1, 1, 1], [1, 1, 0], [1, 1, 1]]
    assert smote_module._near(pool[:1], pool[:1], np.array([2]), 3, True)[2].tolist() == [1]
    rows = pa.table({"label": [1] * 5, "point_no": [1, 2, 3, 8, 9], "copies": [1, 3, 1, 0, 0], "guest": [False] * 3 + [True] * 2, "reach": [None] * 3 + [1.0, 4.0], "x": [0.0, 1.0, 3.0, 9.0, 2.5]})
    got = smote_module._of_visitors(["x"], 3)(rows).to_pylist()
    assert got == [{"label": 1, "point_no": 9, "far": [0.25, 2.25, 2.25], "near": [[3.0], [1.0], [1.0]]}]


def test_numbering_does_not_compute_the_points_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    points = spark.range(40).selectExpr("1 AS label", "cast(id AS double) AS x", "1L AS copies").mapInArrow(counted, "label int, x double, copies long")
    assert nearest_neighbours(points, ["x"], 2).count() == 40 and seen.value == 40


def test_split_tree_cuts_the_largest_part_and_stops_at_equal_points():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (640, 3))
    tree = smote_module.split_tree(x, 16)
    sizes = np.bincount(smote_module.leaf_of(tree, x), minlength=16)
    assert len(sizes) == 16 and sizes.max() <= 2 * sizes.min()
    assert smote_module.split_tree(np.ones((5, 2)), 4) == []
    two = np.array([[0.0], [1.0], [1.0], [1.0]])
    assert sorted(smote_module.leaf_of(smote_module.split_tree(two, 4), two).tolist()) == [0, 1, 1, 1]


def test_smote_balances_on_segments(spark, monkeypatch):
    monkeypatch.setattr(smote_module, "PIECE", 3)
    rng = np.random.default_rng(3)
    rows = [(0, *rng.normal(0, 5, 2)) for _ in range(97)] + [(1, *rng.normal(50, 5, 2)) for _ in range(8)] + [(2, 9.0, 9.0)] * 6
    rows = [(r[0], float(r[1]), float(r[2])) for r in rows]
    df = spark.createDataFrame(rows, "label int, x double, y double")
    out = smote(df, ["x", "y"]).collect()
    counts = {}
    for r in out:
        counts[r.label] = counts.get(r.label, 0) + 1
    assert counts == {0: 97, 1: 97, 2: 97}
    ones = np.array([r[1:] for r in rows if r[0] == 1])
    for r in (r for r in out if r.label == 1):
        p = np.array([r.x, r.y])
        # a made point lies on a segment between two originals
        gaps = [np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a in ones for b in ones]
        assert min(gaps) < 1e-9
    assert all((r.x, r.y) == (9.0, 9.0) for r in out if r.label == 2)


def test_smote_leaves_tiny_classes(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(20)] + [(1, float(i)) for i in range(5)], "label int, x double")
    assert smote(df, ["x"]).count() == 25


def test_auc_with_ties_and_missing_classes(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0), (2, 0.3, 0)], "class int, prob double, label int")
    got = {r["class"]: r.auc for r in learning.roc_auc_ovr(df).collect()}
    assert got == {1: 0.875, 2: None}
    assert learning.roc_auc_weighted(learning.roc_auc_ovr(df)).first().auc is None


def test_two_classes_use_boosted_trees_and_survive_a_save(spark, tmp_path):
    rows = [(i, 7 if i % 3 == 0 else 0, float(i % 3), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, label int, a double, b double")
    model = learning.train_predictor(df, ["a", "b"], trees=5, depth=2)
    assert type(model.stages[-2]).__name__ == "GBTClassificationModel" and learning.class_ids(model) == [0, 7]
    path = f"file://{tmp_path}/m"
    learning.save_model(model, path)
    learning.save_model(model, path)
    loaded = learning.load_model(path)
    assert learning.load_model(path + ".backup").stages
    got = learning.predict_filters(loaded, df.select("k", "a", "b"), 0.3).collect()
    assert all(r.predicted_filters == ([7] if r.k % 3 == 0 else []) for r in got)
    assert learning.predict_filters(None, df).first().predicted_filters == []
    assert learning.feature_importance(spark, loaded).first().feature == "a"
    meta = learning.model_metadata(spark, loaded).first()
    assert (meta.features, meta.classes) == (["a", "b"], [0, 7])


def test_many_classes(spark):
    rows = [(i, [0, 3, 11][i % 3], float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, label int, a double")
    model = learning.train_predictor(df, ["a"], trees=5, depth=3)
    scored = learning.score(model, df).collect()
    assert all(r.predicted == r.label and abs(sum(r.probabilities) - 1) < 1e-9 for r in scored)
    ids = {r.k: r.predicted_filters for r in learning.predict_filters(model, df.drop("label")).collect()}
    assert ids[0] == [] and ids[1] == [3] and ids[2] == [11]


def test_predictor_versions_read_back_whole(spark, tmp_path):
    path = f"file://{tmp_path}/predictor"
    rows = [(i, 7 if i % 3 == 0 else 0, "A" if i % 3 == 0 else "B", "11", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, label int, provider_type string, place_of_service string, a double")
    encoders = features.fit_encoders(df)
    coded = features.encode_categories(encoders, df)
    model = learning.train_predictor(coded, ["a", "provider_type_encoded"], trees=3, depth=2)
    first = learning.save_predictor(spark, encoders, model, path)
    second = learning.save_predictor(spark, encoders, model, path)
    assert first != second
    for version in (None, first):
        read_encoders, read_model, meta = learning.load_predictor(spark, path, version)
        assert list(meta.features) == ["a", "provider_type_encoded"] and list(meta.classes) == [0, 7]
        got = learning.predict_filters(read_model, features.encode_categories(read_encoders, df)).collect()
        assert all(r.predicted_filters == ([7] if r.k % 3 == 0 else []) for r in got)


def test_save_reports_other_failures_than_a_missing_path(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metadata").mkdir()
    df = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(20)], "k int, label int, a double")
    model = learning.train_predictor(df, ["a"], trees=2, depth=1)
    with pytest.raises(Exception):
        learning.save_model(model, f"file://{tmp_path}/m")

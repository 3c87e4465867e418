"""Queries: splits, gradient sums and quality of the boosted trees."""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimloom.catalog.registry import query
from claimloom.operators import boosting, enrich, features
from claimloom.sizing import reuse

USED = ["patient_age", "diagnosis_count", "procedure_count"]

EXAMPLES = """
, dn AS (SELECT claim_id, count(DISTINCT diagnosis_code) AS n FROM diagnoses GROUP BY claim_id)
, pn AS (SELECT claim_id, count(DISTINCT procedure_code) AS n FROM procedures GROUP BY claim_id)
, f AS (SELECT claim_id, cast(right(claim_id, 10) AS BIGINT) AS k, coalesce(patient_age, 0) AS f0, coalesce(dn.n, 0) AS f1, coalesce(pn.n, 0) AS f2
  FROM claims LEFT JOIN dn USING (claim_id) LEFT JOIN pn USING (claim_id))
, x AS MATERIALIZED (SELECT *, CASE WHEN k % 11 = 0 THEN k % 3 WHEN f0 < 30 AND f1 >= 3 THEN 2 WHEN f0 >= 60 AND f2 >= 2 THEN 1 ELSE 0 END AS label FROM f)
"""


def _examples(d):
    """All claims with three features and a label that mostly follows from them."""
    rows = features.with_counts(enrich.claim_codes(d.claims, d.diagnoses, d.procedures))
    key = F.right("claim_id", F.lit(10)).cast("long")
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in USED}
    label = (
        F.when(key % 11 == 0, key % 3).when((value["patient_age"] < 30) & (value["diagnosis_count"] >= 3), 2)
        .when((value["patient_age"] >= 60) & (value["procedure_count"] >= 2), 1).otherwise(0)
    )
    return rows.select(key.alias("key"), label.cast("int").alias("label"), *[v.alias(c) for c, v in value.items()])


def _rounds(rounds: int, rate: float) -> str:
    """Gradient sums, best splits and leaf values of trees with two levels, round by round."""
    unit = 1 << 30
    text = """
, long AS MATERIALIZED (SELECT k, 0 AS f, f0 AS v FROM x UNION ALL SELECT k, 1, f1 FROM x UNION ALL SELECT k, 2, f2 FROM x)
, m0 AS (SELECT k, label, c, 0.0::DOUBLE AS m FROM x, range(0, 3) AS t(c))"""
    for t in range(rounds):
        text += f"""
, p{t} AS (SELECT k, c, label, m, exp(m) / sum(exp(m)) OVER (PARTITION BY k) AS p FROM m{t})
, g{t} AS MATERIALIZED (SELECT k, c, cast(round((p - (label = c)::INT) * {unit}) AS BIGINT) AS g, cast(round(greatest(2 * p * (1 - p), 1e-16) * {unit}) AS BIGINT) AS h FROM p{t})
, at{t}_0 AS (SELECT k, c, 0 AS node FROM g{t})"""
        for level in (0, 1):
            text += f"""
, hist{t}_{level} AS (SELECT c, node, f, v, sum(g) AS g, sum(h) AS h FROM at{t}_{level} JOIN g{t} USING (k, c) JOIN long USING (k) GROUP BY ALL)
, cum{t}_{level} AS (SELECT c, node, f, v, sum(g) OVER w / {unit} AS lg, sum(h) OVER w / {unit} AS lh, sum(g) OVER (PARTITION BY c, node, f) / {unit} AS tg,
  sum(h) OVER (PARTITION BY c, node, f) / {unit} AS th FROM hist{t}_{level} WINDOW w AS (PARTITION BY c, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, gain{t}_{level} AS (SELECT *, 0.5 * (lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)) AS gain
  FROM cum{t}_{level} WHERE lh >= 1 AND th - lh >= 1)
, best{t}_{level} AS MATERIALIZED (SELECT * FROM gain{t}_{level} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY c, node ORDER BY gain DESC, f, v) = 1)
, at{t}_{level + 1} AS MATERIALIZED (SELECT a.k, a.c, CASE WHEN b.c IS NULL THEN a.node ELSE 2 * a.node + 1 + (CASE b.f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END >= b.v)::INT END AS node
  FROM at{t}_{level} a JOIN x USING (k) LEFT JOIN best{t}_{level} b ON b.c = a.c AND b.node = a.node)"""
        levels = " UNION ALL ".join(f"SELECT k, c, node, {i} AS level FROM at{t}_{i}" for i in (0, 1, 2))
        text += f"""
, nodes{t} AS (SELECT {t} AS round, c, node, sum(g) / {unit} AS g, sum(h) / {unit} AS h
  FROM (SELECT DISTINCT k, c, node FROM ({levels})) JOIN g{t} USING (k, c) GROUP BY c, node)
, tree{t} AS MATERIALIZED (SELECT n.*, -{rate} * n.g / (n.h + 1) AS value, b.f, b.v, b.gain FROM nodes{t} n
  LEFT JOIN (SELECT * FROM best{t}_0 UNION ALL SELECT * FROM best{t}_1) b USING (c, node))
, m{t + 1} AS (SELECT k, label, c, m + value AS m FROM p{t} JOIN at{t}_2 USING (k, c) JOIN tree{t} USING (c, node))"""
    trees = " UNION ALL ".join(f"SELECT * FROM tree{t}" for t in range(rounds))
    return text + f"""
SELECT cast(round AS INT) AS round, cast(c AS INT) AS class, node, cast(coalesce(f, -1) AS INT) AS feature, cast(coalesce(v, 0) AS DOUBLE) AS cut,
  round(coalesce(gain, 0), 4) AS gain, round(g, 4) AS g, round(h, 4) AS h, round(value, 6) AS value FROM ({trees})"""


@query("T4_boosted_rounds", "claims diagnoses procedures", EXAMPLES + _rounds(2, 0.3))
def boosted_rounds(d):
    """Every node of the first two rounds, on all rows and features: split, gain, gradient sums and value."""
    forest, _ = boosting.fit_trees(_examples(d), USED, "label", 3, trees=2, depth=2, rate=0.3, row_share=1.0, column_share=1.0)
    rows = []
    for t in range(2):
        for c in range(3):
            there = [0]
            for node in range(7):
                if node and (node - 1) // 2 in there and forest.feature[t, c, (node - 1) // 2] >= 0:
                    there.append(node)
            for node in there:
                rows.append((t, c, node, int(forest.feature[t, c, node]), *(float(getattr(forest, n)[t, c, node]) for n in ("cut", "gain", "g", "h", "value"))))
    found = d.spark.createDataFrame(rows, "round int, class int, node int, feature int, cut double, gain double, g double, h double, value double")
    return found.select("round", "class", "node", "feature", "cut", *[F.round(c, 4).alias(c) for c in ("gain", "g", "h")], F.round("value", 6).alias("value"))


@query("T4_boosted_quality", "claims diagnoses procedures", EXAMPLES + """
SELECT count(*) FILTER (k % 5 = 0) AS n_held_out, true AS losses_fall, true AS below_forest, true AS errors_near_noise FROM x""")
def boosted_quality(d):
    """Held-out rows: whether the log loss falls over the rounds and ends below that of a forest of as many trees, and whether hardly
    more rows are wrong than the labels that were drawn without regard to the features."""
    rows = reuse(_examples(d).withColumn("held", F.col("key") % 5 == 0))
    assembled = VectorAssembler(inputCols=USED, outputCol="features").transform(rows)
    options = json.dumps(dict(trees=20, depth=3, rate=0.3))
    model = boosting.SoftmaxTrees(labelCol="label", heldCol="held", options=options).fit(assembled)
    forest = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=3, seed=42).fit(assembled.where("NOT held"))
    own = vector_to_array("probability")[F.col("label")]
    own_loss = F.avg(-F.log(F.greatest(own, F.lit(1e-15))))
    measured = model.measured(d.spark).where("part = 'eval'")
    last, first = (measured.agg(by("log_loss", "rounds")).scalar() for by in (F.max_by, F.min_by))
    return forest.transform(assembled.where("held")).agg(F.count(F.lit(1)).alias("n_held_out"), own_loss.alias("of_forest")).select(
        "n_held_out", (last < first).alias("losses_fall"), (last < F.col("of_forest")).alias("below_forest"),
        (measured.agg(F.max_by("error", "rounds")).scalar() < 0.1).alias("errors_near_noise"))

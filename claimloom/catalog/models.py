"""Queries: features, labels, split, oversampling, training, prediction and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.assembly import TRAINING
from claimloom.catalog.registry import query, scratch
from claimloom.catalog.reporting import rounded
from claimloom.catalog.rulesets import TRUTH, outcome_text
from claimloom.operators import enrich, features, learning
from claimloom.operators.ranking import top_filters
from claimloom.operators.smote import nearest_neighbours, smote
from claimloom.plans.train import train, training_examples, training_report
from claimloom.plans.validate import validate_claims
from claimloom.sizing import reuse

# The shared fit has fewer and smaller trees than the defaults (300 of depth 6); every level of a round is a pass over the rows.
FIT = dict(trees=10, depth=4)
# Fits of this application, by its id and the folder of the tables.
FITTED = {}


@query("V2_feature_matrix", "claims diagnoses procedures", """
, dn AS (SELECT claim_id, count(DISTINCT concat_ws('|', diagnosis_code, diagnosis_type, cast(diagnosis_sequence AS VARCHAR), description, cast(is_principal AS VARCHAR))) AS n
  FROM diagnoses WHERE diagnosis_code IS NOT NULL GROUP BY claim_id)
, pn AS (SELECT claim_id, count(*) AS n FROM (SELECT DISTINCT * FROM procedures WHERE procedure_code IS NOT NULL) GROUP BY claim_id)
, pt AS (SELECT DISTINCT coalesce(provider_type, 'UNKNOWN') AS v, dense_rank() OVER (ORDER BY coalesce(provider_type, 'UNKNOWN')) - 1 AS code FROM claims WHERE processing_status = 'COMPLETED')
, ps AS (SELECT DISTINCT coalesce(place_of_service, 'UNKNOWN') AS v, dense_rank() OVER (ORDER BY coalesce(place_of_service, 'UNKNOWN')) - 1 AS code FROM claims WHERE processing_status = 'COMPLETED')
SELECT c.claim_id, cast(coalesce(patient_age, 0) AS DOUBLE) AS patient_age, cast(coalesce(total_charge_amount, 0) AS DOUBLE) AS total_charge_amount,
  cast(coalesce(dn.n, 0) AS DOUBLE) AS diagnosis_count, cast(coalesce(pn.n, 0) AS DOUBLE) AS procedure_count,
  cast(coalesce(pt.code, -1) AS DOUBLE) AS provider_type_encoded, cast(coalesce(ps.code, -1) AS DOUBLE) AS place_of_service_encoded
FROM claims c LEFT JOIN dn USING (claim_id) LEFT JOIN pn USING (claim_id) LEFT JOIN pt ON pt.v = coalesce(provider_type, 'UNKNOWN')
  LEFT JOIN ps ON ps.v = coalesce(place_of_service, 'UNKNOWN')""")
def feature_matrix(d):
    """The vector column, taken apart again for the comparison."""
    from pyspark.ml.functions import vector_to_array

    encoders = features.fit_encoders(d.claims.filter(F.col("processing_status") == "COMPLETED"))
    matrix = features.feature_matrix(encoders, enrich.claim_measures(*d.core)).select(
        "claim_id", vector_to_array("features").alias("v"))
    return matrix.select("claim_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(features.FEATURES)])


LABELS = """
, l AS (SELECT claim_id, dn, pn, unnest(CASE applied_filters WHEN '1,2' THEN [1, 2, 0] WHEN '3' THEN [3, 0] ELSE [0] END) AS label FROM training)
"""


@query("V3_label_examples", "claims diagnoses procedures results", TRAINING + LABELS + """
SELECT claim_id, cast(label AS INT) AS label, count(*) AS n FROM l GROUP BY 1, 2""")
def label_examples(d):
    rows = features.label_examples(enrich.training_set(*d.core, d.results))
    return rows.groupBy("claim_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("T1_valid_labels", "claims diagnoses procedures results", TRAINING + LABELS + """
SELECT claim_id, cast(label AS INT) AS label, dn AS diagnosis_count, pn AS procedure_count FROM l WHERE label >= 0""")
def valid_labels(d):
    return training_examples(*d.core, d.results).select(
        "claim_id", "label", F.col("diagnosis_count").cast("long"), F.col("procedure_count").cast("long"))


def _examples(d):
    """Labelled claims with all features as doubles; the label comes from the order key, so each
    class grows with the table."""
    encoders = features.fit_encoders(d.claims)
    number = F.right("claim_id", F.lit(10)).cast("long")
    label = F.when(number % 10 < 6, 0).when(number % 10 < 9, 1).otherwise(2)
    coded = features.with_counts(enrich.claim_codes(d.claims, d.diagnoses, d.procedures))
    return features.feature_columns(encoders, coded).select("claim_id", label.alias("label"), *features.FEATURES)


@query("T2_stratified_split", sql="""
WITH c AS (SELECT CASE WHEN o_orderkey % 10 < 6 THEN 0 WHEN o_orderkey % 10 < 9 THEN 1 ELSE 2 END AS label FROM orders)
SELECT label, count(*) AS n, cast(round(count(*) * 0.2) AS BIGINT) AS n_test FROM c GROUP BY label""")
def stratified_split(d):
    split = learning.stratified_split(_examples(d), ["claim_id"], 0.2, 42)
    return split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("T3_smote", sql="""
WITH c AS (SELECT CASE WHEN o_orderkey % 10 < 6 THEN 0 WHEN o_orderkey % 10 < 9 THEN 1 ELSE 2 END AS label FROM orders)
SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY label)) AS n FROM c GROUP BY label""")
def oversample(d):
    return smote(reuse(_examples(d)), features.FEATURES).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("T3_neighbours", "claims diagnoses procedures", """
, dn AS (SELECT claim_id, count(DISTINCT diagnosis_code) AS n FROM diagnoses GROUP BY claim_id)
, pn AS (SELECT claim_id, count(DISTINCT procedure_code) AS n FROM procedures GROUP BY claim_id)
, pt AS (SELECT DISTINCT coalesce(provider_type, 'UNKNOWN') AS v, dense_rank() OVER (ORDER BY coalesce(provider_type, 'UNKNOWN')) - 1 AS code FROM claims)
, ps AS (SELECT DISTINCT coalesce(place_of_service, 'UNKNOWN') AS v, dense_rank() OVER (ORDER BY coalesce(place_of_service, 'UNKNOWN')) - 1 AS code FROM claims)
, x AS MATERIALIZED (SELECT claim_id, CASE WHEN cast(right(claim_id, 10) AS BIGINT) % 10 < 9 THEN 1 ELSE 2 END AS label, coalesce(patient_age, 0)::DOUBLE AS a,
    coalesce(total_charge_amount, 0)::DOUBLE AS b, coalesce(dn.n, 0)::DOUBLE AS c, coalesce(pn.n, 0)::DOUBLE AS d, pt.code::DOUBLE AS e, ps.code::DOUBLE AS f
  FROM claims LEFT JOIN dn USING (claim_id) LEFT JOIN pn USING (claim_id) JOIN pt ON pt.v = coalesce(provider_type, 'UNKNOWN') JOIN ps ON ps.v = coalesce(place_of_service, 'UNKNOWN')
  WHERE cast(right(claim_id, 10) AS BIGINT) % 10 >= 6)
, near AS (SELECT p.claim_id, p.label, min(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2 + (p.d - q.d) ** 2 + (p.e - q.e) ** 2 + (p.f - q.f) ** 2), 5) AS far
  FROM x p JOIN x q ON p.label = q.label AND p.claim_id <> q.claim_id GROUP BY ALL)
SELECT claim_id, cast(label AS INT) AS label, round(far[1], 4) AS nearest, round(far[3], 4) AS third, round(far[5], 4) AS fifth FROM near""")
def neighbours(d):
    """Distances of every claim of the smaller classes to its five nearest."""
    rows = reuse(_examples(d).filter("label > 0"))
    points = rows.groupBy("label", *features.FEATURES).agg(F.count(F.lit(1)).alias("copies"))
    found = nearest_neighbours(points, features.FEATURES, 5).select("label", *features.FEATURES, "far")
    at = lambda i: F.round(F.sqrt(F.get("far", F.lit(i))), 4)
    return rows.join(found, ["label", *features.FEATURES]).select("claim_id", "label", at(0).alias("nearest"), at(2).alias("third"), at(4).alias("fifth"))


def _trained(d):
    """Encoders, predictor and scored held-out rows; one fit serves all queries of a folder."""
    key = d.spark.sparkContext.applicationId, d.folder
    if key not in FITTED:
        encoders, model, held_out = train(*d.core, d.results, **FIT)
        FITTED[key] = encoders, model, reuse(held_out)
    return FITTED[key]


def _scored_pending(d, encoders, model):
    """Pending claims with the probabilities of all classes."""
    pending = d.claims.filter(F.col("processing_status") == "PENDING")
    measured = enrich.claim_measures(pending, d.diagnoses, d.procedures)
    return learning.score(model, features.feature_columns(encoders, measured)).select(
        "claim_id", "predicted", "probabilities", learning.scored_classes(model).alias("scores"))


CLASSES = TRAINING + LABELS + """
, s AS (SELECT label, cast(round(count(*) * 0.2) AS BIGINT) AS n FROM l WHERE label >= 0 GROUP BY label)
, ids AS (SELECT cast(label AS INT) AS filter_id FROM s WHERE label > 0)
"""


@query("T4_train_predictor", "claims diagnoses procedures results", CLASSES + """
SELECT cast(label AS INT) AS label, n AS n_held_out, n * (SELECT count(*) FROM s) AS n_scores, cast(n AS DOUBLE) AS prob_total, n AS n_best
FROM s WHERE n > 0""")
def train_predictor(d):
    """Held-out rows per label: how many there are, how many classes are scored, what the probabilities add up to, and
    how many rows are given the class of the highest one."""
    _, model, held_out = _trained(d)
    best = F.element_at(F.array(*map(F.lit, learning.class_ids(model))), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return held_out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_held_out"), F.sum(F.size("probabilities")).alias("n_scores"),
        F.round(F.sum(total), 6).alias("prob_total"), F.count_if(F.col("predicted") == best).alias("n_best"))


@query("S10_training_report", "claims diagnoses procedures results", CLASSES + """
SELECT cast(label AS VARCHAR) AS class, n AS support, true AS in_range FROM s
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), cast(sum(n) AS BIGINT), true FROM s""")
def report(d):
    """Written as JSON and read back; figures of a fit are held to their range, supports to the labels."""
    from claimloom.sources.tables import write_training_report

    _, model, held_out = _trained(d)
    path = scratch(d.spark, "report")
    out = training_report(held_out, model)
    write_training_report(out, path)
    return d.spark.read.schema(out.schema).json(path).select(
        "class", "support",
        ((F.least("precision", "recall", "f1", "auc") >= 0) & (F.greatest("precision", "recall", "f1", "auc") <= 1)).alias("in_range"))


@query("T7_L4_feature_importance", "claims diagnoses procedures results", CLASSES + """
, t AS (SELECT count(DISTINCT coalesce(patient_age, 0)) AS a, count(DISTINCT coalesce(total_charge_amount, 0)) AS c, count(DISTINCT dn) AS d,
  count(DISTINCT pn) AS p, count(DISTINCT coalesce(provider_type, 'UNKNOWN')) AS t, count(DISTINCT coalesce(place_of_service, 'UNKNOWN')) AS s FROM training)
SELECT 'patient_age' AS feature, a > 1 AS used FROM t UNION ALL SELECT 'total_charge_amount', c > 1 FROM t
UNION ALL SELECT 'diagnosis_count', d > 1 FROM t UNION ALL SELECT 'procedure_count', p > 1 FROM t
UNION ALL SELECT 'provider_type_encoded', t > 1 FROM t UNION ALL SELECT 'place_of_service_encoded', s > 1 FROM t""")
def importance(d):
    """Features that vary over the training rows are the ones the trees use."""
    _, model, _ = _trained(d)
    return learning.feature_importance(d.spark, model).select("feature", (F.col("importance") > 0).alias("used"))


@query("S9_save_and_load_model", "claims diagnoses procedures results", CLASSES + """
SELECT claim_id, (SELECT count(*) FROM s) AS n_classes, true AS same FROM claims WHERE processing_status = 'PENDING'""")
def save_and_load(d):
    """Scores of all pending claims by what was saved and read back, against those of the fit itself."""
    encoders, model, _ = _trained(d)
    path = scratch(d.spark, "model") + "/predictor"
    learning.save_predictor(d.spark, encoders, model, path)
    read_encoders, read_model, _ = learning.load_predictor(d.spark, path)
    before = _scored_pending(d, encoders, model).select("claim_id", F.col("scores").alias("before"))
    after = _scored_pending(d, read_encoders, read_model)
    return before.join(after, "claim_id").select(
        "claim_id", F.size("scores").cast("long").alias("n_classes"), (F.col("before") == F.col("scores")).alias("same"))


@query("V4_predict_filters", "claims diagnoses procedures results", CLASSES + """
SELECT claim_id, (SELECT string_agg(cast(filter_id AS VARCHAR), ',' ORDER BY filter_id) FROM ids) AS filters, 1.0::DOUBLE AS prob_total,
  true AS best_first, true AS default_leads FROM claims WHERE processing_status = 'PENDING'""")
def predict(d):
    """All filters a claim is scored for, whether they come best first, and whether the selection at the default threshold
    is the head of that list with probabilities above it."""
    encoders, model, _ = _trained(d)
    ids, usual = top_filters(F.col("scores"), -1.0), top_filters(F.col("scores"))
    rows = _scored_pending(d, encoders, model).select("claim_id", "probabilities", F.map_from_entries("scores").alias("prob"), ids.alias("ids"), usual.alias("usual"))
    probs = F.transform("ids", lambda i: F.col("prob")[i])
    return rows.select(
        "claim_id", F.array_join(F.array_sort(F.col("ids")).cast("array<string>"), ",").alias("filters"),
        F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x), 6).alias("prob_total"),
        (probs == F.sort_array(probs, asc=False)).alias("best_first"),
        ((F.col("usual") == F.slice("ids", F.lit(1), F.size("usual"))) & (F.size("usual") == F.size(F.filter(probs, lambda p: p > 0.3)))).alias("default_leads"))


@query("V5_validate_with_model", "claims diagnoses procedures results filters", TRUTH + CLASSES + """
SELECT claim_id, (SELECT string_agg(cast(filter_id AS VARCHAR), ',' ORDER BY filter_id) FROM ids) AS predicted_filters,
  string_agg(concat_ws('|', cast(o.filter_id AS VARCHAR), o.filter_name, cast(passed AS VARCHAR), rule_type, details, error), ';' ORDER BY o.filter_id) AS outcomes,
  'COMPLETED' AS validation_status
FROM outcomes o JOIN ids USING (filter_id) WHERE processing_status = 'PENDING' GROUP BY claim_id""")
def validate_with_model(d):
    """Without a threshold, so that every filter of the model is decided for every pending claim; in order of the filter ids."""
    encoders, model, _ = _trained(d)
    pending = d.claims.filter(F.col("processing_status") == "PENDING")
    found = validate_claims(pending, d.diagnoses, d.procedures, d.filters, d.code_sets, encoders, model, threshold=-1.0)
    return outcome_text(found.withColumns({
        "predicted_filters": F.array_sort("predicted_filters"), "validation_results": F.array_sort("validation_results")}))


PREDICTED = """
WITH q AS (SELECT cast(o_orderkey % 3 AS INT) AS label, cast((o_orderkey + o_custkey) % 3 AS INT) AS prediction FROM orders)
, k AS (SELECT unnest([0, 1, 2]) AS c)
, m AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS guessed,
  count(*) FILTER (label = c AND prediction = c) AS hit FROM q, k GROUP BY c)
, s AS (SELECT cast(c AS VARCHAR) AS class, hit / guessed AS precision, hit / support AS recall, 2 * hit / (guessed + support) AS f1, support, hit FROM m)
"""


@query("T5_classification_report", sql=PREDICTED + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), cast(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), cast(sum(support) AS BIGINT) FROM s""")
def classification(d):
    rows = d.orders.select((F.col("o_orderkey") % 3).cast("int").alias("label"),
                           ((F.col("o_orderkey") + F.col("o_custkey")) % 3).cast("int").alias("prediction"))
    return learning.classification_report(rows).select("class", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@query("T6_roc_auc", sql="""
WITH s AS (SELECT o_orderkey % 3 AS label, c AS class, ((o_orderkey * 31 + c * 17 + o_custkey) % 1000) / 1000 AS prob FROM orders, range(0, 3) AS t(c))
, g AS (SELECT class, prob, count(*) FILTER (label = class) AS pos, count(*) FILTER (label <> class) AS neg FROM s GROUP BY class, prob)
, r AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g)
SELECT cast(class AS VARCHAR) AS class, cast(sum(pos) AS BIGINT) AS support, round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r GROUP BY class
UNION ALL SELECT 'weighted', NULL, round(sum(a * p) / sum(p), 6) FROM (
  SELECT class, sum(pos) AS p, sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)) AS a FROM r GROUP BY class)""")
def roc_auc(d):
    classes = d.orders.select(
        (F.col("o_orderkey") % 3).alias("label"), "o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("class"))
    scores = classes.select("label", "class", (
        ((F.col("o_orderkey") * 31 + F.col("class") * 17 + F.col("o_custkey")) % 1000) / 1000).alias("prob"))
    measured = learning.roc_auc_ovr(scores)
    per_class = measured.select(F.col("class").cast("string").alias("class"), "support", rounded("auc"))
    weighted = learning.roc_auc_weighted(measured).select(
        F.lit("weighted").alias("class"), F.lit(None).cast("long").alias("support"), rounded("auc"))
    return per_class.unionByName(weighted)

"""Queries: rule parsing, evaluation, mining and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.assembly import ITEM_CTE, joined
from claimloom.catalog.registry import query
from claimloom.catalog.reporting import rounded
from claimloom.operators import enrich, mining, rules
from claimloom.plans.mine import mine_rules
from claimloom.plans.validate import validate_claims
from claimloom.sizing import reuse


@query("P3_active_filters", sql="""
SELECT cast(p_partkey AS INT) AS filter_id, concat('Size of ', p_name) AS filter_name, concat('patient_age(X, Age) & (Age >= ', cast(p_size AS VARCHAR), ')') AS rule_definition,
  p_type AS description, 'MANUAL' AS rule_type FROM part WHERE p_size % 3 <> 0""")
def active_filters(d):
    """One filter per part; every third size is inactive, and a part without size is neither."""
    filters = d.part.select(
        F.col("p_partkey").cast("int").alias("filter_id"), F.concat(F.lit("Size of "), "p_name").alias("filter_name"),
        F.concat(F.lit("patient_age(X, Age) & (Age >= "), F.col("p_size").cast("string"), F.lit(")")).alias("rule_definition"),
        (F.col("p_size") % 3 != 0).alias("active"), F.col("p_type").alias("description"), F.lit("MANUAL").alias("rule_type"))
    return rules.active_filters(filters)


@query("M7_rule_conditions", sql="""
SELECT cast(p_partkey * 3 AS INT) AS filter_id, 0 AS cond_no, 'diagnosis' AS kind, '=' AS op, p_brand AS value_str, cast(NULL AS DOUBLE) AS value_num, '' AS sets FROM part
UNION ALL SELECT cast(p_partkey * 3 AS INT), 1, 'age', '>=', NULL, p_size, '' FROM part
UNION ALL SELECT cast(p_partkey * 3 AS INT), 2, 'procedure', 'in', NULL, NULL, 'managed_procedure' FROM part
UNION ALL SELECT cast(p_partkey * 3 + 1 AS INT), 0, 'charge', '<', NULL, p_retailprice, '' FROM part
UNION ALL SELECT cast(p_partkey * 3 + 1 AS INT), 1, 'place', '=', p_name, NULL, '' FROM part""")
def rule_conditions(d):
    """Two rules per part, parsed into condition rows; a third one has no condition."""
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    texts = F.array(
        F.concat(F.lit("rule_applies(X) <= has_diagnosis(X, '"), brand, F.lit("') & patient_age(X, Age) & (Age >= "), size,
                 F.lit(") & has_procedure(X, ProcCode) & managed_procedure(ProcCode)")),
        F.concat(F.lit("charge_amount(X, Amount) & place_of_service(X, \""), F.col("p_name"), F.lit("\") & (Amount < "),
                 F.col("p_retailprice").cast("string"), F.lit(")")),
        F.lit("rule_applies(X) <= True"),
    )
    filters = d.part.select("p_partkey", F.posexplode(texts).alias("i", "rule_definition")).select(
        (F.col("p_partkey") * 3 + F.col("i")).cast("int").alias("filter_id"), "rule_definition")
    return rules.rule_conditions(filters).select(
        "filter_id", "cond_no", "kind", "op", "value_str", "value_num", joined(F.coalesce("set_names", F.array())).alias("sets"))


# One boolean per rule of the fixed rule set, over claims.
TRUTH = """
, dx AS (SELECT claim_id, bool_or(diagnosis_code = 'Brand#13') AS b13, bool_or(diagnosis_code IN ('Brand#1', 'Brand#5', 'Brand#21')) AS prev FROM diagnoses GROUP BY claim_id)
, px AS (SELECT claim_id, bool_or(procedure_code IN ('P1', 'P10', 'P25', 'P50')) AS managed FROM procedures GROUP BY claim_id)
, truth AS (SELECT c.claim_id, processing_status, coalesce(b13 AND patient_age > 65, false) AS r1,
  coalesce(total_charge_amount > 100000 AND provider_type = 'SPECIALIST', false) AS r2,
  coalesce(patient_age < 18 AND prev, false) AS r3, coalesce(place_of_service = '23' AND provider_type = 'EMERGENCY', false) AS r4,
  coalesce(patient_age >= 18 AND patient_age < 65, false) AS r5, true AS r6, coalesce(b13 AND managed, false) AS r7, false AS r8
  FROM claims c LEFT JOIN dx USING (claim_id) LEFT JOIN px USING (claim_id))
, outcomes AS (SELECT claim_id, processing_status, f.filter_id, f.filter_name,
  CASE f.filter_id WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 WHEN 4 THEN r4 WHEN 5 THEN r5 WHEN 6 THEN r6 WHEN 7 THEN r7 ELSE r8 END AS passed,
  'DATALOG' AS rule_type, f.description AS details, CASE WHEN f.filter_id = 8 THEN 'unknown code set: no_such_set' ELSE '' END AS error
  FROM truth, (SELECT * FROM filters WHERE active) f)
"""
NUMBER = "cast(right(claim_id, 10) AS BIGINT)"


def _candidates(d):
    """Three filter ids per claim, inactive and unknown ones among them."""
    number = F.right("claim_id", F.lit(10)).cast("long")
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(4)), lambda j: ((number * 3 + j) % 10 + 1).cast("int"))
    return d.claims.select("claim_id", ids.alias("predicted_filters"))


@query("M8_evaluate_rules", "claims diagnoses procedures filters", TRUTH + f"""
SELECT claim_id, filter_id, filter_name, passed, rule_type, details, error FROM outcomes
WHERE filter_id IN (({NUMBER} * 3) % 10 + 1, ({NUMBER} * 3 + 1) % 10 + 1, ({NUMBER} * 3 + 4) % 10 + 1)""")
def evaluate_rules(d):
    candidates = _candidates(d).select("claim_id", F.explode("predicted_filters").alias("filter_id"))
    return rules.evaluate_rules(*d.core, d.filters, d.code_sets, candidates)


@query("M9_evaluate_all_active", "claims diagnoses procedures filters", TRUTH + """
SELECT claim_id, filter_id, filter_name, passed, rule_type, details, error FROM outcomes""")
def evaluate_all_active(d):
    return rules.evaluate_all_active(rules.coded_claims(*d.core), d.filters, d.code_sets)


@query("M9_rule_coverage", "claims diagnoses procedures filters", TRUTH + """
SELECT filter_id, filter_name, count(*) AS n_claims, count(*) FILTER (passed) AS n_passed, error FROM outcomes GROUP BY filter_id, filter_name, error""")
def rule_coverage(d):
    return rules.rule_coverage(*d.core, d.filters, d.code_sets)


@query("M9_interval_rules", "claims diagnoses procedures", """
, r AS (SELECT cast(right(claim_id, 10) AS INT) AS filter_id, floor(total_charge_amount) AS lo, coalesce(patient_age, 50) AS age,
    cast(right(claim_id, 10) AS INT) % 4 AS form FROM claims)
, p AS (SELECT filter_id, count(*) AS n_passed FROM r JOIN claims ON CASE form
    WHEN 0 THEN total_charge_amount > lo - 200 AND total_charge_amount <= lo + 100
    WHEN 1 THEN total_charge_amount >= lo AND total_charge_amount < lo + 2000 AND patient_age = age
    WHEN 2 THEN total_charge_amount >= lo + 450000 AND patient_age < age ELSE total_charge_amount >= lo AND total_charge_amount <= lo + 50 AND provider_type = 'HOSPITAL' END
  GROUP BY filter_id)
SELECT filter_id, (SELECT count(*) FROM claims) AS n_claims, coalesce(n_passed, 0) AS n_passed, '' AS error FROM r LEFT JOIN p USING (filter_id)""")
def interval_rules(d):
    """A rule of numbers for every claim: how many claims lie within it."""
    number = F.right("claim_id", F.lit(10)).cast("int")
    lo, age = F.floor("total_charge_amount"), F.coalesce("patient_age", F.lit(50)).cast("string")
    charge = lambda op, x: F.concat(F.lit(f" & (A {op} "), x.cast("string"), F.lit(")"))
    head, aged = F.lit("charge_amount(X, A)"), F.lit(" & patient_age(X, G)")
    text = (
        F.when(number % 4 == 0, F.concat(head, charge(">", lo - 200), charge("<=", lo + 100)))
        .when(number % 4 == 1, F.concat(head, charge(">=", lo), charge("<", lo + 2000), aged, F.lit(" & (G == "), age, F.lit(")")))
        .when(number % 4 == 2, F.concat(head, charge(">=", lo + 450000), aged, F.lit(" & (G < "), age, F.lit(")")))
        .otherwise(F.concat(head, charge(">=", lo), charge("<=", lo + 50), F.lit(" & provider_type(X, 'HOSPITAL')")))
    )
    filters = d.claims.select(
        number.alias("filter_id"), "claim_id", text.alias("rule_definition"), F.lit(True).alias("active"), F.lit("").alias("description"), F.col("claim_id").alias("filter_name"))
    return rules.rule_coverage(*d.core, filters, d.code_sets).drop("filter_name")


@query("V5_validate_claims", "claims diagnoses procedures filters", TRUTH + f"""
, w AS (SELECT claim_id, i AS pos, ({NUMBER} * 3 + CASE i WHEN 2 THEN 4 ELSE i END) % 10 + 1 AS filter_id
  FROM claims, range(0, 3) AS t(i) WHERE processing_status = 'PENDING')
SELECT w.claim_id, string_agg(cast(w.filter_id AS VARCHAR), ',' ORDER BY pos) AS predicted_filters,
  coalesce(string_agg(concat_ws('|', cast(o.filter_id AS VARCHAR), o.filter_name, cast(passed AS VARCHAR), rule_type, details, error), ';' ORDER BY pos)
    FILTER (o.filter_id IS NOT NULL), '') AS outcomes, 'COMPLETED' AS validation_status
FROM w LEFT JOIN outcomes o ON o.claim_id = w.claim_id AND o.filter_id = w.filter_id GROUP BY w.claim_id""")
def validate(d):
    pending = d.claims.filter(F.col("processing_status") == "PENDING")
    return outcome_text(validate_claims(pending, d.diagnoses, d.procedures, d.filters, d.code_sets, candidates=_candidates(d)))


def outcome_text(results):
    return results.select(
        "claim_id", joined(F.col("predicted_filters").cast("array<string>")).alias("predicted_filters"),
        F.array_join(F.transform("validation_results", lambda o: F.concat_ws(
            "|", o["filter_id"].cast("string"), o["filter_name"], o["passed"].cast("string"), o["rule_type"], o["details"], o["error"])), ";").alias("outcomes"),
        "validation_status")


# --- mining ----------------------------------------------------------------

def _level(k):
    """Itemsets of size ``k``: occurrences of the smaller ones, extended by a later item."""
    before = ", ".join(f"i{j}" for j in range(1, k))
    return f"""
, o{k} AS (SELECT o.*, t1.item AS i{k} FROM o{k - 1} o JOIN t1 ON t1.claim_id = o.claim_id AND t1.item > o.i{k - 1})
, c{k} AS (SELECT {before}, i{k}, count(*) AS f FROM o{k} GROUP BY ALL HAVING count(*) / (SELECT n FROM n) >= 0.01)
, k{k} AS (SELECT o{k}.* FROM o{k} JOIN c{k} USING ({before}, i{k}))
""".replace(f"FROM o{k - 1} o", f"FROM k{k - 1} o")


LEVELS = 5
SETS = ITEM_CTE + """
, n AS (SELECT count(DISTINCT claim_id) AS n FROM tx)
, c1 AS (SELECT item AS i1, count(*) AS f FROM tx GROUP BY item HAVING count(*) / (SELECT n FROM n) >= 0.01)
, t1 AS (SELECT tx.* FROM tx JOIN c1 ON c1.i1 = tx.item)
, k1 AS (SELECT claim_id, item AS i1 FROM t1)
""" + "".join(_level(k) for k in range(2, LEVELS + 1)) + ", sets AS (" + " UNION ALL ".join(
    f"SELECT concat_ws(',', {', '.join(f'i{j}' for j in range(1, k + 1))}) AS items, f FROM c{k}" for k in range(1, LEVELS + 1)) + ")"
RULES = SETS + """
, lists AS (SELECT items, string_split(items, ',') AS l FROM sets)
, masks AS (SELECT items, l, unnest(range(1, (1 << len(l)) - 1)) AS mask FROM lists WHERE len(l) > 1)
, splits AS (SELECT items,
    array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 1), ',') AS ante,
    array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 0), ',') AS cons FROM masks)
, mined AS (SELECT ante, cons, s.f AS freq, x.f AS ante_freq, s.f / n AS support, s.f / x.f AS confidence, (s.f / x.f) / (y.f / n) AS lift
  FROM splits JOIN sets s ON s.items = splits.items JOIN sets x ON x.items = ante JOIN sets y ON y.items = cons, n)
"""


@query("M1_one_hot", "claims diagnoses procedures", ITEM_CTE + "SELECT claim_id, item FROM tx")
def one_hot(d):
    return mining.one_hot(enrich.transactions(*d.core))


@query("M2_frequent_itemsets", "claims diagnoses procedures", SETS + "SELECT items, f AS freq, round(f / n, 6) AS support FROM sets, n")
def frequent_itemsets(d):
    return mining.frequent_itemsets(enrich.transactions(*d.core)).select(joined("items").alias("items"), "freq", rounded("support"))


def _itemsets(d):
    return reuse(mining.frequent_itemsets(enrich.transactions(*d.core)))


def _rule_text(df, *more):
    return df.select(joined("antecedent").alias("antecedent"), joined("consequent").alias("consequent"),
                     rounded("support"), rounded("confidence"), rounded("lift"), *more)


RULE_COLUMNS = "ante AS antecedent, cons AS consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


@query("M3_association_rules", "claims diagnoses procedures", RULES + f"SELECT {RULE_COLUMNS} FROM mined WHERE confidence >= 0.1")
def association_rules(d):
    """At confidence 0.1, where consequents of two items occur as well."""
    return _rule_text(mining.association_rules(_itemsets(d), 0.1))


@query("M4_filter_by_lift", "claims diagnoses procedures", RULES + f"SELECT {RULE_COLUMNS} FROM mined WHERE confidence >= 0.5 AND lift >= 1.1")
def filter_by_lift(d):
    return _rule_text(mining.filter_by_lift(mining.association_rules(_itemsets(d))))


def _atom(x):
    return f"""CASE WHEN {x} LIKE 'DIAG%' THEN concat('has_diagnosis(X, ''', substr({x}, 6), ''')')
    WHEN {x} LIKE 'PROC\\_%' ESCAPE '\\' THEN concat('has_procedure(X, ''', substr({x}, 6), ''')')
    WHEN {x} LIKE 'PROVIDER%' THEN concat('provider_type(X, ''', substr({x}, 10), ''')')
    WHEN {x} LIKE 'POS%' THEN concat('place_of_service(X, ''', substr({x}, 5), ''')')
    WHEN {x} = 'AGE_CHILD' THEN 'patient_age(X, Age) & (Age < 18)' WHEN {x} = 'AGE_SENIOR' THEN 'patient_age(X, Age) & (Age >= 65)'
    ELSE 'patient_age(X, Age) & (Age >= 18) & (Age < 65)' END"""


DEFINED = RULES + f"""
, kept AS (SELECT *, concat('If ', replace(ante, ',', ', '), ' then ', replace(cons, ',', ', ')) AS description FROM mined WHERE confidence >= 0.5 AND lift >= 1.1)
, atoms AS (SELECT description, i, string_split(ante, ',')[i] AS x FROM kept, range(1, 6) AS t(i) WHERE i <= len(string_split(ante, ',')))
, texts AS (SELECT description, concat('rule_applies(X) <= ', string_agg({_atom('x')}, ' & ' ORDER BY i)) AS rule_definition FROM atoms GROUP BY description)
"""


@query("M5_rule_definitions", "claims diagnoses procedures", DEFINED + """
SELECT concat('AssocRule_', cast(row_number() OVER (ORDER BY description) - 1 AS VARCHAR)) AS filter_name, description, rule_definition,
  'ASSOCIATION' AS rule_type, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift
FROM kept JOIN texts USING (description)""")
def rule_definitions(d):
    return mine_rules(*d.core).select(
        "filter_name", "description", "rule_definition", "rule_type", rounded("support"), rounded("confidence"), rounded("lift"))


@query("M6_definition_from_items", "claims diagnoses procedures", ITEM_CTE + f"""
SELECT claim_id, concat('rule_applies(X) <= ', string_agg({_atom('item')}, ' & ' ORDER BY item)) AS definition FROM tx GROUP BY claim_id""")
def definition_from_items(d):
    items = enrich.transactions(*d.core).withColumn("items", F.array_sort("items"))
    return items.select("claim_id", mining.definition_from_items("items").alias("definition"))


@query("M10_match_mined_rules", "claims diagnoses procedures", RULES + """
SELECT concat('If ', replace(ante, ',', ', '), ' then ', replace(cons, ',', ', ')) AS rule, ante_freq AS n_antecedent, freq AS n_both
FROM mined WHERE confidence >= 0.5 AND lift >= 1.1""")
def match_mined_rules(d):
    baskets = reuse(enrich.transactions(*d.core))
    mined = reuse(mining.filter_by_lift(mining.association_rules(reuse(mining.frequent_itemsets(baskets)))).withColumn(
        "filter_name", F.concat(F.lit("If "), joined("antecedent", ", "), F.lit(" then "), joined("consequent", ", "))))
    return mining.match_mined_rules(baskets, mined).withColumnRenamed("filter_name", "rule")

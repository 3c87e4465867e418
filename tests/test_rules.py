import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimloom.operators import enrich, mining, rules
from claimloom.plans import validate
from claimloom.plans.validate import validate_claims

RULES = [
    (1, "has_diagnosis(X, 'A') & patient_age(X, Age) & (Age > 65)"),
    (2, 'charge_amount(X, Amount) & provider_type(X, "R & D") & (Amount >= 100.5)'),
    (3, "has_diagnosis(X, Code) & patient_age(X, Age) & (Age < 18) & good(Code)"),
    (4, "has_diagnosis(X, Code) & good(Code) & rare(Code)"),
    (5, "rule_applies(X) <= patient_age(X, Age) & (Age >= 18) & (Age < 65)"),
    (6, "rule_applies(X) <= True"),
    (7, "has_procedure(X, Code)"),
    (8, "has_diagnosis(X, Code) & missing(Code)"),
    (9, "has_diagnosis(X, 'A') | has_diagnosis(X, 'B')"),
    (10, "unheard(X, 'A')"),
    (11, "(Age > 3)"),
    (12, "place_of_service(X, Place)"),
    (13, "patient_age(X, Age) & (Age != 18)"),
    (14, " & ".join(f"has_diagnosis(X, 'c{i}')" for i in range(70))),
    (15, "has_diagnosis(X, 'it's')"),
    (16, "has_diagnosis(X, 'A') & has_diagnosis(X, 'A')"),
]


@pytest.fixture(scope="module")
def data(spark):
    claims = spark.createDataFrame(
        [("a", 66, "R & D", "11", 100.5), ("b", 17, "R & D", None, 100.49), ("c", 18, None, "23", 1.0), ("d", 64, "X", "23", None),
         ("e", 65, "X", "23", 5.0), ("f", None, "X", "23", 5.0)],
        "claim_id string, patient_age int, provider_type string, place_of_service string, x double",
    ).withColumn("total_charge_amount", F.col("x").cast("decimal(12,2)")).drop("x")
    codes = [("a", "A"), ("a", "A"), ("b", "B"), ("b", None), ("c", "B"), ("c", "C"), ("d", "D")] + [("e", f"c{i}") for i in range(70)] + [("f", f"c{i}") for i in range(69)]
    diagnoses = spark.createDataFrame(codes, "claim_id string, diagnosis_code string").withColumns(
        {"diagnosis_type": F.lit("I"), "diagnosis_sequence": F.lit(1), "description": F.lit(""), "is_principal": F.lit(False)})
    procedures = spark.createDataFrame([("c", "P"), ("d", None)], "claim_id string, procedure_code string").withColumns(
        {"procedure_type": F.lit("C"), "procedure_sequence": F.lit(1), "description": F.lit(""), "charge_amount": F.lit(1).cast("decimal(10,2)"),
         "service_date": F.lit(None).cast("date"), "diagnosis_pointers": F.lit("[]")})
    filters = spark.createDataFrame([(i, f"rule {i}", r, i != 12) for i, r in RULES],
                                    "filter_id int, filter_name string, rule_definition string, active boolean").withColumn("description", F.lit("d")).withColumn("rule_type", F.lit("MANUAL"))
    sets = spark.createDataFrame([("good", "B"), ("good", "C"), ("rare", "C"), ("good", "B")], "set_name string, code string")
    return claims, diagnoses, procedures, filters, sets


PASSING = {
    ("a", 1), ("a", 2), ("a", 16), ("b", 3), ("c", 4), ("c", 5), ("c", 7), ("d", 5), ("e", 14),
    ("a", 13), ("b", 13), ("d", 13), ("e", 13),
} | {(c, 6) for c in "abcdef"}


def test_forms_agree(data):
    claims, dx, px, filters, sets = data
    measured = enrich.claim_measures(claims, dx, px)
    compiled = rules.evaluate_all_active(measured, filters, sets)
    pairs = claims.select("claim_id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("filter_id"))
    joined = rules.evaluate_rules(claims, dx, px, filters, sets, pairs)
    assert {(r.claim_id, r.filter_id) for r in compiled.filter("passed").collect()} == PASSING
    names = sorted(compiled.columns)
    assert sorted(compiled.select(names).collect()) == sorted(joined.select(names).collect())
    assert compiled.count() == 6 * 15  # rule 12 is inactive, ids above 16 are unknown


def test_errors_never_pass(data):
    claims, dx, px, filters, sets = data
    errors = {r.filter_id: r.error for r in rules.evaluate_all_active(enrich.claim_measures(claims, dx, px), filters, sets).collect()}
    assert errors[8] == "unknown code set: missing" and errors[10] == "unknown predicate: unheard"
    assert errors[11] == "unbound variable: Age" and errors[9] and errors[15] and errors[1] == ""


def test_coverage(data):
    claims, dx, px, filters, sets = data
    got = {r.filter_id: r.n_passed for r in rules.rule_coverage(claims, dx, px, filters, sets).collect()}
    for i in got:
        assert got[i] == len([p for p in PASSING if p[1] == i]), i


def test_coverage_drops_lines_that_no_rule_names(data):
    """Only lines with named codes are shuffled, but all of a kind if a rule asks whether there are any."""
    claims, dx, px, filters, sets = data
    tables = rules.RuleTables(filters, sets)
    kept = {r[0] for r in rules.named_lines(dx, "diagnosis_code", "diagnosis", tables, tables.rows).select("diagnosis_code").collect()}
    assert "A" in kept and "D" not in kept and None not in kept and {f"c{i}" for i in range(70)} <= kept
    assert rules.named_lines(px, "procedure_code", "procedure", tables, tables.rows).count() == px.count()
    assert rules.named_lines(px, "procedure_code", "procedure", tables, tables.rows.filter("filter_id <> 7")).count() == 0


def test_validation_keeps_prediction_order(spark, data, monkeypatch):
    claims, dx, px, filters, sets = data
    asked = spark.createDataFrame([("a", [6, 99, 1, 12]), ("b", [])], "claim_id string, predicted_filters array<int>")

    def shown():
        out = validate_claims(claims, dx, px, filters, sets, candidates=asked).collect()
        return {r.claim_id: ([o.filter_id for o in r.validation_results], r.validation_status) for r in out}

    want = {"a": ([6, 1], "COMPLETED"), **{c: ([], "COMPLETED") for c in "bcdef"}}
    assert shown() == want
    monkeypatch.setattr(validate, "COMPILED_IN_RUN", 3)  # larger rule sets take the joined form
    with pytest.raises(rules.TooManyRules):
        rules.compile_rules(filters, sets, 3)
    assert shown() == want


@pytest.mark.parametrize("most", [32, 3])
def test_repeated_and_missing_claim_ids_get_their_own_outcomes(data, monkeypatch, most):
    claims, dx, px, filters, sets = data
    monkeypatch.setattr(validate, "COMPILED_IN_RUN", most)
    monkeypatch.setattr(validate.learning, "predict_filters", lambda model, df, *_: df.withColumn(
        "predicted_filters", F.expr("array(6, 1)")))
    monkeypatch.setattr(validate.features, "feature_columns", lambda encoders, df: df)
    rows = claims.where("claim_id IN ('a', 'b')").withColumn("claim_id", F.nullif("claim_id", F.lit("b")))
    out = validate_claims(rows.unionAll(rows), dx, px, filters, sets, encoders=object(), model=object()).collect()
    assert sorted((r.claim_id or "", [o.filter_id for o in r.validation_results]) for r in out) == [("", [6, 1])] * 2 + [("a", [6, 1])] * 2


def test_all_active_beyond_the_compiled_limit(data, monkeypatch):
    claims, dx, px, filters, sets = data
    monkeypatch.setattr(rules, "COMPILED_RULES", 3)
    out = rules.evaluate_all_active(rules.coded_claims(claims, dx, px), filters, sets)
    assert out.count() == 6 * 15 and {(r.claim_id, r.filter_id) for r in out.filter("passed").collect()} == PASSING


def test_claim_without_id_is_an_error_result(data):
    claims, dx, px, filters, sets = data
    out = validate_claims(claims.withColumn("claim_id", F.nullif("claim_id", F.lit("a"))), dx, px, filters, sets).collect()
    assert sorted(r.validation_status for r in out) == ["COMPLETED"] * 5 + ["ERROR"]
    assert all(r.predicted_filters == [] for r in out)


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["c", "b", "a"]), ("3", ["a", "b", "b"]), ("4", ["c"])],
                                 "claim_id string, items array<string>")


def test_itemsets_and_rules(baskets):
    sets = mining.frequent_itemsets(baskets, 0.5)
    support = {tuple(r["items"]): r.support for r in sets.collect()}
    assert support[("a", "b")] == 0.75 and support[("a", "b", "c")] == 0.5
    found = {(tuple(r.antecedent), tuple(r.consequent)): r for r in mining.association_rules(sets, 0.5).collect()}
    assert found[("a",), ("b",)].confidence == 1.0 and abs(found[("a",), ("b",)].lift - 4 / 3) < 1e-12
    assert abs(found[("a",), ("b", "c")].confidence - 2 / 3) < 1e-12
    assert len(found) == 12  # every split of ab, ac, bc and abc reaches 0.5 here
    kept = mining.filter_by_lift(mining.association_rules(sets, 0.5), 1.1)
    assert kept.filter("lift < 1.1").count() == 0


def test_mined_rules_are_readable_rules(spark, baskets):
    df = spark.createDataFrame([(["DIAG_A", "AGE_CHILD", "POS_11"],), (["PROC_P", "PROVIDER_X", "AGE_ADULT"],), ([],)], "antecedent array<string>")
    texts = [r.t for r in df.select(mining.definition_from_items("antecedent").alias("t")).collect()]
    assert texts[0] == "rule_applies(X) <= has_diagnosis(X, 'A') & patient_age(X, Age) & (Age < 18) & place_of_service(X, '11')"
    assert texts[2] == "rule_applies(X) <= True"
    parsed = rules.rule_conditions(spark.createDataFrame(list(enumerate(texts)), "filter_id int, rule_definition string"))
    assert parsed.filter("error IS NOT NULL").count() == 0 and parsed.count() == 7
    defs = mining.rule_definitions(mining.association_rules(mining.frequent_itemsets(baskets, 0.5), 0.5)).collect()
    assert sorted(int(r.filter_name.split("_")[1]) for r in defs) == list(range(12))
    matched = {r.filter_name: r for r in mining.match_mined_rules(
        baskets, spark.createDataFrame([("r", ["a"], ["c"])], "filter_name string, antecedent array<string>, consequent array<string>")).collect()}
    assert (matched["r"].n_antecedent, matched["r"].n_both) == (3, 2)


def test_dyadic_pieces_make_up_their_interval(spark):
    rows = [(a, b) for a in range(17) for b in range(17)] + [(0, (1 << 20) - 1), (5, 1 << 19)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", rules.dyadic_pieces(F.col("a"), F.col("b"), 20).alias("p")).collect()
    for r in got:
        ends = sorted((p.prefix << p.level, (p.prefix + 1 << p.level) - 1) for p in r.p)
        if r.a > r.b:
            assert not ends
            continue
        assert ends[0][0] == r.a and ends[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(ends, ends[1:]))
        assert len(ends) <= 2 * max(1, (r.b - r.a).bit_length())


def test_many_rules_of_numbers_meet_few_claims(spark):
    """100,000 rules of ages and charges: claims only meet rules in whose interval they lie, whatever is shuffled."""
    n = 100_000
    ids = spark.range(n).withColumns({"lo": F.pmod(F.xxhash64("id"), F.lit(1_000_000)), "age": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90))})
    text = F.when(ids.id % 4 == 0, F.concat(F.lit("charge_amount(X, A) & (A >= "), F.format_string("%d.25", "lo"), F.lit(") & (A < "), (F.col("lo") + 400).cast("string"), F.lit(")"))) \
        .when(ids.id % 4 == 1, F.concat(F.lit("patient_age(X, G) & (G == "), F.col("age").cast("string"), F.lit(") & charge_amount(X, A) & (A > "), F.col("lo").cast("string"), F.lit(")"))) \
        .when(ids.id % 4 == 2, F.concat(F.lit("patient_age(X, G) & (G > "), F.col("age").cast("string"), F.lit(") & charge_amount(X, A) & (A >= "), F.col("lo").cast("string"), F.lit(") & (A <= "), (F.col("lo") + 900).cast("string"), F.lit(")"))) \
        .otherwise(F.concat(F.lit("charge_amount(X, A) & (A = "), F.format_string("%d.50", "lo"), F.lit(")")))
    filters = ids.select(F.col("id").cast("int").alias("filter_id"), F.col("id").cast("string").alias("filter_name"), text.alias("rule_definition"), F.lit(True).alias("active"), F.lit("").alias("description"))
    claims = spark.range(300).select(
        F.format_string("c%d", "id").alias("claim_id"), F.when(F.col("id") % 10 > 0, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(95)).cast("int")).alias("patient_age"),
        (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(100_000_000)) / 100).cast("decimal(12,2)").alias("total_charge_amount"), F.lit("P").alias("provider_type"), F.lit("11").alias("place_of_service"))
    claims = claims.unionByName(claims.limit(1).withColumns({"claim_id": F.lit("far"), "total_charge_amount": F.lit("9999999999.99").cast("decimal(12,2)")}))
    dx = spark.createDataFrame([], "claim_id string, diagnosis_code string")
    px = spark.createDataFrame([], "claim_id string, procedure_code string")
    sets = spark.createDataFrame([], "set_name string, code string")
    got = {r.filter_id: r.n_passed for r in rules.rule_coverage(claims, dx, px, filters, sets).collect()}
    rows = [(r.patient_age, float(r.total_charge_amount)) for r in claims.collect()]
    want = {}
    for r in ids.collect():
        k, lo, age = r.id % 4, r.lo, r.age
        met = {0: lambda g, a: lo + 0.25 <= a < lo + 400, 1: lambda g, a: g == age and a > lo, 2: lambda g, a: g is not None and g > age and lo <= a <= lo + 900, 3: lambda g, a: a == lo + 0.5}[k]
        want[r.id] = sum(met(*x) for x in rows)
    assert got == want
    tables = rules.RuleTables(filters, sets)
    met = rules.rule_hits(claims, rules.coded_claims(claims, dx, px), tables).count()
    assert sum(want.values()) <= met < 3 * sum(want.values()) + n // 10


def test_itemsets_by_levels_equal_all_subsets(spark):
    """Nulls and repeats in a basket count for nothing; supports are exact at the limit."""
    rng = random.Random(3)
    names = [f"i{k}" for k in range(9)]
    plain = [set(rng.sample(names, rng.randint(0, 6))) | ({"i1", "i4", "i7"} if rng.random() < 0.4 else set()) for _ in range(200)]
    rows = [(str(k), [*b, *list(b)[:2], None]) for k, b in enumerate(plain)] + [("none", None)]
    df = spark.createDataFrame(rows, "claim_id string, items array<string>").repartition(3)
    full = [b for b in plain if b]
    for least in (0.05, 0.2, 1.0):
        want = {c: f for k in range(1, 10) for c in combinations(names, k) if (f := sum(set(c) <= b for b in full)) and f / len(full) >= least}
        got = mining.frequent_itemsets(df, least).collect()
        assert {tuple(r["items"]): (r.freq, r.n, r.support) for r in got} == {c: (f, len(full), f / len(full)) for c, f in want.items()}
        assert len(got) == len(want)


def test_interval_rules_with_names_are_counted_exactly(spark, monkeypatch):
    """Bounds between cents, empty intervals, nulls, ages off the line, providers and places beside rules that are not intervals."""
    monkeypatch.setattr(rules, "COMPILED_RULES", 2)
    rng = random.Random(5)
    points = [(f"c{i}", rng.choice([None, -300, 0, 17, 18, 64, 65, 300]), rng.choice([None, "A", "B", ""]), rng.choice(["1", "2"]),
               rng.choice([None, "0.28", "0.29", "0.30", "1.00", "57.93", "-2.00", "9999999999.99"])) for i in range(120)]
    claims = spark.createDataFrame(points, "claim_id string, patient_age int, provider_type string, place_of_service string, x string") \
        .withColumn("total_charge_amount", F.col("x").cast("decimal(12,2)")).drop("x")
    ages = [None] + [(op, x) for op in ("<", "<=", ">", ">=", "==", "!=") for x in ("17", "17.5", "64", "299")]
    charges = [None] + [(op, x) for op in ("<", "<=", ">", ">=", "==") for x in ("0.29", "0.295", "57.93", "-2", "99999999999999")]
    texts, met = [], []
    for g in ages:
        for a in charges:
            who, where = rng.choice([None, "A", ""]), rng.choice([None, "2"])
            texts.append(" & ".join(
                ([f"patient_age(X, G) & (G {g[0]} {g[1]})"] if g else []) + ([f"charge_amount(X, A) & (A {a[0]} {a[1]}) & (A >= -1)"] if a else [])
                + ([f"provider_type(X, '{who}')"] if who is not None else []) + ([f"place_of_service(X, '{where}')"] if where else []) + ["True"]))
            test = lambda v, c: v is not None and {"<": v < float(c[1]), "<=": v <= float(c[1]), ">": v > float(c[1]), ">=": v >= float(c[1]), "==": v == float(c[1]), "!=": v != float(c[1])}[c[0]]
            met.append(sum((not g or test(p[1], g)) and (not a or p[4] is not None and test(float(p[4]), a) and float(p[4]) >= -1)
                           and (who is None or p[2] == who) and (not where or p[3] == where) for p in points))
    filters = spark.createDataFrame([(i, f"r{i}", t, True, "") for i, t in enumerate(texts)], "filter_id int, filter_name string, rule_definition string, active boolean, description string")
    none = [spark.createDataFrame([], f"claim_id string, {k}_code string") for k in ("diagnosis", "procedure")]
    sets = spark.createDataFrame([], "set_name string, code string")
    got = {r.filter_id: (r.n_passed, r.error) for r in rules.rule_coverage(claims, *none, filters, sets).collect()}
    assert got == {i: (n, "") for i, n in enumerate(met)}
    rows = rules.RuleTables(filters, sets).rows.filter(rules.countable(claims))
    assert rows.count() > 300


def test_counting_may_cut_between_any_two_rows(spark, monkeypatch):
    """Chunks end among claims of one charge, one provider and one place, and rules reach over many of them."""
    monkeypatch.setattr(rules, "COMPILED_RULES", 2)
    monkeypatch.setattr(rules, "CHUNK_ROWS", 60)
    rng = random.Random(8)
    points = [(f"c{i}", rng.choice([None, 3, 17, 18, 64, 90]), rng.choice([None, "A", "A", "B"]), rng.choice([None, "1", "2"]), rng.choice([None, "5.00", "5.00", "5.00", "7.25", "9.00"])) for i in range(700)]
    claims = spark.createDataFrame(points, "claim_id string, patient_age int, provider_type string, place_of_service string, x string") \
        .withColumn("total_charge_amount", F.col("x").cast("decimal(12,2)")).drop("x")
    texts, want = [], []
    for i in range(150):
        lo, hi, young, who, where = rng.choice([0, 5, 6]), rng.choice([5, 7.25, 8, 20]), rng.choice([None, 4, 18, 70]), rng.choice([None, None, "A", "C"]), rng.choice([None, None, "2"])
        charged = i % 5 > 0 or young is None
        texts.append(" & ".join(([f"charge_amount(X, A) & (A >= {lo}) & (A <= {hi})"] if charged else []) + ([f"patient_age(X, G) & (G < {young})"] if young else [])
                                + ([f"provider_type(X, '{who}')"] if who else []) + ([f"place_of_service(X, '{where}')"] if where else [])))
        want.append(sum((not charged or p[4] is not None and lo <= float(p[4]) <= hi) and (not young or p[1] is not None and p[1] < young)
                        and (not who or p[2] == who) and (not where or p[3] == where) for p in points))
    filters = spark.createDataFrame([(i, f"r{i}", t, True, "") for i, t in enumerate(texts)] + [(None, "none", texts[0], True, "")],
                                    "filter_id int, filter_name string, rule_definition string, active boolean, description string")
    none = [spark.createDataFrame([], f"claim_id string, {k}_code string") for k in ("diagnosis", "procedure")]
    sets = spark.createDataFrame([], "set_name string, code string")
    got = {r.filter_id: (r.n_claims, r.n_passed, r.error) for r in rules.rule_coverage(claims, *none, filters, sets).collect()}
    assert got == {i: (700, n, "") for i, n in enumerate(want)} | {None: (700, 0, "")}


def test_rules_read_alone_are_the_rules_read_apart(data, monkeypatch):
    """Ids that repeat share conditions, rules that ask for sets get their codes, the others are not taken apart."""
    _, _, _, filters, sets = data
    more = filters.filter("filter_id IN (1, 5)").withColumn("rule_definition", F.lit("place_of_service(X, '11')"))
    filters = filters.unionByName(more).unionByName(filters.limit(1).withColumn("filter_id", F.lit(None).cast("int")))
    columns = ["filter_id", "filter_name", "rule_type", "details", "error", "conditions"]

    def shown(rows):
        return sorted((str(r) for r in rows.select(columns).collect()))

    apart = shown(rules.rows_grouped(filters, sets))
    assert shown(rules.RuleTables(filters, sets).rows) == apart
    monkeypatch.setattr(rules, "COMPILED_RULES", 3)
    assert shown(rules.RuleTables(filters, sets).rows) == apart
    alone = rules.rows_alone(filters)
    assert {r.filter_id for r in alone.filter("in_sets").collect()} == {3, 4, 8}
    assert set(shown(alone.filter("NOT in_sets AND filter_id NOT IN (1, 5)"))) < set(apart)


def test_texts_with_marks_and_lines(spark):
    """Characters that stand for atoms while a rule is read are plain ones in a literal and no atoms beside it; a literal of several lines is empty."""
    texts = ["has_diagnosis(X, 'a\x01b\x02\x03')", "has_diagnosis(X, 'a') & \x01\x02\x01", "has_diagnosis(X, 'a\nb')", "has_diagnosis(X, '')", "patient_age(X, '6') & has_diagnosis(X, '#13')"]
    got = rules.rule_conditions(spark.createDataFrame(list(enumerate(texts)), "filter_id int, rule_definition string")).orderBy("filter_id", "cond_no").collect()
    assert [(r.filter_id, r.op, r.value_str, r.value_num) for r in got] == [
        (0, "=", "a\x01b\x02\x03", None), (1, "error", None, None), (2, "=", "", None), (3, "=", "", None), (4, "==", None, 6.0), (4, "=", "#13", None)]


def test_rules_are_dealt_out_before_they_are_read(spark):
    """Rules that one task holds are read by several."""
    text = F.concat(F.lit("has_diagnosis(X, '"), F.sha2(F.col("id").cast("string"), 512), F.lit("')"))
    filters = spark.range(0, 40_000, 1, 1).select(F.col("id").cast("int").alias("filter_id"), text.alias("rule_definition"))
    per_task = rules.rule_conditions(filters).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) > 1 and sum(r["count"] for r in per_task) == 40_000


def plain_rules(itemsets, n, least):
    freq = {tuple(sorted(i)): f for i, f in itemsets}
    out = set()
    for items, f in freq.items():
        for mask in range(1, (1 << len(items)) - 1):
            cons = tuple(x for k, x in enumerate(items) if mask >> k & 1)
            ante = tuple(x for k, x in enumerate(items) if not mask >> k & 1)
            if ante in freq and cons in freq and f / freq[ante] >= least:
                out.add((ante, cons, round(f / freq[ante], 9), round(f / freq[ante] / (freq[cons] / n), 9)))
    return out


def test_rules_by_levels_equal_all_splits(spark):
    rng = random.Random(6)
    baskets = [set(rng.sample("abcdefg", rng.randint(1, 6))) | ({"a", "b", "c"} if rng.random() < 0.5 else set()) for _ in range(60)]
    sets = [c for k in range(1, 8) for c in combinations("abcdefg", k)]
    itemsets = [(list(c), sum(set(c) <= b for b in baskets)) for c in sets]
    itemsets = [(c, f) for c, f in itemsets if f >= 3]
    df = spark.createDataFrame([(c, f, 60, f / 60) for c, f in itemsets], "items array<string>, freq long, n long, support double")
    for least in (0.3, 0.8):
        got = {(tuple(r.antecedent), tuple(r.consequent), round(r.confidence, 9), round(r.lift, 9)) for r in mining.association_rules(df, least).collect()}
        assert got == plain_rules(itemsets, 60, least) and got


def test_rules_of_twenty_five_items(spark):
    """Only what is confident is followed: four items may follow from the others, alone or in pairs."""
    items = [f"i{k:02}" for k in range(25)]
    freq = {tuple(items): 90}
    for k in (1, 2):
        for gone in combinations(items, k):
            rest = tuple(x for x in items if x not in gone)
            freq[rest] = 100 if set(gone) <= set(items[:4]) else 1_000
            freq[gone] = 500
    df = spark.createDataFrame([(list(c), f, 1_000, f / 1_000) for c, f in freq.items()], "items array<string>, freq long, n long, support double")
    got = {(tuple(r.consequent), round(r.confidence, 6)) for r in mining.association_rules(df, 0.9).filter(F.size("antecedent") + F.size("consequent") == 25).collect()}
    assert got == {(c, 0.9) for k in (1, 2) for c in combinations(items[:4], k)}

"""Claims with no children, null codes, copies, two principals, and one claim with most lines."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import enrich, ranking
from claimloom.operators.numbering import assign_chunks, number_rows, running_totals


@pytest.fixture(scope="module")
def tables(spark):
    claims = spark.createDataFrame(
        [("none", 1, "PENDING"), ("nulls", 2, "PENDING"), ("copies", 3, "PENDING"), ("two", 4, "PENDING"), ("old", 5, "COMPLETED")],
        "claim_id string, patient_age int, processing_status string",
    ).withColumns({"provider_type": F.lit("P"), "place_of_service": F.lit("11"), "total_charge_amount": F.lit(1).cast("decimal(12,2)"),
                   "service_date": F.lit("2024-01-01").cast("date")})
    diagnoses = spark.createDataFrame(
        [("nulls", None, 1, True), ("copies", "A", 1, False), ("copies", "A", 1, False), ("copies", "B", None, False),
         ("two", "C", 2, True), ("two", "D", 1, True), ("old", "E", 1, True), ("orphan", "Z", 1, True)],
        "claim_id string, diagnosis_code string, diagnosis_sequence int, is_principal boolean",
    ).withColumns({"diagnosis_type": F.lit("ICD10"), "description": F.concat(F.lit("about "), "diagnosis_code")})
    procedures = spark.createDataFrame(
        [("copies", "P1", 1, 10.5), ("copies", "P1", 1, 10.5), ("copies", "P2", 2, None), ("two", "P1", 1, 3.0)],
        "claim_id string, procedure_code string, procedure_sequence int, c double",
    ).withColumns({"charge_amount": F.col("c").cast("decimal(10,2)"), "procedure_type": F.lit("CPT"), "description": F.lit("x"),
                   "service_date": F.lit("2024-01-01").cast("date"), "diagnosis_pointers": F.lit("[1]")}).drop("c")
    return claims, diagnoses, procedures


def test_arrays(tables):
    out = {r.claim_id: r for r in enrich.enrich_claims(*tables).collect()}
    assert set(out) == {"none", "nulls", "copies", "two"}
    assert out["none"].diagnoses == [] and out["nulls"].diagnoses == []
    assert [x.code for x in out["copies"].diagnoses] == ["A", "B"]
    assert [x.code for x in out["copies"].procedures] == ["P1", "P2"]
    assert out["copies"].procedures[0].diagnosis_pointers == [1]


def test_lines_are_aggregated_once_per_side(tables):
    plan = enrich.enrich_claims(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_codes_of_a_page_take_only_its_lines(tables):
    claims, dx, px = tables
    few = claims.filter("claim_id IN ('copies', 'none')").select("claim_id")
    found = enrich.page_codes(few, dx, px)
    assert sorted(found.collect()) == sorted(enrich.claim_codes(few, dx, px).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("strategy=broadcast") >= 2


def test_measures_agree_with_arrays(tables):
    fields = ["claim_id", "diagnosis_count", "procedure_count", "primary_diagnosis", "total_procedure_amount"]
    arrays = S.with_claim_measures(enrich.enrich_claims(*tables)).select(fields)
    claims = tables[0].filter("processing_status = 'PENDING'")
    direct = enrich.claim_measures(claims, *tables[1:]).select(fields)
    assert sorted(arrays.collect()) == sorted(direct.collect())
    got = {r.claim_id: r for r in direct.collect()}
    assert got["two"].primary_diagnosis == "C" and got["none"].primary_diagnosis is None
    assert got["copies"].total_procedure_amount == 10.5 or str(got["copies"].total_procedure_amount) == "10.50"


def test_raw_summary_equals_the_plain_join(tables):
    claims, dx, px = tables
    plain = claims.select("claim_id").join(dx, "claim_id", "left").join(px.drop("description", "service_date"), "claim_id", "left").groupBy("claim_id").agg(
        F.sort_array(F.transform(F.collect_list(F.struct("diagnosis_code")), lambda s: s["diagnosis_code"])).alias("diagnoses"),
        F.sort_array(F.transform(F.collect_list(F.struct("procedure_code")), lambda s: s["procedure_code"])).alias("procedures"))
    assert sorted(plain.collect(), key=lambda r: r.claim_id) == sorted(enrich.claim_summary_raw(*tables).collect(), key=lambda r: r.claim_id)


def test_training_rows_per_prediction_list(spark, tables):
    results = spark.createDataFrame(
        [("old", "COMPLETED", "[1]"), ("old", "COMPLETED", "[1]"), ("old", "COMPLETED", None), ("old", "ERROR", "[9]"), ("two", "COMPLETED", "[5]")],
        "claim_id string, validation_status string, predicted_filters string")
    rows = enrich.training_set(*tables, results).collect()
    assert sorted(r.applied_filters for r in rows) == [[], [1]]


def test_transactions(tables):
    (row,) = enrich.transactions(*tables).collect()
    assert row["items"] == ["DIAG_E", "PROVIDER_P", "POS_11", "AGE_CHILD"]


def test_one_claim_holds_most_lines(spark):
    claims = spark.createDataFrame([("hot",), ("cold",)], "claim_id string")
    lines = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("claim_id"), (F.col("id") % 700).cast("string").alias("diagnosis_code"),
        F.lit("T").alias("diagnosis_type"), (F.col("id") % 3).cast("int").alias("diagnosis_sequence"), F.lit("x").alias("description"),
        F.lit(False).alias("is_principal"))
    px = spark.createDataFrame([], "claim_id string, procedure_code string, procedure_type string, procedure_sequence int, description string, "
                                   "charge_amount decimal(10,2), service_date date, diagnosis_pointers string")
    got = {r.claim_id: r for r in enrich.claim_measures(claims, lines, px).collect()}
    want = {r.claim_id: r.n for r in lines.distinct().groupBy("claim_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v.diagnosis_count for k, v in got.items()} == want


def test_facts_skip_nulls(tables):
    kinds = {(r.claim_id, r.kind, r.value) for r in enrich.facts(*tables).collect()}
    assert ("copies", "diagnosis", "A") in kinds and not [k for k in kinds if k[2] is None]
    assert len([k for k in kinds if k[0] == "copies" and k[1] == "diagnosis"]) == 2


def test_principal_rank(tables):
    first = {r.claim_id: r.diagnosis_code for r in ranking.principal_rank(tables[1]).collect()}
    assert first["two"] == "C" and first["copies"] == "A"  # as in the array form


def test_numbering_equals_global_row_number(spark):
    df = spark.range(5_000).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("k"), "id")
    got = [r.n for r in number_rows(df, ["k", "id"], "n").orderBy("k", "id").collect()]
    assert got == list(range(1, 5_001))
    nulls = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, id long")
    assert sorted((r.id, r.n) for r in number_rows(nulls, ["k", "id"], "n").collect()) == [(1, 1), (2, 3), (3, 2)]
    assert number_rows(df.limit(0), ["k", "id"], "n").count() == 0


def test_running_totals_per_group(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = running_totals(df, {"t": F.col("v")}, ["id"], ["g"]).orderBy("g", "id").collect()
    for g in range(3):
        total = 0
        for r in [x for x in got if x.g == g]:
            total += r.v
            assert r.t == total


def test_chunks(spark):
    sizes = assign_chunks(spark.range(1_050).select(F.col("id").cast("string").alias("claim_id")), 500).groupBy("chunk_id").count().collect()
    assert sorted((r.chunk_id, r["count"]) for r in sizes) == [(1, 500), (2, 500), (3, 50)]


def test_top_filters(spark):
    rows = [
        ([(1, 0.1), (2, 0.3)], []),
        ([(3, 0.5), (1, 0.9), (2, 0.5)], [1, 3, 2]),
        ([(0, 0.9), (4, 0.4)], [4]),
        ([(i, 0.31 + i / 100) for i in range(1, 13)], [12, 11, 10, 9, 8, 7, 6, 5, 4, 3]),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "s array<struct<filter_id:int,prob:double>>")
    assert [r.v for r in df.select(ranking.top_filters(F.col("s")).alias("v")).collect()] == [r[1] for r in rows]

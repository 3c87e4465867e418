import json

import pytest
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.sources import files, synth, tables
from claimloom.streaming.claims import claims_stream, dedupe_stream, validate_stream


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('claim_id,patient_id,provider_id,total_charge_amount,patient_age\nC1,P1,"D, MD",150.00,35\nC2,P2,D2,oops,\n')
    rows = files.read_claims_csv(spark, str(good)).collect()
    assert [(r.claim_id, r.provider_id, r.patient_age) for r in rows] == [("C1", "D, MD", 35), ("C2", "D2", None)]
    assert str(rows[0].total_charge_amount) == "150.00" and rows[1].total_charge_amount is None
    bad = tmp_path / "bad.csv"
    bad.write_text("claim_id,provider_id\nC1,D1\n")
    with pytest.raises(ValueError, match=r"\['patient_id', 'total_charge_amount'\]"):
        files.read_claims_csv(spark, str(bad))


def test_json(spark, tmp_path):
    claim = {"claim_id": "C1", "patient_id": "P", "provider_id": "D", "total_charge_amount": 1.5, "claim_data": {"payer": "x"}}
    for name, content in {"list": [claim, {**claim, "claim_id": "C2"}], "object": {"claims": [claim, {**claim, "claim_id": "C2"}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
        rows = files.read_claims_json(spark, str(tmp_path / f"{name}.json")).orderBy("claim_id").collect()
        assert [r.claim_id for r in rows] == ["C1", "C2"] and json.loads(rows[0].claim_data) == {"payer": "x"}
    (tmp_path / "wrong.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="Invalid JSON structure"):
        files.read_claims_json(spark, str(tmp_path / "wrong.json")).collect()


def test_code_files(spark, tmp_path):
    (tmp_path / "row.csv").write_text("A, B,,C\nignored\n")
    (tmp_path / "col.csv").write_text("A\n\n B \n")
    (tmp_path / "blank.csv").write_text("\n")

    def codes(name):
        return [r.code for r in files.read_code_list(spark, str(tmp_path / name), ["D1"]).orderBy("position").collect()]

    assert codes("row.csv") == ["A", "B", "C"] and codes("col.csv") == ["A", "B"]
    assert codes("blank.csv") == ["D1"] and codes("absent.csv") == ["D1"]


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    assert tables.ensure_tables(spark, root) == ["validation_results", "validation_results_archive"]
    assert tables.ensure_tables(spark, root) == []
    assert spark.read.parquet(f"{root}/validation_results_archive").schema.fieldNames() == schemas.VALIDATION_RESULTS_ARCHIVE.fieldNames()
    df = spark.createDataFrame([("a", "COMPLETED", [1], [], None, "", None)], schemas.VALIDATION_RESULTS)
    tables.write_results(df, f"{root}/validation_results")
    assert tables.read_table(spark, f"{root}/validation_results").count() == 1
    tables.clear_tables(spark, root, ["validation_results"])
    assert tables.read_table(spark, f"{root}/validation_results").count() == 0
    tables.reset_tracking(spark, root)
    assert tables.read_table(spark, f"{root}/retry_queue").count() == 0


def test_synthetic_claims(spark):
    claims, dx, px = synth.synth_claims(spark, 2_000, "2024-12-31", seed=1)
    c = claims.agg(F.count_distinct("claim_id").alias("ids"), F.count_distinct("provider_id").alias("npis"), F.min("patient_age").alias("lo"),
                   F.max("patient_age").alias("hi"), F.min("total_charge_amount").alias("cheap"), F.max("total_charge_amount").alias("dear"),
                   F.min("service_date").cast("string").alias("first"), F.min(F.length("provider_id")).alias("w")).first()
    assert (c.ids, c.npis, c.w) == (2_000, 2_000, 10) and 1 <= c.lo <= c.hi <= 95 and 25 <= c.cheap <= c.dear <= 5000 and c["first"] >= "2022-12-31"
    d = dx.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("diagnosis_code").alias("k"), F.count_if("is_principal").alias("p"))
    assert d.count() == 2_000 and d.filter("n <> k OR p <> 1 OR n > 5").count() == 0
    bad = px.join(dx.groupBy("claim_id").agg(F.max("diagnosis_sequence").alias("top")), "claim_id").filter(
        F.exists(F.from_json("diagnosis_pointers", "array<int>"), lambda x: (x > F.col("top")) | (x < 1)))
    assert bad.count() == 0 and px.filter("diagnosis_pointers = '[]'").count() == 0
    same = synth.synth_claims(spark, 2_000, "2024-12-31", seed=1)[0]
    assert claims.exceptAll(same).count() == 0 and same.exceptAll(claims.repartition(5)).count() == 0
    assert set(json.loads(claims.first().claim_data)) == set(schemas.PAYLOAD.fieldNames())


def test_stream_is_restartable_and_drops_repeats(spark, tmp_path):
    claims, dx, px = synth.synth_claims(spark, 60, "2024-12-31")
    rows = files.as_claims(claims).withColumn("created_date", F.lit("2024-12-31").cast("timestamp"))
    first, second = rows.filter(F.col("claim_id") < "CLM_00000020"), rows.filter(F.col("claim_id") >= "CLM_00000018")
    filters = spark.createDataFrame([(1, "all", "True", True, "d", "M")],
                                    "filter_id int, filter_name string, rule_definition string, active boolean, description string, rule_type string")
    sets = spark.createDataFrame([], schemas.CODE_SETS)
    asked = rows.select("claim_id", F.array(F.lit(1)).alias("predicted_filters"))

    def run():
        stream = dedupe_stream(claims_stream(spark, f"{tmp_path}/in"))
        q = validate_stream(stream, dx, px, filters, sets, f"{tmp_path}/out", f"{tmp_path}/cp", candidates=asked).trigger(availableNow=True).start()
        q.awaitTermination()

    first.write.parquet(f"{tmp_path}/in")
    run()
    second.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.claim_id for r in out.select("claim_id").collect()) == sorted(r.claim_id for r in rows.select("claim_id").collect())
    assert out.filter("validation_results[0].passed").count() == 60
    assert out.filter("postprocessed_at < preprocessed_at OR pipeline_stage <> 'postprocessing'").count() == 0

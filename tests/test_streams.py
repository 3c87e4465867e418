"""Streams that keep state: what comes late, what expires, and what a restart does."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import metrics
from claimloom.streaming.alerts import ALERT, alert_stream
from claimloom.streaming.assemble import assemble_stream, validate_assembled
from claimloom.streaming.claims import dedupe_stream
from claimloom.streaming.state import ON_DISK, state_on_disk

START = datetime(2024, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, writer):
    with state_on_disk(spark):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    with state_on_disk(spark):
        assert all(spark.conf.get(k) == v for k, v in ON_DISK.items())
    assert {k: spark.conf.get(k, None) for k in ON_DISK} == before


def test_repeats_within_the_time_go_and_keys_expire_over_a_restart(spark, tmp_path):
    kind = "claim_id string, at timestamp"

    def go(*rows):
        put(spark, tmp_path / "in", rows, kind)
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        run(spark, dedupe_stream(stream, "claim_id", "at", "60 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
        return sorted((r.claim_id, r.at) for r in spark.read.schema(kind).parquet(str(tmp_path / "out")).collect())

    assert go(("a", at(0)), ("b", at(5)), ("a", at(0))) == [("a", at(0)), ("b", at(5))]
    assert len(go(("a", at(30)), ("c", at(40)))) == 3  # restarted; the repeat is known
    go(("d", at(300)))
    assert ("a", at(310)) in go(("a", at(310)))  # its key has expired
    assert ("late", at(1)) not in go(("late", at(1)), ("e", at(320)))  # behind the watermark


def test_sessions_of_one_claim_in_a_batch_keep_their_own_lines(spark, tmp_path):
    """Lines are measured in the row of their session; nothing is joined by claim_id again."""
    line = "struct<diagnosis_code:string,diagnosis_type:string,diagnosis_sequence:int,description:string,is_principal:boolean>"
    step = "struct<procedure_code:string,procedure_type:string,procedure_sequence:int,description:string,charge_amount:decimal(10,2),service_date:date,diagnosis_pointers:string>"
    claim = ("a", 40, "X", "11", None)
    rows = [("a", claim, [("A", "T", 1, "d", True)] * 2, [], at(0)), ("a", claim, [(None, "T", 1, "d", True)], [("P", "T", 1, "d", None, None, None)], at(90)), ("b", None, [], [], at(0))]
    batch = spark.createDataFrame(rows, f"claim_id string, claim struct<claim_id:string,patient_age:int,provider_type:string,place_of_service:string,total_charge_amount:decimal(12,2)>, diagnoses array<{line}>, procedures array<{step}>, last_at timestamp")
    batch.withColumn("session", F.lit(1)).write.parquet(str(tmp_path / "in"))
    filters = spark.createDataFrame([(1, "A", "has_diagnosis(X, 'A')", "", "MANUAL", True)], "filter_id int, filter_name string, rule_definition string, description string, rule_type string, active boolean")
    asked = spark.createDataFrame([("a", [1])], "claim_id string, predicted_filters array<int>")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run(spark, validate_assembled(stream, filters, spark.createDataFrame([], "set_name string, code string"), str(tmp_path / "out"), str(tmp_path / "cp"), candidates=asked))
    assert sorted(o.passed for r in spark.read.parquet(str(tmp_path / "out/results")).collect() for o in r.validation_results) == [False, True]


def test_measures_of_lines_in_a_row_are_those_of_the_tables(spark):
    from claimloom.operators import enrich

    diagnoses = spark.createDataFrame([
        ("a", "B", "T", 2, "d", False), ("a", "A", "T", None, "d", None), ("a", "B", "T", 2, "d", False), ("a", None, "T", 0, "d", True),
        ("b", "C", "T", 1, "d", False), ("b", "Z", "T", 5, "e", True), ("b", "Y", "T", 6, None, True),
    ], "claim_id string, diagnosis_code string, diagnosis_type string, diagnosis_sequence int, description string, is_principal boolean")
    procedures = spark.createDataFrame([("a", "P", "T", 1, "d", None, None, None), ("b", "Q", "T", 1, "d", "1", None, "[1]"), ("b", "Q", "T", 1, "d", "1", None, "[1]"), ("b", "O", "T", 1, "d", "2", None, "[1]")],
        "claim_id string, procedure_code string, procedure_type string, procedure_sequence int, description string, charge string, service_date date, diagnosis_pointers string")
    procedures = procedures.withColumn("charge_amount", F.col("charge").cast("decimal(10,2)")).drop("charge")
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "claim_id string")
    want = enrich.claim_measures(claims, diagnoses, procedures)
    rows = claims
    for name, df in (("diagnoses", diagnoses), ("procedures", procedures)):
        rows = rows.join(df.groupBy("claim_id").agg(F.collect_list(F.struct(*df.columns)).alias(name)), "claim_id", "left")
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    got = rows.select("claim_id", *[c.alias(n) for n, c in enrich.line_measures("diagnoses", "procedures").items()]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_meet_their_claim_whenever_they_come(spark, tmp_path):
    kinds = {
        "claims": "claim_id string, patient_age int, provider_type string, place_of_service string, total_charge_amount decimal(12,2), processing_status string, arrived_at timestamp",
        "diagnoses": "claim_id string, diagnosis_code string, diagnosis_sequence int, is_principal boolean, diagnosis_type string, description string, arrived_at timestamp",
        "procedures": "claim_id string, procedure_code string, procedure_sequence int, charge_amount decimal(10,2), procedure_type string, description string, service_date date, diagnosis_pointers string, arrived_at timestamp",
    }
    filters = spark.createDataFrame([(1, "A", "has_diagnosis(X, 'A') & has_procedure(X, 'P')", "", "MANUAL", True)], "filter_id int, filter_name string, rule_definition string, description string, rule_type string, active boolean")
    sets = spark.createDataFrame([], "set_name string, code string")

    def go(claims=(), diagnoses=(), procedures=(), clock=0):
        end = lambda n: tuple([None] * n + [at(clock)])
        put(spark, tmp_path / "claims", [(i, 40, "X", "11", None, "PENDING", at(t)) for i, t in claims] + [end(6)], kinds["claims"])
        put(spark, tmp_path / "diagnoses", [(i, c, 1, True, "T", "d", at(t)) for i, c, t in diagnoses] + [end(6)], kinds["diagnoses"])
        put(spark, tmp_path / "procedures", [(i, c, 1, None, "T", "d", None, None, at(t)) for i, c, t in procedures] + [end(8)], kinds["procedures"])
        streams = [spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in kinds.items()]
        asked = spark.createDataFrame([(i, [1]) for i in "abcde"], "claim_id string, predicted_filters array<int>")
        run(spark, validate_assembled(assemble_stream(*streams), filters, sets, str(tmp_path / "out"), str(tmp_path / "cp"), candidates=asked))
        got = {r.claim_id: [o.passed for o in r.validation_results] for r in spark.read.parquet(str(tmp_path / "out/results")).collect()}
        lone = sorted((r.claim_id, [x.diagnosis_code for x in r.diagnoses]) for r in spark.read.parquet(str(tmp_path / "out/without_claim")).collect())
        return got, lone

    # a: lines before and after, in different runs; b: without procedures; c: nothing but the claim; d: lines only
    assert go([("b", 1), ("c", 1)], [("a", "A", 0), ("d", "A", 2)], [], 5) == ({}, [])
    assert go([("a", 20)], [("b", "A", 6)], [("a", "P", 45)], 48) == ({"b": [False], "c": [False]}, [("d", ["A"])])
    got, lone = go(clock=200)
    assert got == {"a": [True], "b": [False], "c": [False]} and lone == [("d", ["A"])]
    got, lone = go([("e", 230)], [("c", "A", 229), ("e", "A", 231)], [("e", "P", 231)], 400)
    assert got["e"] == [True] and ("c", ["A"]) in lone  # a line long after its claim stands alone


def test_alerts_fire_once_over_restarts_and_go_on_without_events(spark, tmp_path):
    kind = "ts timestamp, failed boolean"
    rows = [(at(m) + timedelta(seconds=s), m in (3, 4, 5, 6, 7) or s == 7) for m in (*range(0, 12), 40, 41) for s in range(0, 60, 3)]
    limits = dict(max_error_rate=0.1, error_minutes=2, idle_minutes=10, idle_for=10)

    def go(rows, ticks):
        put(spark, tmp_path / "in", rows, kind)
        put(spark, tmp_path / "ticks", [(t,) for t in ticks], "ts timestamp")
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        clock = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "ticks"))
        found = alert_stream(stream, clock, **limits)
        run(spark, found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
        return sorted((r.alert, r.fired_at) for r in spark.read.schema(ALERT).parquet(str(tmp_path / "out")).collect())

    early, late = [r for r in rows if r[0] < at(6)], [r for r in rows if r[0] >= at(6)]
    first = go(early, [at(0)])
    got = go(late, [at(20)])
    assert set(first) <= set(got)
    want = sorted((r.alert, r.fired_at) for r in metrics.alerts(spark.createDataFrame(rows, kind), **limits).collect())
    assert [a for a, _ in want].count("HighErrorRate") > 2 and "ProcessingStopped" in [a for a, _ in want]
    got = go([], [at(90)])
    assert len(got) == len(set(got)) and [x for x in got if x[1] <= at(42)] == want
    # nothing is processed from 12:42 on: idle evaluations begin when ten minutes are empty, and the eleventh fires
    after = [t for a, t in got if t > at(42)]
    assert after == [at(m) for m in range(62, 90)] and {a for a, t in got if t > at(42)} == {"ProcessingStopped"}


def test_repeats_within_the_hour_arrive_in_many_files(spark, monkeypatch, tmp_path):
    from claimloom.catalog import QUERIES, streams
    from claimloom.llm.storage import settings

    monkeypatch.setattr(streams, "scratch", lambda *_: f"file://{tmp_path}")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = {r.claim_id: r.n_passed for r in QUERIES["X3_dedupe_within"](spark, "/root/testdata/sf0.001").collect()}
    assert got and all(n == (2 if int(c[-10:]) % 3 == 0 else 1) for c, n in got.items())
    assert all(len(list((tmp_path / "in").rglob(p))) > 1 for p in ("part0/*.parquet", "part1/*.parquet", "part4/*.parquet"))


def test_claims_arrive_in_a_bounded_number_of_files(spark, tmp_path):
    from claimloom.catalog import streams
    from claimloom.catalog.views import Data
    from claimloom.llm.storage import settings

    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="40"):
        d = Data(spark, "/root/testdata/sf0.001")
        streams._arriving(d, f"file://{tmp_path}")
        assert spark.read.parquet(f"file://{tmp_path}/in").count() == d.claims.count()
    assert 1 < len(list((tmp_path / "in").glob("*.parquet"))) <= streams.ARRIVING_FILES

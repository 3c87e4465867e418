from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import lifecycle, reports

NOW = datetime(2024, 6, 1, 12, 0, 0)


def claims(spark):
    return spark.createDataFrame(
        [("a", "PENDING", None), ("b", "COMPLETED", datetime(2024, 1, 1)), ("c", "SENT", None)],
        "claim_id string, processing_status string, processed_date timestamp")


def statuses(df):
    return {r.claim_id: (r.processing_status, r.processed_date) for r in df.collect()}


def test_update_from_unknown_and_repeated_ids(spark):
    updates = spark.createDataFrame([("a", "SENT", 1), ("a", "RETRY", 2), ("zzz", "SENT", 3), ("b", "PENDING", 4)],
                                    "claim_id string, new_status string, update_no int")
    got = statuses(lifecycle.update_from(claims(spark), updates, NOW))
    assert got == {"a": ("RETRY", NOW), "b": ("PENDING", NOW), "c": ("SENT", None)}


def test_mark_processed_leaves_completed_alone(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("zzz",)], "claim_id string")
    got = statuses(lifecycle.mark_processed(claims(spark), ids, NOW))
    assert got["a"] == ("COMPLETED", NOW) and got["b"] == ("COMPLETED", datetime(2024, 1, 1)) and got["c"] == ("SENT", None)
    assert lifecycle.mark_processed_count(claims(spark), ids).first().updated == 1


def test_advance_status_uses_the_newest_result(spark):
    results = spark.createDataFrame(
        [(1, "a", "ERROR", NOW), (2, "a", "COMPLETED", NOW), (3, "c", "ERROR", NOW), (4, "b", "ERROR", NOW)],
        "result_id long, claim_id string, validation_status string, created_date timestamp")
    got = statuses(lifecycle.advance_status(claims(spark), results, NOW))
    assert got["a"] == ("COMPLETED", NOW) and got["c"] == ("RETRY", None) and got["b"][0] == "COMPLETED"


QUEUE = "chunk_id int, error_message string, retry_count long, resolved boolean, created_date timestamp, last_retry_date timestamp"


def test_upsert_retry(spark):
    old = spark.createDataFrame([(1, "x", 3, False, NOW, None), (2, "y", 1, True, NOW, None)], QUEUE)
    later = NOW + timedelta(hours=1)
    failures = spark.createDataFrame(
        [(1, "again", NOW, 1), (1, "last", later, 2), (3, "first", NOW, 3), (4, "p", NOW, 4), (4, "q", later, 5)],
        "chunk_id int, error_message string, failed_at timestamp, event_id long")
    got = {r.chunk_id: r for r in lifecycle.upsert_retry(old, failures).collect()}
    assert (got[1].retry_count, got[1].error_message, got[1].created_date, got[1].last_retry_date) == (5, "last", NOW, later)
    assert (got[2].retry_count, got[2].resolved, got[2].error_message) == (1, True, "y")
    assert (got[3].retry_count, got[3].last_retry_date) == (1, None)
    assert (got[4].retry_count, got[4].error_message, got[4].last_retry_date) == (2, "q", later)
    queue = lifecycle.upsert_retry(old, failures)
    assert [r.chunk_id for r in lifecycle.retry_candidates(queue).collect()] == [3, 4]
    assert {r.chunk_id: r.next_status for r in lifecycle.retry_failed(queue).collect()} == {1: "ERROR", 3: "RETRY", 4: "RETRY"}


def test_archive_and_purge_share_the_cutoff(spark):
    rows = spark.createDataFrame(
        [(1, NOW - timedelta(days=90, seconds=1)), (2, NOW - timedelta(days=90)), (3, NOW - timedelta(days=89)), (4, None)],
        "result_id long, created_date timestamp")
    assert [r.result_id for r in lifecycle.archive_old(rows, NOW).collect()] == [1]
    assert sorted(r.result_id for r in lifecycle.purge_old(rows, NOW).collect()) == [2, 3, 4]


def test_upsert_chunks(spark):
    schema = "chunk_id long, status string, processed_date timestamp, claims_count long, processing_duration_seconds double"
    old = spark.createDataFrame([(1, "PROCESSING", None, 0, 0.0), (2, "COMPLETED", NOW, 5, 1.0)], schema)
    new = spark.createDataFrame([(1, "x", NOW, 500, 2.0), (1, "x", NOW + timedelta(1), 499, 3.0), (3, "x", NOW, 1, 1.0)], schema)
    got = {r.chunk_id: (r.status, r.claims_count) for r in lifecycle.upsert_chunks(old, new).collect()}
    assert got == {1: ("COMPLETED", 499), 2: ("COMPLETED", 5), 3: ("COMPLETED", 1)}


def test_insert_claims_once(spark):
    old = spark.createDataFrame([("a", "COMPLETED")], "claim_id string, processing_status string")
    new = spark.createDataFrame([("a", "SENT", 1), ("b", None, 2), ("b", "SENT", 1), ("c", None, 1), (None, "SENT", 1)],
                                "claim_id string, processing_status string, line int")
    got = {r.claim_id: r.processing_status for r in lifecycle.insert_claims(old, new, ["line"]).collect()}
    assert got == {"a": "COMPLETED", "b": "SENT", "c": "PENDING"}


def test_filters_get_ids_in_name_order(spark):
    schema = "filter_id int, filter_name string, rule_definition string, rule_type string, active boolean"
    old = spark.createDataFrame([(1, "x", "True", "MANUAL", True), (5, "y", "True", "ASSOCIATION", True)], schema)
    new = spark.createDataFrame([("x", "no", "MANUAL"), ("b", "r2", "MANUAL"), ("a", "r1", "MANUAL"), ("b", "r0", "MANUAL")],
                                "filter_name string, rule_definition string, rule_type string")
    got = {r.filter_name: (r.filter_id, r.rule_definition, r.active) for r in lifecycle.insert_filters(old, new).collect()}
    assert got == {"x": (1, "True", True), "y": (5, "True", True), "a": (6, "r1", True), "b": (7, "r0", True)}
    mined = new.filter("rule_definition <> 'r2'").withColumns({"rule_type": F.lit("ASSOCIATION"), "active": F.lit(True)})
    assert sorted((r.filter_id, r.filter_name) for r in lifecycle.replace_rules(old, mined).collect()) == [(1, "x"), (2, "a"), (3, "b"), (4, "x")]


def test_result_defaults(spark):
    rows = spark.createDataFrame([("a", None, None, None, None, None)],
                                 "claim_id string, validation_status string, predicted_filters array<int>, validation_results array<struct<filter_id:int>>, "
                                 "processing_time decimal(10,6), error_message string")
    r = lifecycle.normalize_results(rows, NOW).first()
    assert (r.validation_status, r.predicted_filters, r.validation_details, float(r.processing_time), r.error_message, r.created_date) == (
        "COMPLETED", "[]", "[]", 0.0, "", NOW)


RESULTS = "result_id long, claim_id string, validation_status string, processing_time decimal(10,6), error_message string, created_date timestamp"


def test_reports_on_no_rows_and_on_errors_only(spark):
    none = spark.createDataFrame([], RESULTS)
    r = reports.validation_statistics(none, 30, NOW).first()
    assert (r.total_validations, r.avg_processing_time, r.success_rate, r.earliest_validation) == (0, 0.0, 0.0, None)
    assert reports.validation_trends(none, 7, NOW).count() == 0
    bad = spark.createDataFrame([(1, "a", "ERROR", None, "", NOW), (2, "b", "ERROR", None, "boom", NOW), (3, "c", "ERROR", None, None, NOW)], RESULTS)
    r = reports.validation_statistics(bad, 30, NOW).first()
    assert (r.total_validations, r.failed_validations, r.success_rate) == (3, 3, 0.0)
    assert [x.result_id for x in reports.recent_errors(bad).collect()] == [2]

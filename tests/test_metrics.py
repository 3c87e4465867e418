from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import metrics

T0 = datetime(2024, 3, 1, 0, 0, 0)


def events(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), bad) for s, bad in rows], "ts timestamp, failed boolean")


def fired(df, name):
    return sorted(int((r.fired_at - T0).total_seconds() // 60) for r in df.filter(F.col("alert") == name).collect())


def test_processing_stopped_needs_the_gap_and_the_duration(spark):
    def minutes(gap):
        return fired(metrics.alerts(events(spark, [(0, False), (60 * gap, False)])), "ProcessingStopped")

    # An event at minute 0 is seen by the evaluations at minutes 1 to 10; the first idle one is at 11.
    assert minutes(9) == [] and minutes(10) == [] and minutes(20) == []
    assert minutes(25) == [21, 22, 23, 24, 25]


def test_error_burst_must_last(spark):
    ok = [(60 * m, False) for m in range(30)]
    short = ok + [(600, True)] * 31
    got = fired(metrics.alerts(events(spark, short)), "HighErrorRate")
    assert got == [13, 14, 15]  # above the limit at minutes 11 to 15, so lasting from 13 on
    assert fired(metrics.alerts(events(spark, ok + [(600, True)] * 30)), "HighErrorRate") == []


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (100.0,), (None,)], "v double")
    got = {r.le: r for r in metrics.duration_histogram(df, "v", [0.1, 0.5]).collect()}
    assert [got[k].cumulative_count for k in ("0.1", "0.5", "+Inf")] == [1, 2, 3]
    assert got["0.1"].total_count == 3 and abs(got["0.1"].total_sum - 100.3) < 1e-9
    empty = metrics.duration_histogram(df.limit(0), "v").collect()
    assert {r.cumulative_count for r in empty} == {0}


def test_run_report_without_results(spark):
    claims = spark.createDataFrame([], "claim_id string")
    results = spark.createDataFrame([], "validation_status string")
    chunks = spark.createDataFrame([], "status string, claims_count long, processing_duration_seconds decimal(10,3)")
    r = metrics.run_report(claims, results, chunks).first()
    assert r.progress_percent == 0.0 and r.claims_per_hour == 0.0 and r.remaining == 0


def test_interval_rate_against_a_plain_loop(spark):
    rows = [(T0 + timedelta(seconds=37 * i + (i % 5)), i, i / 1000) for i in range(200)] + [(T0 + timedelta(hours=5), 999, 0.5)]
    df = spark.createDataFrame(rows, "created_date timestamp, result_id long, processing_time double")
    got = metrics.interval_rate(df, 30, recent=50).orderBy("interval_start").collect()
    rows.sort()
    seen = 0
    for k, r in enumerate(got):
        end = T0 + timedelta(seconds=30 * (k + 1))
        upto = [x for x in rows if x[0] < end]
        assert r.processed == len(upto) and abs(r.rate - (len(upto) - seen) / 30) < 1e-9
        last = [x[2] for x in upto[-50:]]
        assert abs(r.avg_time - sum(last) / len(last)) < 1e-6
        seen = len(upto)
    assert seen == len(rows)


def test_logs(spark):
    lines = spark.createDataFrame([
        ("2024-01-01 - app - ERROR - it - broke",), ("2024-01-01 - app - INFO - fine",), ("no separators ERROR",),
        ("2024-01-01 - db - CRITICAL - 123-45-6789",)], "line string")
    parsed = metrics.parse_log_lines(lines).collect()
    assert parsed[0].message == "it - broke" and parsed[2].level is None
    assert {(r.pattern, r.n) for r in metrics.error_patterns(lines).collect()} == {("ERROR", 1), ("CRITICAL", 1), (None, 1)}
    masked = metrics.redact_log_record(metrics.parse_log_lines(lines)).collect()
    assert masked[3].message == "XXX-XX-XXXX" and masked[3].logger == "db"
    js = spark.createDataFrame([('{"timestamp": "t", "level": "ERROR", "logger": "l", "message": "dob 1/2/1990", "line": 7}',)], "line string")
    r = metrics.redact_log_record(metrics.parse_log_json(js)).first()
    assert (r.level, r.message, r.line_no) == ("ERROR", "DOB: XX/XX/XXXX", 7)


def test_recent_error_window(spark):
    rows = [(T0, "ERROR"), (T0 - timedelta(hours=23), "CRITICAL"), (T0 - timedelta(hours=25), "ERROR"), (T0, "INFO")]
    df = spark.createDataFrame(rows, "ts timestamp, line string")
    r = metrics.recent_error_count(df, T0).first()
    assert (r.error_count, r.healthy) == (2, True)
    assert metrics.recent_error_count(df, T0, threshold=2).first().healthy is False

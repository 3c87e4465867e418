"""Queries: reports, top-k selections, rates and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.assembly import TRAINING
from claimloom.catalog.registry import query
from claimloom.operators import enrich, features, metrics, numbering, ranking, reports


def newest(df, column):
    """The largest value of a column as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def text(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


AVG = "cast(sum({0}) AS DOUBLE) / count({0})"
CHARGE = "round(" + AVG.format("total_charge_amount") + ", 4)"
TIME = "round(coalesce(" + AVG.format("processing_time") + ", 0), 6)"


def rounded(name, places=6):
    return F.round(name, places).alias(name)


STATUS = f"""SELECT processing_status, count(*) AS claim_count, {CHARGE} AS avg_charge,
  cast(min(service_date) AS VARCHAR) AS earliest_service, cast(max(service_date) AS VARCHAR) AS latest_service"""


@query("A1_status_summary", "claims", f"{STATUS} FROM claims GROUP BY processing_status")
def status_summary(d):
    return reports.status_summary(d.claims).select(
        "processing_status", "claim_count", rounded("avg_charge", 4), *text("earliest_service", "latest_service"))


@query("A2_processing_statistics", "claims", f"""{STATUS},
  (SELECT count(*) FROM claims) AS total_claims,
  (SELECT count(*) FROM claims WHERE processing_status IN ('PENDING', 'SENT', 'RETRY')) AS unprocessed_count
FROM claims GROUP BY processing_status""")
def processing_statistics(d):
    return reports.processing_statistics(d.claims).select(
        "processing_status", "claim_count", rounded("avg_charge", 4), *text("earliest_service", "latest_service"),
        "total_claims", "unprocessed_count")


@query("A3_daily_processing", "claims", f"""
SELECT cast(cast(processed_date AS DATE) AS VARCHAR) AS processing_date, count(*) AS claims_processed, {CHARGE} AS avg_charge_amount,
  count(DISTINCT provider_type) AS unique_providers FROM claims WHERE processed_date IS NOT NULL GROUP BY 1""")
def daily_processing(d):
    return reports.daily_processing(d.claims).select(
        *text("processing_date"), "claims_processed", rounded("avg_charge_amount", 4), "unique_providers")


@query("A4_status_distribution", "claims", """
SELECT processing_status, count(*) AS claim_count,
  CASE WHEN processing_status = 'PENDING' THEN (count(*) + 499) // 500 ELSE 0 END AS expected_chunks FROM claims GROUP BY 1""")
def status_distribution(d):
    return reports.status_distribution(d.claims)


@query("A5_chunk_status", "chunks", """
SELECT status, count(*) AS chunks, cast(coalesce(sum(claims_count), 0) AS BIGINT) AS total_claims_in_chunks FROM chunks GROUP BY status""")
def chunk_status(d):
    return reports.chunk_status(d.chunks)


VALIDATION = f"""count(*) AS total_validations,
  count(*) FILTER (validation_status = 'COMPLETED') AS successful_validations,
  count(*) FILTER (validation_status = 'ERROR') AS failed_validations, {TIME} AS avg_processing_time,
  round(count(*) FILTER (validation_status = 'COMPLETED') / count(*) * 100, 6) AS success_rate"""
SINCE = "WHERE created_date >= (SELECT max(created_date) FROM results) - INTERVAL '{0}' DAY"


@query("A6_validation_statistics", "results", f"""
SELECT {VALIDATION}, cast(min(created_date) AS VARCHAR) AS earliest_validation, cast(max(created_date) AS VARCHAR) AS latest_validation
FROM results {SINCE.format(20)}""")
def validation_statistics(d):
    return reports.validation_statistics(d.results, 20, newest(d.results, "created_date")).select(
        "total_validations", "successful_validations", "failed_validations", rounded("avg_processing_time"),
        rounded("success_rate"), *text("earliest_validation", "latest_validation"))


@query("A7_validation_trends", "results", f"""
SELECT cast(cast(created_date AS DATE) AS VARCHAR) AS validation_date, {VALIDATION} FROM results {SINCE.format(7)} GROUP BY 1""")
def validation_trends(d):
    return reports.validation_trends(d.results, 7, newest(d.results, "created_date")).select(
        *text("validation_date"), "total_validations", "successful_validations", "failed_validations",
        rounded("avg_processing_time"), rounded("success_rate"))


@query("A8_daily_rollup", "results", f"""
SELECT cast(cast(created_date AS DATE) AS VARCHAR) AS processing_date, count(*) AS total_claims,
  count(*) FILTER (validation_status = 'COMPLETED') AS successful_validations,
  count(*) FILTER (validation_status <> 'COMPLETED') AS failed_validations,
  count(*) FILTER (validation_status = 'ERROR') AS error_count, {TIME} AS avg_processing_time FROM results GROUP BY 1""")
def daily_rollup(d):
    return reports.daily_rollup(d.results).select(
        *text("processing_date"), "total_claims", "successful_validations", "failed_validations", "error_count",
        rounded("avg_processing_time"))


@query("A9_processing_report", "claims", """
, c AS (SELECT *, cast(service_date AS TIMESTAMP) AS created_date, processed_date AS updated_date FROM claims)
SELECT count(*) AS total_claims, count(*) FILTER (processing_status = 'COMPLETED') AS completed_claims,
  round(avg(CASE WHEN processing_status = 'COMPLETED' THEN epoch(updated_date) - epoch(created_date) END), 6) AS avg_processing_seconds,
  cast(max(created_date) AS VARCHAR) AS latest_claim_date
FROM c WHERE created_date >= (SELECT max(created_date) FROM c) - INTERVAL '30' DAY""")
def processing_report(d):
    claims = d.claims.withColumns({
        "created_date": F.col("service_date").cast("timestamp_ntz"), "updated_date": F.col("processed_date")})
    return reports.processing_report(claims, newest(claims, "created_date")).select(
        "total_claims", "completed_claims", rounded("avg_processing_seconds"), *text("latest_claim_date"))


@query("A10_filter_pass_report", "results", """
, o AS (SELECT claim_id, processing_time, created_date, unnest(CASE predicted_filters WHEN '[1, 2]' THEN [1, 2] WHEN '[3]' THEN [3]
  ELSE [NULL] END) AS filter_id, result_id FROM results)
SELECT count(*) AS total_validations, count(*) FILTER ((result_id + filter_id) % 3 = 0) AS passed_validations,
  round(coalesce(cast(sum(processing_time) AS DOUBLE) / count(processing_time), 0), 6) AS avg_validation_time,
  count(DISTINCT claim_id) AS unique_claims_validated
FROM o WHERE created_date >= (SELECT max(created_date) FROM results) - INTERVAL '10' DAY""")
def filter_pass_report(d):
    stored = _stored(d.results)
    return reports.filter_pass_report(reports.explode_results(stored), newest(d.results, "created_date"), 10).select(
        "total_validations", "passed_validations", rounded("avg_validation_time"), "unique_claims_validated")


def _stored(results):
    """Results with outcome structs derived from the predicted ids."""
    from claimloom.functions.scalars import applied_filters

    return results.withColumn("validation_results", F.transform(
        applied_filters("predicted_filters"),
        lambda i: F.struct(
            i.alias("filter_id"), F.concat(F.lit("Filter "), i).alias("filter_name"),
            ((F.col("result_id") + i) % 3 == 0).alias("passed"), F.lit("DATALOG").alias("rule_type"),
            F.lit("").alias("details"), F.lit("").alias("error"))))


@query("V6_explode_results", "results", """
, o AS (SELECT result_id, claim_id, unnest(CASE predicted_filters WHEN '[1, 2]' THEN [1, 2] WHEN '[3]' THEN [3] ELSE [NULL] END) AS filter_id FROM results)
SELECT result_id, claim_id, cast(filter_id AS INT) AS filter_id, CASE WHEN filter_id IS NOT NULL THEN concat('Filter ', cast(filter_id AS VARCHAR)) END AS filter_name,
  (result_id + filter_id) % 3 = 0 AS passed FROM o""")
def explode_results(d):
    return reports.explode_results(_stored(d.results)).select("result_id", "claim_id", "filter_id", "filter_name", "passed")


@query("A11_label_distribution", "claims diagnoses procedures results", TRAINING + """
, l AS (SELECT claim_id, unnest(CASE applied_filters WHEN '1,2' THEN [1, 2, 0] WHEN '3' THEN [3, 0] ELSE [0] END) AS label FROM training)
SELECT cast(label AS INT) AS label, count(*) AS n FROM l GROUP BY 1""")
def label_distribution(d):
    return reports.label_distribution(features.label_examples(enrich.training_set(*d.core, d.results)))


@query("A12_duration_histogram", sql="""
SELECT b.le, count(*) FILTER (value <= b.bound) AS cumulative_count, count(value) AS total_count,
  round(cast(sum(cast(value AS DECIMAL(22,6))) AS DOUBLE), 4) AS total_sum
FROM events, (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('30.0', 30.0), ('60.0', 60.0),
  ('+Inf', 1e300)) AS b(le, bound) GROUP BY b.le""")
def duration_histogram(d):
    return metrics.duration_histogram(d.events, "value").select(
        "le", "cumulative_count", "total_count", F.round("total_sum", 4).alias("total_sum"))


RUN = """
, r AS (SELECT count(*) AS total_results, count(*) FILTER (validation_status = 'COMPLETED') AS processed,
  count(*) FILTER (validation_status = 'ERROR') AS errors FROM results)
, s AS (SELECT cast(coalesce(sum(claims_count) FILTER (status = 'FAILED'), 0) AS BIGINT) AS storage_errors,
  cast(coalesce(sum(processing_duration_seconds), 0) AS DOUBLE) AS seconds FROM chunks)
"""


@query("A13_metrics_summary", "results chunks", RUN + """
SELECT processed AS claims_processed, errors AS validation_errors, storage_errors, round(seconds, 4) AS total_duration_seconds,
  round(processed / seconds * 3600, 4) AS processing_rate_per_hour FROM r, s""")
def metrics_summary(d):
    return metrics.metrics_summary(d.results, d.chunks).select(
        "claims_processed", "validation_errors", "storage_errors",
        rounded("total_duration_seconds", 4), rounded("processing_rate_per_hour", 4))


@query("A14_run_report", "claims results chunks", RUN + """
, c AS (SELECT count(*) AS total FROM claims)
SELECT total AS total_claims, processed AS total_processed, errors AS total_errors, round(seconds, 4) AS duration_seconds,
  round(processed / seconds * 3600, 4) AS claims_per_hour, round(processed / total * 100, 4) AS progress_percent,
  greatest(total - processed, 0) AS remaining, round(processed / total_results * 100, 4) AS success_rate,
  round(processed / seconds, 4) AS throughput_per_second, round(seconds / (processed / 1000), 4) AS avg_batch_seconds FROM r, s, c""")
def run_report(d):
    names = ["duration_seconds", "claims_per_hour", "progress_percent", "success_rate", "throughput_per_second", "avg_batch_seconds"]
    out = metrics.run_report(d.claims, d.results, d.chunks)
    return out.withColumns({n: F.round(n, 4) for n in names})


@query("A15_error_patterns", "log_lines", """
SELECT split_part(line, ' - ', 3) AS pattern, count(*) AS n FROM log_lines WHERE regexp_matches(line, 'ERROR|CRITICAL') GROUP BY 1""")
def error_patterns(d):
    return metrics.error_patterns(d.log_lines)


@query("A16_recent_error_count", "log_lines", """
SELECT count(*) AS error_count, count(*) < 10 AS healthy FROM log_lines
WHERE regexp_matches(line, 'ERROR|CRITICAL') AND ts > (SELECT max(ts) FROM log_lines) - INTERVAL '1' DAY""")
def recent_error_count(d):
    return metrics.recent_error_count(d.log_lines, newest(d.log_lines, "ts"))


@query("A17_claim_counts", "claims", """
SELECT count(*) FILTER (processing_status = 'PENDING') AS pending,
  count(*) FILTER (processing_status IN ('PENDING', 'SENT', 'RETRY')) AS unprocessed,
  count(*) FILTER (processing_status = 'COMPLETED') AS training FROM claims""")
def claim_counts(d):
    return reports.claim_counts(d.claims)


# --- top-k and windows ----------------------------------------------------

def _score_arrays(d):
    prob = lambda c: ((F.col("o_orderkey") * 31 + c * 17) % 10) / 10
    return d.orders.select(
        "o_orderkey", F.concat(F.lit("CLM_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("claim_id"),
        F.transform(F.sequence(F.lit(1), F.lit(20)), lambda c: F.struct(c.alias("filter_id"), prob(c).alias("prob"))).alias("scores"))


SCORES = """
WITH s AS (SELECT concat('CLM_', lpad(cast(o_orderkey AS VARCHAR), 10, '0')) AS claim_id, c AS filter_id,
    cast(((o_orderkey * 31 + c * 17) % 10) AS DOUBLE) / 10 AS prob FROM orders, range(1, 21) AS t(c))
, ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY prob DESC, filter_id) AS rank FROM s WHERE prob > 0.3)
"""


@query("W1_top_filters", sql=SCORES + """
SELECT claim_id, string_agg(cast(filter_id AS VARCHAR), ',' ORDER BY rank) AS predicted FROM ranked WHERE rank <= 10 GROUP BY claim_id""")
def top_filters(d):
    return _score_arrays(d).select(
        "claim_id", F.array_join(ranking.top_filters(F.col("scores")).cast("array<string>"), ",").alias("predicted"))


@query("W1_top_filter_rows", sql=SCORES + """
SELECT claim_id, cast(filter_id AS INT) AS filter_id, prob, cast(rank AS INT) AS rank FROM ranked WHERE rank <= 10""")
def top_filter_rows(d):
    rows = _score_arrays(d).select("claim_id", F.explode("scores").alias("s")).select("claim_id", "s.*")
    return ranking.top_filter_rows(rows)


@query("W2_recent_avg_time", "results", """
SELECT count(*) AS sampled, round(cast(sum(processing_time) AS DOUBLE) / count(processing_time), 9) AS avg_processing_time
FROM (SELECT * FROM results ORDER BY created_date DESC, result_id DESC LIMIT 1000)""")
def recent_avg_time(d):
    return ranking.recent_avg_time(d.results).select("sampled", rounded("avg_processing_time", 9))


@query("W3_interval_rate", "results", """
, r AS (SELECT cast(floor(epoch(created_date) / 30) * 30 AS BIGINT) AS tick,
    row_number() OVER (ORDER BY created_date, result_id) AS n,
    sum(coalesce(processing_time, 0)) OVER (ORDER BY created_date, result_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS recent FROM results)
, e AS (SELECT tick, count(*) AS c, max(n) AS n, max_by(recent, n) AS recent FROM r GROUP BY tick)
, g AS (SELECT unnest(range((SELECT min(tick) FROM r), (SELECT max(tick) + 30 FROM r), 30)) AS tick)
, f AS (SELECT g.tick, coalesce(e.c, 0) AS c, max(e.n) OVER (ORDER BY g.tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g LEFT JOIN e ON e.tick = g.tick)
SELECT f.tick AS interval_start, f.n AS processed, round(f.c / 30, 6) AS rate,
  round(cast(r.recent AS DOUBLE) / least(f.n, 1000), 9) AS avg_time FROM f JOIN r ON r.n = f.n""")
def interval_rate(d):
    return metrics.interval_rate(d.results).select(
        F.unix_timestamp("interval_start").alias("interval_start"), "processed", rounded("rate"), rounded("avg_time", 9))


@query("W4_assign_chunks", "claims", """
SELECT claim_id, cast((row_number() OVER (ORDER BY claim_id) + 499) // 500 AS INT) AS chunk_id FROM claims WHERE processing_status = 'PENDING'""")
def assign_chunks(d):
    return numbering.assign_chunks(reports.pending_claims(d.claims).select("claim_id"), 500)


@query("W5_principal_rank", "diagnoses", """
, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY is_principal DESC,
    CASE WHEN is_principal THEN 0 ELSE coalesce(diagnosis_sequence, 999) END, diagnosis_code, diagnosis_type, diagnosis_sequence, description) AS rank
  FROM diagnoses WHERE diagnosis_code IS NOT NULL)
SELECT claim_id, diagnosis_code, diagnosis_sequence, is_principal, cast(rank AS INT) AS rank FROM r""")
def principal_rank(d):
    return ranking.principal_rank(d.diagnoses, None).select(
        "claim_id", "diagnosis_code", "diagnosis_sequence", "is_principal", "rank")


@query("L1_recent_errors", "results", """
SELECT result_id, claim_id, error_message, cast(created_date AS VARCHAR) AS created_date, cast(processing_time AS DOUBLE) AS processing_time
FROM results WHERE validation_status = 'ERROR' AND error_message IS NOT NULL AND error_message <> ''
ORDER BY results.created_date DESC, result_id DESC LIMIT 100""")
def recent_errors(d):
    return reports.recent_errors(d.results).withColumns({
        "created_date": F.col("created_date").cast("string"), "processing_time": F.col("processing_time").cast("double")})


# --- rates and alerts -------------------------------------------------------

def _events(d):
    return d.events.select("ts", (F.col("event_type") == "error").alias("failed"))


PER_MINUTE = """
WITH m AS (SELECT cast(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute, count(*) FILTER (event_type <> 'error') AS ok,
  count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
"""


def _trailing(name, minutes):
    return f", {name} AS (SELECT minute + 60 * k AS tick, sum(ok) / {60 * minutes} AS ok, sum(bad) / {60 * minutes} AS bad FROM m, range(1, {minutes + 1}) AS t(k) GROUP BY 1)\n"


@query("X4_windowed_rate", sql=PER_MINUTE + _trailing("w", 5) +
       "SELECT cast(tick AS BIGINT) AS window_end, round(ok, 6) AS processed_rate, round(bad, 6) AS error_rate FROM w")
def windowed_rate(d):
    return metrics.windowed_rate(_events(d)).select(
        F.unix_timestamp("window_end").alias("window_end"), rounded("processed_rate"), rounded("error_rate"))


@query("X5_alerts", sql=PER_MINUTE + _trailing("w5", 5) + _trailing("w10", 10) + """
, g AS (SELECT unnest(range((SELECT min(minute) + 60 FROM m), (SELECT max(minute) + 120 FROM m), 60)) AS tick)
, v AS (SELECT g.tick, coalesce(w5.bad, 0) > 0.005 AS high, coalesce(w10.ok, 0) = 0 AS idle
  FROM g LEFT JOIN w5 ON w5.tick = g.tick LEFT JOIN w10 ON w10.tick = g.tick)
, f AS (SELECT tick, count(*) FILTER (high) OVER (ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h,
  count(*) FILTER (idle) OVER (ORDER BY tick ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS i FROM v)
SELECT 'HighErrorRate' AS alert, 'warning' AS severity, cast(tick AS BIGINT) AS fired_at FROM f WHERE h = 3
UNION ALL SELECT 'ProcessingStopped', 'critical', cast(tick AS BIGINT) FROM f WHERE i = 11""")
def alerts(d):
    return metrics.alerts(_events(d), max_error_rate=0.005).withColumn("fired_at", F.unix_timestamp("fired_at"))

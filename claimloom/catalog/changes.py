"""Queries: inserts, status changes, upserts, archive and retry handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.registry import ORACLES, query, scratch
from claimloom.catalog.reporting import newest, text
from claimloom.operators import lifecycle
from claimloom.sources import buckets
from claimloom.functions.scalars import applied_filters


def claim_number(modulus):
    return F.right("claim_id", F.lit(10)).cast("long") % modulus


NUMBER = "cast(right(claim_id, 10) AS BIGINT)"


@query("S5_insert_claims", "claims", f"""
, old AS (SELECT * FROM claims WHERE {NUMBER} % 3 <> 0)
, batch AS (SELECT claim_id, provider_id, 1 AS line, processing_status FROM claims WHERE {NUMBER} % 2 = 0
  UNION ALL SELECT claim_id, 'late copy', 2, 'SENT' FROM claims)
, fresh AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY line) AS rn FROM batch b
  WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.claim_id = b.claim_id))
SELECT claim_id, provider_id, processing_status FROM old
UNION ALL SELECT claim_id, provider_id, CASE WHEN processing_status = 'RETRY' THEN 'PENDING' ELSE processing_status END FROM fresh WHERE rn = 1""")
def insert_claims(d):
    columns = ["claim_id", "provider_id", "processing_status"]
    old = d.claims.filter(claim_number(3) != 0).select(*columns)
    first = d.claims.filter(claim_number(2) == 0).select(
        "claim_id", "provider_id", F.nullif("processing_status", F.lit("RETRY")).alias("processing_status"), F.lit(1).alias("line"))
    second = d.claims.select("claim_id", F.lit("late copy").alias("provider_id"), F.lit("SENT").alias("processing_status"), F.lit(2).alias("line"))
    return lifecycle.insert_claims(old, first.unionByName(second), ["line"])


def _part_filters(d):
    """Candidate filters, one per part name, repeated across parts."""
    return d.part.select(
        F.concat(F.lit("Part "), "p_name").alias("filter_name"),
        F.concat(F.lit("has_diagnosis(X, '"), "p_brand", F.lit("')")).alias("rule_definition"),
        F.concat(F.lit("From "), "p_name").alias("description"), F.lit("MANUAL").alias("rule_type"))


@query("S6_insert_filters", "filters", """
, new AS (SELECT concat('Part ', p_name) AS filter_name, min(concat('has_diagnosis(X, ''', p_brand, ''')')) AS rule_definition FROM part GROUP BY 1)
SELECT filter_id, filter_name, rule_definition, active FROM filters
UNION ALL SELECT cast(9 + row_number() OVER (ORDER BY filter_name) AS INT), filter_name, rule_definition, true FROM new""")
def insert_filters(d):
    return lifecycle.insert_filters(d.filters, _part_filters(d).unionByName(d.filters.drop("filter_id", "active"))).select(
        "filter_id", "filter_name", "rule_definition", "active")


@query("S7_replace_rules", "filters", """
, new AS (SELECT concat('Part ', p_name) AS filter_name, min(concat('has_diagnosis(X, ''', p_brand, ''')')) AS rule_definition FROM part GROUP BY 1)
SELECT filter_id, filter_name, rule_definition, rule_type FROM filters WHERE rule_type <> 'ASSOCIATION'
UNION ALL SELECT cast(9 + row_number() OVER (ORDER BY filter_name) AS INT), filter_name, rule_definition, 'ASSOCIATION' FROM new""")
def replace_rules(d):
    mined = _part_filters(d).groupBy("filter_name").agg(F.min("rule_definition").alias("rule_definition")).withColumns(
        {"rule_type": F.lit("ASSOCIATION"), "active": F.lit(True)})
    return lifecycle.replace_rules(d.filters, mined).select("filter_id", "filter_name", "rule_definition", "rule_type")


@query("S8_normalize_results", "results", """
SELECT claim_id, validation_status, CASE predicted_filters WHEN '[1, 2]' THEN '[1,2]' WHEN '[3]' THEN '[3]' ELSE '[]' END AS predicted_filters,
  '[]' AS validation_details, cast(processing_time AS DOUBLE) AS processing_time, coalesce(error_message, '') AS error_message,
  cast((SELECT max(created_date) FROM results) AS VARCHAR) AS created_date FROM results""")
def normalize_results(d):
    raw = d.results.withColumns({
        "predicted_filters": F.when(F.col("predicted_filters").isNotNull(), applied_filters("predicted_filters")),
        "validation_results": F.lit(None).cast("array<struct<filter_id:int,passed:boolean>>"),
        "validation_status": F.nullif("validation_status", F.lit("COMPLETED")),
    })
    return lifecycle.normalize_results(raw, newest(d.results, "created_date")).withColumns({
        "processing_time": F.col("processing_time").cast("double"), "created_date": F.col("created_date").cast("string")})


@query("U1_append", "results", """
SELECT result_id, claim_id, validation_status FROM results WHERE validation_status = 'ERROR'
UNION ALL SELECT result_id, claim_id, validation_status FROM results""")
def append(d):
    rows = d.results.select("result_id", "claim_id", "validation_status")
    return lifecycle.append(rows.filter(F.col("validation_status") == "ERROR"), rows)


@query("U2_dedupe", "diagnoses", "SELECT DISTINCT claim_id, diagnosis_code FROM diagnoses")
def dedupe(d):
    return lifecycle.dedupe(d.diagnoses.select("claim_id", "diagnosis_code"))


CHANGED = "SELECT claim_id, processing_status, cast(processed_date AS VARCHAR) AS processed_date FROM changed"


def _changed(df):
    return df.select("claim_id", "processing_status", *text("processed_date"))


@query("J8_update_from", "claims results", f"""
, u AS (SELECT claim_id, max_by(CASE WHEN validation_status = 'ERROR' THEN 'RETRY' ELSE 'SENT' END, result_id) AS s FROM results GROUP BY claim_id)
, changed AS (SELECT c.claim_id, coalesce(u.s, processing_status) AS processing_status,
  CASE WHEN u.s IS NOT NULL THEN (SELECT max(created_date) FROM results) ELSE processed_date END AS processed_date FROM claims c LEFT JOIN u USING (claim_id))
{CHANGED}""")
def update_from(d):
    updates = d.results.select(
        "claim_id", F.when(F.col("validation_status") == "ERROR", "RETRY").otherwise("SENT").alias("new_status"),
        F.col("result_id").alias("update_no"))
    return _changed(lifecycle.update_from(d.claims, updates, newest(d.results, "created_date")))


@query("J9_mark_processed", "claims results", f"""
, changed AS (SELECT claim_id, CASE WHEN hit THEN 'COMPLETED' ELSE processing_status END AS processing_status,
  CASE WHEN hit THEN (SELECT max(created_date) FROM results) ELSE processed_date END AS processed_date
  FROM (SELECT *, processing_status <> 'COMPLETED' AND claim_id IN (SELECT claim_id FROM results) AS hit FROM claims))
{CHANGED}""")
def mark_processed(d):
    return _changed(lifecycle.mark_processed(d.claims, d.results, newest(d.results, "created_date")))


@query("J9_mark_processed_count", "claims results", """
SELECT count(*) AS updated FROM claims WHERE processing_status <> 'COMPLETED' AND claim_id IN (SELECT claim_id FROM results)""")
def mark_processed_count(d):
    return lifecycle.mark_processed_count(d.claims, d.results)


@query("K1_advance_status", "claims results", f"""
, u AS (SELECT claim_id, max_by(validation_status, result_id) AS s FROM results GROUP BY claim_id)
, changed AS (SELECT c.claim_id, CASE WHEN processing_status = 'COMPLETED' OR u.s IS NULL THEN processing_status WHEN u.s = 'COMPLETED' THEN 'COMPLETED' ELSE 'RETRY' END AS processing_status,
  CASE WHEN processing_status <> 'COMPLETED' AND u.s = 'COMPLETED' THEN (SELECT max(created_date) FROM results) ELSE processed_date END AS processed_date
  FROM claims c LEFT JOIN u USING (claim_id))
{CHANGED}""")
def advance_status(d):
    return _changed(lifecycle.advance_status(d.claims, d.results, newest(d.results, "created_date")))


@query("K2_upsert_chunks", "chunks", """
, old AS (SELECT chunk_id, 'PROCESSING' AS status, min(processed_date) AS processed_date, cast(0 AS BIGINT) AS claims_count, cast(0 AS DOUBLE) AS seconds
  FROM chunks WHERE chunk_id % 2 = 0 GROUP BY chunk_id)
, new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY processed_date DESC) AS rn FROM chunks WHERE chunk_id % 3 = 0) WHERE rn = 1)
SELECT chunk_id, status, cast(processed_date AS VARCHAR) AS processed_date, claims_count, seconds AS duration FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)
UNION ALL SELECT chunk_id, 'COMPLETED', cast(processed_date AS VARCHAR), claims_count, cast(processing_duration_seconds AS DOUBLE) FROM new""")
def upsert_chunks(d):
    old = d.chunks.filter(F.col("chunk_id") % 2 == 0).groupBy("chunk_id").agg(F.min("processed_date").alias("processed_date")).withColumns({
        "status": F.lit("PROCESSING"), "claims_count": F.lit(0).cast("long"), "processing_duration_seconds": F.lit(0).cast("decimal(10,3)")})
    return lifecycle.upsert_chunks(old, d.chunks.filter(F.col("chunk_id") % 3 == 0)).select(
        "chunk_id", "status", *text("processed_date"), "claims_count", F.col("processing_duration_seconds").cast("double").alias("duration"))


def _queue(d):
    """Retry queue with half of the chunks in it."""
    return d.failures.filter(F.col("chunk_id") % 2 == 0).groupBy("chunk_id").agg(
        F.min("failed_at").alias("created_date"), F.min("error_message").alias("error_message")).select(
        "chunk_id", "error_message", (F.col("chunk_id") % 5).cast("long").alias("retry_count"), (F.col("chunk_id") % 6 == 0).alias("resolved"),
        "created_date", F.lit(None).cast("timestamp_ntz").alias("last_retry_date"))


QUEUE = """
, q AS (SELECT chunk_id, min(error_message) AS error_message, cast(chunk_id % 5 AS BIGINT) AS retry_count, chunk_id % 6 = 0 AS resolved,
  min(failed_at) AS created_date FROM failures WHERE chunk_id % 2 = 0 GROUP BY chunk_id)
"""


@query("K3_upsert_retry", "failures", QUEUE + """
, f AS (SELECT chunk_id, count(*) AS n, max_by(error_message, event_id) AS m, min(failed_at) AS a, max(failed_at) AS z FROM failures WHERE chunk_id % 3 <> 1 GROUP BY chunk_id)
SELECT coalesce(q.chunk_id, f.chunk_id) AS chunk_id, coalesce(f.m, q.error_message) AS error_message,
  coalesce(q.retry_count, 0) + coalesce(f.n, 0) AS retry_count, coalesce(q.resolved, false) AS resolved,
  cast(coalesce(q.created_date, f.a) AS VARCHAR) AS created_date,
  cast(CASE WHEN f.n > 1 OR (f.n IS NOT NULL AND q.chunk_id IS NOT NULL) THEN f.z END AS VARCHAR) AS last_retry_date
FROM q FULL JOIN f ON q.chunk_id = f.chunk_id""")
def upsert_retry(d):
    return lifecycle.upsert_retry(_queue(d), d.failures.filter(F.col("chunk_id") % 3 != 1)).select(
        "chunk_id", "error_message", "retry_count", "resolved", *text("created_date", "last_retry_date"))


@query("L2_retry_candidates", "failures", QUEUE + """
SELECT chunk_id, error_message, retry_count, cast(created_date AS VARCHAR) AS created_date FROM q WHERE retry_count < 3 AND NOT resolved""")
def retry_candidates(d):
    return lifecycle.retry_candidates(_queue(d)).withColumn("created_date", F.col("created_date").cast("string"))


@query("K7_retry_failed", "failures", QUEUE + """
SELECT chunk_id, retry_count, CASE WHEN retry_count >= 3 THEN 'ERROR' ELSE 'RETRY' END AS next_status FROM q WHERE NOT resolved""")
def retry_failed(d):
    return lifecycle.retry_failed(_queue(d)).select("chunk_id", "retry_count", "next_status")


CUTOFF = "created_date < (SELECT max(created_date) FROM results) - INTERVAL '10' DAY"


@query("K5_archive_old", "results", f"""
SELECT result_id, claim_id, cast(created_date AS VARCHAR) AS created_date, cast((SELECT max(created_date) FROM results) AS VARCHAR) AS archived_date
FROM results WHERE {CUTOFF.replace('created_date <', 'results.created_date <')}""")
def archive_old(d):
    return lifecycle.archive_old(d.results, newest(d.results, "created_date"), 10).select(
        "result_id", "claim_id", *text("created_date", "archived_date"))


@query("K6_purge_old", "results", f"""
SELECT result_id, claim_id, validation_status FROM results WHERE NOT ({CUTOFF})""")
def purge_old(d):
    return lifecycle.purge_old(d.results, newest(d.results, "created_date"), 10).select("result_id", "claim_id", "validation_status")


@query("A8_daily_upsert", "results", """
, n AS (SELECT cast(created_date AS DATE) AS day, count(*) AS total_claims FROM results GROUP BY 1)
, o AS (SELECT day, cast(0 AS BIGINT) AS total_claims FROM n WHERE day(day) % 2 = 0)
SELECT cast(day AS VARCHAR) AS processing_date, total_claims FROM n WHERE day(day) % 3 = 0
UNION ALL SELECT cast(day AS VARCHAR), total_claims FROM o WHERE day(day) % 3 <> 0""")
def daily_upsert(d):
    from claimloom.operators.reports import daily_rollup

    rollup = daily_rollup(d.results).select("processing_date", "total_claims")
    old = rollup.filter(F.day("processing_date") % 2 == 0).withColumn("total_claims", F.lit(0).cast("long"))
    return lifecycle.upsert_daily(old, rollup.filter(F.day("processing_date") % 3 == 0)).select(*text("processing_date"), "total_claims")


def _in_place(d, rows, key, change, *args):
    """The table after a change that wrote the buckets of changed keys only."""
    path = scratch(d.spark, "buckets")
    buckets.write_buckets(rows, path, key, 16)
    change(d.spark, path, *args)
    return buckets.read_buckets(d.spark, path)


@query("J8_update_in_place")
def update_in_place(d):
    updates = d.results.select(
        "claim_id", F.when(F.col("validation_status") == "ERROR", "RETRY").otherwise("SENT").alias("new_status"), F.col("result_id").alias("update_no"))
    return _changed(_in_place(d, d.claims, "claim_id", buckets.update_claims, updates, newest(d.results, "created_date")))


@query("K1_advance_in_place")
def advance_in_place(d):
    return _changed(_in_place(d, d.claims, "claim_id", buckets.advance_claims, d.results, newest(d.results, "created_date")))


@query("K2_upsert_in_place")
def upsert_chunks_in_place(d):
    old = d.chunks.filter(F.col("chunk_id") % 2 == 0).groupBy("chunk_id").agg(F.min("processed_date").alias("processed_date")).withColumns({
        "status": F.lit("PROCESSING"), "claims_count": F.lit(0).cast("long"), "processing_duration_seconds": F.lit(0).cast("decimal(10,3)")})
    return _in_place(d, old, "chunk_id", buckets.upsert_chunks, d.chunks.filter(F.col("chunk_id") % 3 == 0)).select(
        "chunk_id", "status", *text("processed_date"), "claims_count", F.col("processing_duration_seconds").cast("double").alias("duration"))


@query("K3_upsert_in_place")
def upsert_retry_in_place(d):
    return _in_place(d, _queue(d), "chunk_id", buckets.upsert_retry, d.failures.filter(F.col("chunk_id") % 3 != 1)).select(
        "chunk_id", "error_message", "retry_count", "resolved", *text("created_date", "last_retry_date"))


ORACLES |= {
    "J8_update_in_place": ORACLES["J8_update_from"], "K1_advance_in_place": ORACLES["K1_advance_status"],
    "K2_upsert_in_place": ORACLES["K2_upsert_chunks"], "K3_upsert_in_place": ORACLES["K3_upsert_retry"],
}

"""Queries: scalar expressions, claim assembly and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.registry import ORACLES, query, scratch
from claimloom.functions import scalars as S
from claimloom.operators import enrich, features, lifecycle, metrics, reports
from claimloom.sources import pages
from claimloom.sources.files import codes_of_text


def joined(column, sep=","):
    """Array as text with explicit nulls."""
    return F.array_join(column, sep, "NULL")


def entries(column, *fields):
    """Array of structs as sorted text."""
    return F.array_join(F.array_sort(F.transform(column, lambda e: F.concat_ws("|", *[e[f].cast("string") for f in fields]))), ";")


DIAGNOSIS_TEXT = "concat_ws('|', diagnosis_code, diagnosis_type, cast(diagnosis_sequence AS VARCHAR), description, cast(is_principal AS VARCHAR))"
PROCEDURE_TEXT = """concat_ws('|', procedure_code, procedure_type, cast(procedure_sequence AS VARCHAR), description,
  cast(charge_amount AS VARCHAR), cast(service_date AS VARCHAR), diagnosis_pointers)"""

CHILD_CTES = f"""
, d AS (SELECT claim_id, count(*) AS n, string_agg(e, ';' ORDER BY e) AS s FROM (
    SELECT DISTINCT claim_id, {DIAGNOSIS_TEXT} AS e FROM diagnoses WHERE diagnosis_code IS NOT NULL) GROUP BY claim_id)
, p AS (SELECT claim_id, count(*) AS n, string_agg(e, ';' ORDER BY e) AS s FROM (
    SELECT DISTINCT claim_id, {PROCEDURE_TEXT} AS e FROM procedures WHERE procedure_code IS NOT NULL) GROUP BY claim_id)
"""
CODE_CTES = """
, dc AS (SELECT claim_id, string_agg(diagnosis_code, ',' ORDER BY diagnosis_code) AS s, count(*) AS n FROM (
    SELECT DISTINCT claim_id, diagnosis_code FROM diagnoses WHERE diagnosis_code IS NOT NULL) GROUP BY claim_id)
, pc AS (SELECT claim_id, string_agg(procedure_code, ',' ORDER BY procedure_code) AS s, count(*) AS n FROM (
    SELECT DISTINCT claim_id, procedure_code FROM procedures WHERE procedure_code IS NOT NULL) GROUP BY claim_id)
"""
ITEM_CTE = """
, tx AS (
  SELECT DISTINCT c.claim_id, concat('DIAG_', d.diagnosis_code) AS item FROM claims c JOIN diagnoses d USING (claim_id)
    WHERE c.processing_status = 'COMPLETED' AND d.diagnosis_code IS NOT NULL
  UNION ALL
  SELECT DISTINCT c.claim_id, concat('PROC_', p.procedure_code) FROM claims c JOIN procedures p USING (claim_id)
    WHERE c.processing_status = 'COMPLETED' AND p.procedure_code IS NOT NULL
  UNION ALL
  SELECT claim_id, concat('PROVIDER_', provider_type) FROM claims WHERE processing_status = 'COMPLETED' AND provider_type IS NOT NULL
  UNION ALL
  SELECT claim_id, concat('POS_', place_of_service) FROM claims WHERE processing_status = 'COMPLETED' AND place_of_service IS NOT NULL
  UNION ALL
  SELECT claim_id, CASE WHEN patient_age < 18 THEN 'AGE_CHILD' WHEN patient_age >= 65 THEN 'AGE_SENIOR' ELSE 'AGE_ADULT' END
    FROM claims WHERE processing_status = 'COMPLETED')
"""


# --- sources -------------------------------------------------------------

@query("S3_read_code_list", sql=r"""
WITH t AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, lines, string_split(lines[1], ',') AS head FROM t),
f AS (SELECT doc_id, unnest(CASE WHEN len(head) > 1 THEN head ELSE list_transform(lines, lambda x: string_split(x, ',')[1]) END) AS field FROM u)
SELECT doc_id, count(*) AS n_codes, sum(length(code)) :: BIGINT AS code_chars, min(code) AS first_code, max(code) AS last_code
FROM (SELECT doc_id, trim(regexp_replace(trim(field, ' '), '^"(.*)"$', '\1'), ' ') AS code FROM f) WHERE code <> '' GROUP BY doc_id""")
def code_list(d):
    codes = d.documents.select("doc_id", F.explode(codes_of_text("text")).alias("code"))
    return codes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_codes"), F.sum(F.length("code")).alias("code_chars"),
        F.min("code").alias("first_code"), F.max("code").alias("last_code"))


@query("S13_read_log_lines", "log_lines", """
SELECT event_id, split_part(line, ' - ', 1) AS logged_at, split_part(line, ' - ', 2) AS logger, split_part(line, ' - ', 3) AS level,
  substr(line, length(split_part(line, ' - ', 1)) + length(split_part(line, ' - ', 2)) + length(split_part(line, ' - ', 3)) + 10) AS message
FROM log_lines""")
def log_lines(d):
    return metrics.parse_log_lines(d.log_lines).select("event_id", "logged_at", "logger", "level", "message")


# --- scalars -------------------------------------------------------------

@query("P1_pending_claims", "claims", "SELECT claim_id, processing_status FROM claims WHERE processing_status = 'PENDING'")
def pending(d):
    return reports.pending_claims(d.claims).select("claim_id", "processing_status")


@query("P2_unprocessed_claims", "claims",
       "SELECT claim_id, processing_status FROM claims WHERE processing_status IN ('PENDING', 'SENT', 'RETRY')")
def unprocessed(d):
    return reports.unprocessed_claims(d.claims).select("claim_id", "processing_status")


@query("P4_age_group", "claims", """SELECT claim_id, CASE WHEN patient_age < 18 THEN 'CHILD' WHEN patient_age >= 65 THEN 'SENIOR'
  ELSE 'ADULT' END AS age_group FROM claims""")
def age_group(d):
    return d.claims.select("claim_id", S.age_group("patient_age").alias("age_group"))


@query("P5_provider_type_from_pos", "claims", """SELECT claim_id, place_of_service, CASE
  WHEN place_of_service IN ('11', '12') THEN 'PRIMARY_CARE' WHEN place_of_service IN ('21', '22') THEN 'HOSPITAL'
  WHEN place_of_service = '23' THEN 'EMERGENCY' WHEN place_of_service IN ('24', '41') THEN 'URGENT_CARE'
  ELSE 'SPECIALIST' END AS derived_type FROM claims""")
def provider_from_pos(d):
    return d.claims.select("claim_id", "place_of_service", S.provider_type_from_pos("place_of_service").alias("derived_type"))


@query("P6_item_tags", "claims diagnoses procedures", ITEM_CTE +
       "SELECT claim_id, string_agg(item, ',' ORDER BY item) AS items FROM tx GROUP BY claim_id")
def item_tags(d):
    coded = enrich.claim_codes(d.claims.filter(F.col("processing_status") == "COMPLETED"), d.diagnoses, d.procedures)
    items = S.item_tags("diagnoses", "procedures", "provider_type", "place_of_service", "patient_age")
    return coded.select("claim_id", joined(F.array_sort(items)).alias("items"))


@query("P7_merge_payload", sql="""
WITH b AS (SELECT event_id, event_type, event_id % 5 AS kind, cast(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
SELECT event_id,
  CASE kind WHEN 0 THEN concat('member ', cast(k AS VARCHAR)) ELSE NULL END AS member_id,
  CASE kind WHEN 1 THEN NULL WHEN 4 THEN concat('payer ', cast(k AS VARCHAR)) ELSE event_type END AS payer
FROM b""")
def merge_payload(d):
    k = F.regexp_extract("props", "[0-9]+", 0)
    kind = F.col("event_id") % 5
    payload = (
        F.when(kind == 0, F.concat(F.lit('{"member_id": "member '), k, F.lit('"}')))
        .when(kind == 1, F.lit('{"payer": null}'))
        .when(kind == 2, F.lit("{not json"))
        .when(kind == 4, F.concat(F.lit('{"payer": "payer '), k, F.lit('", "other": 1}')))
    )
    claims = d.events.select("event_id", F.col("event_type").alias("payer"), payload.alias("claim_data"))
    return S.merge_payload(claims).select("event_id", "member_id", "payer")


@query("P8_P9_P10_claim_measures", "claims diagnoses procedures", """
, d AS (SELECT DISTINCT claim_id, diagnosis_code, diagnosis_type, diagnosis_sequence, description, is_principal FROM diagnoses WHERE diagnosis_code IS NOT NULL)
, dn AS (SELECT claim_id, count(*) AS n FROM d GROUP BY claim_id)
, d1 AS (SELECT claim_id, diagnosis_code, row_number() OVER (PARTITION BY claim_id ORDER BY is_principal DESC,
    CASE WHEN is_principal THEN 0 ELSE coalesce(diagnosis_sequence, 999) END, diagnosis_code, diagnosis_type, diagnosis_sequence, description) AS rn FROM d)
, p AS (SELECT DISTINCT claim_id, procedure_code, procedure_type, procedure_sequence, description, charge_amount, service_date, diagnosis_pointers
    FROM procedures WHERE procedure_code IS NOT NULL)
, pn AS (SELECT claim_id, count(*) AS n, sum(charge_amount) AS total FROM p GROUP BY claim_id)
SELECT c.claim_id, coalesce(dn.n, 0) AS diagnosis_count, coalesce(pn.n, 0) AS procedure_count,
  d1.diagnosis_code AS primary_diagnosis, cast(coalesce(pn.total, 0) AS DOUBLE) AS total_procedure_amount
FROM claims c LEFT JOIN dn USING (claim_id) LEFT JOIN pn USING (claim_id) LEFT JOIN d1 ON d1.claim_id = c.claim_id AND d1.rn = 1""")
def claim_measures(d):
    """Skew-safe form: no child arrays are built."""
    return enrich.claim_measures(*d.core).select(
        "claim_id", F.col("diagnosis_count").cast("long"), F.col("procedure_count").cast("long"),
        "primary_diagnosis", F.col("total_procedure_amount").cast("double"))


@query("P8_P9_P10_array_measures", "claims diagnoses procedures", CHILD_CTES + """
, d1 AS (SELECT claim_id, diagnosis_code, row_number() OVER (PARTITION BY claim_id ORDER BY is_principal DESC,
    CASE WHEN is_principal THEN 0 ELSE coalesce(diagnosis_sequence, 999) END, diagnosis_code, diagnosis_type, diagnosis_sequence, description) AS rn
    FROM diagnoses WHERE diagnosis_code IS NOT NULL)
, pp AS (SELECT claim_id, sum(charge_amount) AS total FROM (SELECT DISTINCT * FROM procedures WHERE procedure_code IS NOT NULL) GROUP BY claim_id)
SELECT c.claim_id, coalesce(d.n, 0) AS diagnosis_count, coalesce(p.n, 0) AS procedure_count,
  d1.diagnosis_code AS primary_diagnosis, cast(coalesce(pp.total, 0) AS DOUBLE) AS total_procedure_amount
FROM claims c LEFT JOIN d USING (claim_id) LEFT JOIN p USING (claim_id) LEFT JOIN pp USING (claim_id)
LEFT JOIN d1 ON d1.claim_id = c.claim_id AND d1.rn = 1 WHERE c.processing_status = 'PENDING'""")
def array_measures(d):
    return S.with_claim_measures(enrich.enrich_claims(*d.core)).select(
        "claim_id", F.col("diagnosis_count").cast("long"), F.col("procedure_count").cast("long"),
        "primary_diagnosis", F.col("total_procedure_amount").cast("double"))


@query("P11_mask_phi", sql=r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
  '\b\d{3}-\d{2}-\d{4}\b', 'XXX-XX-XXXX', 'g'), '\b\d{16}\b', 'XXXX-XXXX-XXXX-XXXX', 'g'),
  '(?i)\bDOB[:\s]*\d{1,2}/\d{1,2}/\d{4}\b', 'DOB: XX/XX/XXXX', 'g')) AS masked FROM documents""")
def mask_phi(d):
    return d.documents.select("doc_id", F.md5(S.mask_phi("text")).alias("masked"))


@query("P12_priority_tier", sql="""
SELECT event_id, CASE WHEN event_id % 11 >= 8 THEN 'high' WHEN event_id % 11 >= 5 THEN 'normal' ELSE 'low' END AS tier FROM events""")
def priority_tier(d):
    return d.events.select("event_id", S.priority_tier(F.col("event_id") % 11).alias("tier"))


@query("P13_split_charge", "claims", """
, s AS (SELECT claim_id, cast(total_charge_amount * 100 AS BIGINT) AS cents, 1 + cast(right(claim_id, 4) AS INT) % 3 AS n FROM claims)
, x AS (SELECT claim_id, n, unnest(range(1, n + 1)) AS i, cents, (2 * cents + n) // (2 * n) AS share FROM s)
SELECT claim_id, cast(i AS INT) AS i, CASE WHEN i < n THEN share ELSE cents - share * (n - 1) END / 100.0 :: DOUBLE AS line_charge FROM x""")
def split_charge(d):
    n = 1 + F.right("claim_id", F.lit(4)).cast("int") % 3
    lines = d.claims.select("claim_id", "total_charge_amount", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    return lines.select("claim_id", "i", S.split_charge("total_charge_amount", "n", "i").cast("double").alias("line_charge"))


@query("P14_parse_pointers", "diagnoses procedures", """
, d AS (SELECT claim_id, diagnosis_sequence, min(diagnosis_code) AS code FROM diagnoses GROUP BY claim_id, diagnosis_sequence)
, p AS (SELECT DISTINCT claim_id, procedure_code, procedure_sequence, cast(trim(diagnosis_pointers, '[]') AS INT) AS pointer FROM procedures)
SELECT p.claim_id, procedure_code, procedure_sequence, pointer, d.code AS pointed_code
FROM p LEFT JOIN d ON d.claim_id = p.claim_id AND d.diagnosis_sequence = p.pointer""")
def pointers(d):
    named = d.diagnoses.groupBy("claim_id", F.col("diagnosis_sequence").alias("pointer")).agg(F.min("diagnosis_code").alias("pointed_code"))
    lines = d.procedures.select(
        "claim_id", "procedure_code", "procedure_sequence", F.explode(S.parse_pointers("diagnosis_pointers")).alias("pointer")).distinct()
    return lines.join(named, ["claim_id", "pointer"], "left")


@query("P15_applied_filters", "results", """
SELECT result_id, CASE predicted_filters WHEN '[1, 2]' THEN '1,2' WHEN '[3]' THEN '3' ELSE '' END AS applied FROM results""")
def applied(d):
    return d.results.select("result_id", joined(S.applied_filters("predicted_filters")).alias("applied"))


@query("P16_redact_log_record", sql=r"""
SELECT doc_id, 'INFO' AS level, regexp_replace(regexp_replace(regexp_replace(text,
  '\b\d{3}-\d{2}-\d{4}\b', 'XXX-XX-XXXX', 'g'), '\b\d{16}\b', 'XXXX-XXXX-XXXX-XXXX', 'g'),
  '(?i)\bDOB[:\s]*\d{1,2}/\d{1,2}/\d{4}\b', 'DOB: XX/XX/XXXX', 'g') AS message, source
FROM documents""")
def redact(d):
    records = d.documents.select("doc_id", F.lit("INFO").alias("level"), F.col("text").alias("message"), "source")
    return metrics.redact_log_record(records)


# --- joins ---------------------------------------------------------------

def _enriched_text(df):
    return df.select(
        "claim_id", "processing_status", "patient_age", "provider_type",
        F.size("diagnoses").cast("long").alias("n_diagnoses"), F.size("procedures").cast("long").alias("n_procedures"),
        entries("diagnoses", "code", "type", "sequence", "description", "is_principal").alias("diagnoses"),
        F.array_join(F.array_sort(F.transform("procedures", lambda e: F.concat_ws(
            "|", e["code"], e["type"], e["sequence"].cast("string"), e["description"], e["charge_amount"].cast("string"),
            e["service_date"].cast("string"), F.concat(F.lit("["), F.array_join(e["diagnosis_pointers"].cast("array<string>"), ", "), F.lit("]"))))),
            ";").alias("procedures"))


ENRICHED = CHILD_CTES + """SELECT c.claim_id, processing_status, patient_age, provider_type,
  coalesce(d.n, 0) AS n_diagnoses, coalesce(p.n, 0) AS n_procedures, coalesce(d.s, '') AS diagnoses, coalesce(p.s, '') AS procedures
FROM claims c LEFT JOIN d USING (claim_id) LEFT JOIN p USING (claim_id) """


@query("J1_enrich_claims", "claims diagnoses procedures", ENRICHED + "WHERE processing_status = 'PENDING'")
def enrich_pending(d):
    return _enriched_text(enrich.enrich_claims(*d.core))


@query("J2_enrich_unprocessed", "claims diagnoses procedures", ENRICHED + "WHERE processing_status IN ('PENDING', 'SENT', 'RETRY')")
def enrich_unprocessed(d):
    return _enriched_text(enrich.enrich_unprocessed(*d.core))


TRAINING = CODE_CTES + """
, r AS (SELECT DISTINCT claim_id, predicted_filters FROM results WHERE validation_status = 'COMPLETED')
, training AS (
SELECT c.claim_id, patient_age, provider_type, place_of_service, total_charge_amount, coalesce(dc.s, '') AS diagnoses, coalesce(pc.s, '') AS procedures,
  coalesce(dc.n, 0) AS dn, coalesce(pc.n, 0) AS pn,
  CASE r.predicted_filters WHEN '[1, 2]' THEN '1,2' WHEN '[3]' THEN '3' ELSE '' END AS applied_filters
FROM claims c LEFT JOIN dc USING (claim_id) LEFT JOIN pc USING (claim_id) LEFT JOIN r USING (claim_id)
WHERE c.processing_status = 'COMPLETED')
"""


@query("J3_training_set", "claims diagnoses procedures results", TRAINING +
       "SELECT claim_id, patient_age, provider_type, place_of_service, diagnoses, procedures, applied_filters FROM training")
def training_set(d):
    return enrich.training_set(*d.core, d.results).select(
        "claim_id", "patient_age", "provider_type", "place_of_service", joined("diagnoses").alias("diagnoses"),
        joined("procedures").alias("procedures"), joined("applied_filters").alias("applied_filters"))


@query("J4_transactions", "claims diagnoses procedures", ITEM_CTE +
       "SELECT claim_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM tx GROUP BY claim_id")
def transactions(d):
    return enrich.transactions(*d.core).select(
        "claim_id", F.size("items").cast("long").alias("n_items"), joined(F.array_sort("items")).alias("items"))


@query("R5_claim_summary_raw", "claims diagnoses procedures", """
SELECT c.claim_id, string_agg(coalesce(diagnosis_code, 'NULL'), ',' ORDER BY diagnosis_code NULLS FIRST) AS diagnoses,
  string_agg(coalesce(procedure_code, 'NULL'), ',' ORDER BY procedure_code NULLS FIRST) AS procedures
FROM claims c LEFT JOIN diagnoses USING (claim_id) LEFT JOIN procedures USING (claim_id) GROUP BY c.claim_id""")
def summary_raw(d):
    return enrich.claim_summary_raw(*d.core).select(
        "claim_id", joined("diagnoses").alias("diagnoses"), joined("procedures").alias("procedures"))


@query("R5_claim_summary_counts", "claims diagnoses procedures", """
, j AS (SELECT c.claim_id, coalesce(diagnosis_code, 'NULL') AS d, coalesce(procedure_code, 'NULL') AS p
  FROM claims c LEFT JOIN diagnoses USING (claim_id) LEFT JOIN procedures USING (claim_id))
, dc AS (SELECT claim_id, d || ':' || count(*) AS s FROM j GROUP BY claim_id, d)
, pc AS (SELECT claim_id, p || ':' || count(*) AS s FROM j GROUP BY claim_id, p)
SELECT * FROM (SELECT claim_id, string_agg(s, ',' ORDER BY s) AS diagnoses FROM dc GROUP BY claim_id)
JOIN (SELECT claim_id, string_agg(s, ',' ORDER BY s) AS procedures FROM pc GROUP BY claim_id) USING (claim_id)""")
def summary_counts(d):
    """The same as codes with counts, whose size does not grow with the product of the lines."""
    def text(side):
        return F.array_join(F.array_sort(F.transform(side, lambda e: F.concat_ws(
            ":", F.coalesce(e["code"], F.lit("NULL")), e["n"].cast("string")))), ",").alias(side)

    return enrich.claim_summary_counts(*d.core).select("claim_id", text("diagnoses"), text("procedures"))


@query("R6_claim_summary", "claims diagnoses procedures", CODE_CTES + """
SELECT c.claim_id, coalesce(dc.s, '') AS diagnoses, coalesce(pc.s, '') AS procedures
FROM claims c LEFT JOIN dc USING (claim_id) LEFT JOIN pc USING (claim_id)""")
def summary(d):
    return enrich.claim_summary(*d.core).select(
        "claim_id", joined("diagnoses").alias("diagnoses"), joined("procedures").alias("procedures"))


@query("J7_not_exists", "claims results", """
SELECT claim_id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.claim_id = c.claim_id)""")
def not_exists(d):
    return lifecycle.not_exists(d.claims.select("claim_id"), d.results, "claim_id")


@query("J10_facts", "claims diagnoses procedures", """
SELECT claim_id, 'age' AS kind, cast(patient_age AS VARCHAR) AS value FROM claims WHERE patient_age IS NOT NULL
UNION SELECT claim_id, 'charge', cast(total_charge_amount AS VARCHAR) FROM claims WHERE total_charge_amount IS NOT NULL
UNION SELECT claim_id, 'provider', provider_type FROM claims WHERE provider_type IS NOT NULL
UNION SELECT claim_id, 'place', place_of_service FROM claims WHERE place_of_service IS NOT NULL
UNION SELECT claim_id, 'diagnosis', diagnosis_code FROM diagnoses WHERE diagnosis_code IS NOT NULL
UNION SELECT claim_id, 'procedure', procedure_code FROM procedures WHERE procedure_code IS NOT NULL""")
def facts(d):
    return enrich.facts(*d.core)


@query("A18_collect_codes", "diagnoses", """
SELECT claim_id, string_agg(diagnosis_code, ',' ORDER BY diagnosis_code) AS codes FROM (
  SELECT DISTINCT claim_id, diagnosis_code FROM diagnoses WHERE diagnosis_code IS NOT NULL) GROUP BY claim_id""")
def collect_codes(d):
    return enrich.collect_codes(d.diagnoses, "diagnosis_code").select("claim_id", joined("codes").alias("codes"))


@query("L3_training_page", "claims diagnoses procedures", CODE_CTES + """
SELECT c.claim_id, coalesce(dc.s, '') AS diagnoses, coalesce(pc.s, '') AS procedures
FROM claims c LEFT JOIN dc USING (claim_id) LEFT JOIN pc USING (claim_id)
WHERE c.processing_status = 'COMPLETED' ORDER BY claim_id LIMIT 1000 OFFSET 500""")
def training_page(d):
    chosen = enrich.page(d.claims.filter(F.col("processing_status") == "COMPLETED").select("claim_id"), ["claim_id"], 1000, 500)
    return enrich.page_codes(chosen, d.diagnoses, d.procedures).select(
        "claim_id", joined("diagnoses").alias("diagnoses"), joined("procedures").alias("procedures"))


@query("L3_stored_page")
def stored_page(d):
    """The same page from a table in blocks of 400 rows."""
    path = scratch(d.spark, "pages")
    pages.write_pages(d.claims.filter(F.col("processing_status") == "COMPLETED").select("claim_id"), path, ["claim_id"], 400)
    return enrich.page_codes(pages.read_page(d.spark, path, 1000, 500), d.diagnoses, d.procedures).select(
        "claim_id", joined("diagnoses").alias("diagnoses"), joined("procedures").alias("procedures"))


ORACLES["L3_stored_page"] = ORACLES["L3_training_page"]


@query("V1_encode_categories", "claims", """
, fit AS (SELECT coalesce(provider_type, 'UNKNOWN') AS v, dense_rank() OVER (ORDER BY coalesce(provider_type, 'UNKNOWN')) - 1 AS code
  FROM claims WHERE processing_status = 'COMPLETED' AND coalesce(provider_type, '') <> 'HOSPITAL')
, codes AS (SELECT DISTINCT v, code FROM fit)
SELECT claim_id, cast(coalesce(code, -1) AS DOUBLE) AS provider_type_encoded
FROM claims LEFT JOIN codes ON codes.v = coalesce(provider_type, 'UNKNOWN')""")
def encode(d):
    fit_on = d.claims.filter((F.col("processing_status") == "COMPLETED") & (F.coalesce("provider_type", F.lit("")) != "HOSPITAL"))
    encoders = features.fit_encoders(fit_on, ["provider_type"])
    return features.encode_categories(encoders, d.claims).select("claim_id", "provider_type_encoded")

"""Queries: file and table round trips, and synthetic claims keyed by the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.registry import query, scratch
from claimloom.functions.scalars import DEFAULT_PROVIDER, PROVIDER_BY_PLACE
from claimloom.sources import files, synth, tables

SHOWN = """SELECT claim_id, patient_id, provider_id, patient_age, provider_type, place_of_service,
  cast(total_charge_amount AS DOUBLE) AS total_charge_amount, cast(service_date AS VARCHAR) AS service_date, processing_status FROM claims"""


def _shown(df):
    return df.select(
        "claim_id", "patient_id", "provider_id", "patient_age", "provider_type", "place_of_service",
        F.col("total_charge_amount").cast("double").alias("total_charge_amount"),
        F.col("service_date").cast("string").alias("service_date"), "processing_status")


@query("S1_read_claims_csv", "claims", SHOWN)
def claims_csv(d):
    path = scratch(d.spark, "claims-csv")
    d.claims.drop("processed_date").write.mode("overwrite").option("header", True).csv(path)
    return _shown(files.read_claims_csv(d.spark, path))


@query("S2_read_claims_json", "claims", SHOWN)
def claims_json(d):
    """Half of the claims as plain records, half wrapped in objects with a ``claims`` list."""
    path = scratch(d.spark, "claims-json")
    rows = d.claims.drop("processed_date")
    even = F.right("claim_id", F.lit(1)).cast("int") % 2 == 0
    rows.filter(even).write.mode("overwrite").json(f"{path}/plain")
    rows.filter(~even).select(F.array(F.struct(*rows.columns)).alias("claims")).write.mode("overwrite").json(f"{path}/wrapped")
    return _shown(files.read_claims_json(d.spark, f"{path}/*", multi_line=False))


@query("S2_read_claims_array", "claims", SHOWN)
def claims_array(d):
    """Lists of a thousand claims, each in ranges of 100 kB."""
    path = scratch(d.spark, "claims-array")
    rows = d.claims.drop("processed_date")
    lists = rows.groupBy(F.floor(F.right("claim_id", F.lit(10)).cast("long") / 4000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value"))
    lists.write.partitionBy("part").text(path)
    return _shown(files.read_claims_array(d.spark, path, 100_000))


@query("S4_read_and_write_tables", "results", "SELECT result_id, claim_id, validation_status, cast(processing_time AS DOUBLE) AS processing_time FROM results")
def table_round_trip(d):
    path = scratch(d.spark, "results")
    rows = d.results.withColumn("day", F.to_date("created_date"))
    tables.write_results(rows, path, partition_by=["day"])
    return tables.read_table(d.spark, path).select(
        "result_id", "claim_id", "validation_status", F.col("processing_time").cast("double").alias("processing_time"))


@query("S12_S14_K4_clear_and_ensure", "claims chunks failures", """
SELECT 'claims' AS name, count(*) AS before, cast(0 AS BIGINT) AS after FROM claims
UNION ALL SELECT 'processed_chunks', count(*), 0 FROM chunks UNION ALL SELECT 'retry_queue', count(*), 0 FROM failures
UNION ALL SELECT 'validation_results', 0, 0 UNION ALL SELECT 'validation_results_archive', 0, 0""")
def clear_and_ensure(d):
    """Row counts before and after clearing a store that holds all claims, chunks and failures; the result tables are created."""
    root = scratch(d.spark, "store")
    files.as_claims(d.claims).write.parquet(f"{root}/claims")
    for name, rows in (("processed_chunks", d.chunks), ("retry_queue", d.failures)):
        given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in tables.TABLES[name]}
        rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in tables.TABLES[name]]).write.parquet(f"{root}/{name}")
    tables.ensure_tables(d.spark, root)
    names = ["claims", *tables.TRACKING, "validation_results", "validation_results_archive"]
    before = {n: tables.read_table(d.spark, f"{root}/{n}").count() for n in names}
    tables.clear_tables(d.spark, root, ["claims"])
    tables.reset_tracking(d.spark, root)
    out = None
    for name in names:
        one = tables.read_table(d.spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("after")).select(
            F.lit(name).alias("name"), F.lit(before[name]).cast("long").alias("before"), "after")
        out = one if out is None else out.unionByName(one)
    return out


def _ids(d):
    return d.orders.select(F.col("o_orderkey").alias("id"))


AS_OF = "2024-12-31"


def _draw(n, *parts):
    """The draws of ``synth.Draws`` with seed 42, in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '42')), 1, 15))::BIGINT % {n})"


def _pick(values, purpose):
    return f"{list(values)}[1 + {_draw(len(values), 'id', repr(purpose))}]"


def _person(who):
    return f"concat({_pick(synth.FIRST_NAMES, who + ' first')}, ' ', {_pick(synth.LAST_NAMES, who + ' last')})"


PROVIDERS = " ".join(f"WHEN '{place}' THEN '{kind}'" for place, kind in PROVIDER_BY_PLACE.items())
SYNTH = f"""
WITH ids AS (SELECT o_orderkey AS id FROM orders)
, drawn AS (SELECT id, concat('CLM_', lpad(printf('%X', id), greatest(8, length(printf('%X', id)))::INT, '0')) AS claim_id,
    concat('PAT_', {_draw(900_000, 'id', "'patient'")} + 100000) AS patient_id,
    cast((id::HUGEINT * {synth.NPI_STEP} + 42) % {synth.NPI_COUNT} + {synth.NPI_FIRST} AS VARCHAR) AS provider_id,
    DATE '{AS_OF}' - {_draw(731, 'id', "'day'")}::INT AS service_date, ({_draw(497_501, 'id', "'charge'")} + 2500) / 100 AS total_charge_amount,
    ({_draw(95, 'id', "'age'")} + 1)::INT AS patient_age, {_pick(synth.PLACES, 'place')} AS place_of_service, {_pick(synth.STATUSES, 'status')} AS processing_status,
    {_draw(f"({_draw(31, 'id', chr(39) + 'longest stay' + chr(39))} + 1)", 'id', "'stay'")}::INT AS stay, (1 + {_draw(5, 'id', "'diagnosis count'")})::INT AS n_diagnoses FROM ids)
"""


@query("S11_synth_claims", sql=SYNTH + f"""
SELECT id, claim_id, patient_id, provider_id, cast(service_date AS VARCHAR) AS service_date, total_charge_amount, patient_age, place_of_service, processing_status,
  CASE place_of_service {PROVIDERS} ELSE '{DEFAULT_PROVIDER}' END AS provider_type, concat('MBR_', {_draw(9_000_000, 'id', "'member'")} + 1000000) AS member_id,
  {_person('patient')} AS patient_name, concat('Dr. ', {_person('provider')}) AS provider_name, {_pick(synth.SEXES, 'sex')} AS sex, {_pick(synth.PAYERS, 'payer')} AS payer,
  cast(service_date + stay AS VARCHAR) AS service_date_to
FROM drawn""")
def synth_claims(d):
    rows = synth.synth_claims_for(_ids(d), AS_OF)
    told = [F.get_json_object("claim_data", f"$.{c}").alias(c) for c in ("member_id", "patient_name", "provider_name", "sex", "payer", "service_date_to")]
    return rows.select("*", *told).drop("claim_data").withColumns({
        "total_charge_amount": F.col("total_charge_amount").cast("double"), "service_date": F.col("service_date").cast("string")})


@query("S11_synth_diagnoses", sql=SYNTH + f"""
, codes AS (SELECT unnest({files.DEFAULT_ICD10}) AS code, unnest(range({len(files.DEFAULT_ICD10)})) AS i)
, ranked AS (SELECT id, claim_id, n_diagnoses, code, row_number() OVER (PARTITION BY id ORDER BY ('0x' || substr(md5(concat_ws('|', id, i, 'diagnoses', '42')), 1, 15))::BIGINT, code) AS place
  FROM drawn, codes)
SELECT claim_id, code AS diagnosis_code, cast(place AS INT) AS diagnosis_sequence, place = 1 AS is_principal FROM ranked WHERE place <= n_diagnoses""")
def synth_diagnoses(d):
    return synth.synth_diagnoses(synth.synth_claims_for(_ids(d), AS_OF)).select("claim_id", "diagnosis_code", "diagnosis_sequence", "is_principal")


@query("S11_synth_lines", sql="SELECT count(*) AS n_claims, count(*) AS n_charged, count(*) AS n_with_principal FROM orders")
def synth_lines(d):
    """Checks over all synthetic lines: every claim has lines, their charges add up to the claim's,
    and exactly one diagnosis is principal."""
    claims = synth.synth_claims_for(_ids(d), AS_OF)
    dx = synth.synth_diagnoses(claims).groupBy("claim_id").agg(
        F.count_if("is_principal").alias("principals"), F.count(F.lit(1)).alias("n"), F.count_distinct("diagnosis_code").alias("codes"))
    px = synth.synth_procedures(claims).groupBy("claim_id").agg(F.sum("charge_amount").alias("charged"), F.count(F.lit(1)).alias("lines"))
    return claims.join(dx, "claim_id", "left").join(px, "claim_id", "left").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if((F.col("charged") == F.col("total_charge_amount")) & F.col("lines").between(1, 3)).alias("n_charged"),
        F.count_if((F.col("principals") == 1) & (F.col("n") == F.col("codes")) & F.col("n").between(1, 5)).alias("n_with_principal"))

"""Claims-style views over the star-schema test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ["orders", "customer", "lineitem", "part", "events", "documents", "labels"]

VIEWS = {
    "claims": """
SELECT concat('CLM_', lpad(cast(o.o_orderkey AS VARCHAR(20)), 10, '0')) AS claim_id,
  concat('PAT_', cast(o.o_custkey AS VARCHAR(20))) AS patient_id,
  concat('PRV_', cast(c.c_nationkey AS VARCHAR(20))) AS provider_id,
  CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE cast(1 + (o.o_custkey * 7) % 95 AS INT) END AS patient_age,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'PRIMARY_CARE' WHEN 'AUTOMOBILE' THEN 'SPECIALIST'
    WHEN 'MACHINERY' THEN 'HOSPITAL' WHEN 'HOUSEHOLD' THEN 'EMERGENCY' ELSE NULL END AS provider_type,
  CASE o.o_orderkey % 6 WHEN 0 THEN '11' WHEN 1 THEN '21' WHEN 2 THEN '22' WHEN 3 THEN '23' WHEN 4 THEN '24' ELSE '99' END AS place_of_service,
  cast(round(o.o_totalprice, 2) AS DECIMAL(12,2)) AS total_charge_amount,
  cast(o.o_orderdate AS DATE) AS service_date,
  CASE WHEN o.o_orderstatus = 'F' THEN 'COMPLETED' WHEN o.o_orderstatus = 'O' THEN 'PENDING'
    WHEN o.o_orderkey % 2 = 0 THEN 'RETRY' ELSE 'SENT' END AS processing_status,
  CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + (o.o_orderkey % 5) * INTERVAL '1' DAY END AS processed_date
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "diagnoses": """
SELECT concat('CLM_', lpad(cast(l.l_orderkey AS VARCHAR(20)), 10, '0')) AS claim_id,
  CASE WHEN l.l_suppkey % 20 = 0 THEN NULL ELSE p.p_brand END AS diagnosis_code,
  l.l_linenumber AS diagnosis_sequence, (l.l_linenumber = 2) AS is_principal,
  'ICD10' AS diagnosis_type, concat('Diagnosis description for ', p.p_brand) AS description
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "procedures": """
SELECT concat('CLM_', lpad(cast(l.l_orderkey AS VARCHAR(20)), 10, '0')) AS claim_id,
  concat('P', cast(p.p_size AS VARCHAR(20))) AS procedure_code,
  l.l_linenumber AS procedure_sequence, cast(round(l.l_extendedprice, 2) AS DECIMAL(10,2)) AS charge_amount,
  'CPT' AS procedure_type, concat('Procedure description for ', p.p_type) AS description,
  cast(l.l_shipdate AS DATE) AS service_date, concat('[', cast(1 + l.l_linenumber % 4 AS VARCHAR(20)), ']') AS diagnosis_pointers
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "results": """
SELECT event_id AS result_id,
  concat('CLM_', lpad(cast(user_id AS VARCHAR(20)), 10, '0')) AS claim_id,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'COMPLETED' END AS validation_status,
  CASE event_type WHEN 'click' THEN '[1, 2]' WHEN 'purchase' THEN '[3]' WHEN 'view' THEN '[]' WHEN 'signup' THEN NULL ELSE '[]' END AS predicted_filters,
  cast(round(value / 1000, 6) AS DECIMAL(10,6)) AS processing_time,
  CASE WHEN event_type <> 'error' THEN NULL WHEN cast(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 = 0 THEN ''
    ELSE concat('E', regexp_extract(props, '[0-9]+', 0)) END AS error_message,
  ts AS created_date
FROM {events}""",
    "failures": """
SELECT cast(user_id % 20 AS INT) AS chunk_id, concat('E', regexp_extract(props, '[0-9]+', 0)) AS error_message, ts AS failed_at, event_id
FROM {events} WHERE event_type = 'error'""",
    "log_lines": """
SELECT event_id, ts, concat(cast(cast(ts AS DATE) AS VARCHAR(20)), ' - ', event_type, ' - ',
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'CRITICAL' ELSE 'ERROR' END ELSE 'INFO' END,
  ' - value ', props) AS line
FROM {events}""",
    "chunks": """
SELECT cast(user_id AS INT) AS chunk_id,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status,
  max(ts) AS processed_date, cast(count(*) AS BIGINT) AS claims_count,
  cast(round(max(value), 3) AS DECIMAL(10,3)) AS processing_duration_seconds
FROM {events} GROUP BY 1, 2""",
}

# The filters and code sets every rule query uses.
FILTERS = [
    (1, "Brand senior", "has_diagnosis(X, 'Brand#13') & patient_age(X, Age) & (Age > 65)", True),
    (2, "High cost specialist", 'charge_amount(X, Amount) & provider_type(X, "SPECIALIST") & (Amount > 100000)', True),
    (3, "Young preventive", "has_diagnosis(X, Code) & patient_age(X, Age) & (Age < 18) & preventive_code(Code)", True),
    (4, "Emergency place", "place_of_service(X, '23') & provider_type(X, 'EMERGENCY')", True),
    (5, "Adult", "rule_applies(X) <= patient_age(X, Age) & (Age >= 18) & (Age < 65)", True),
    (6, "Always", "rule_applies(X) <= True", True),
    (7, "Managed", 'has_diagnosis(X, "Brand#13") & has_procedure(X, ProcCode) & managed_procedure(ProcCode)', True),
    (8, "Unknown set", "has_diagnosis(X, Code) & no_such_set(Code)", True),
    (9, "Retired", "place_of_service(X, '11')", False),
]
CODE_SETS = {
    "preventive_code": ["Brand#1", "Brand#5", "Brand#21"],
    "managed_procedure": ["P1", "P10", "P25", "P50"],
}


class Data:
    """The test tables of one folder and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._tables = spark, folder, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def filters(self) -> DataFrame:
        rows = self.spark.createDataFrame(FILTERS, "filter_id int, filter_name string, rule_definition string, active boolean")
        return rows.withColumns({
            "description": F.concat(F.lit("Check "), F.col("filter_name")),
            "rule_type": F.when(F.col("filter_id") % 4 == 0, "ASSOCIATION").otherwise("MANUAL"),
        })

    @property
    def code_sets(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(s, c) for s, codes in CODE_SETS.items() for c in codes], "set_name string, code string")

    @property
    def core(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.claims, self.diagnoses, self.procedures


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filters_sql() -> str:
    rows = ", ".join(f"({i}, {_quote(n)}, {_quote(r)}, {str(a).lower()})" for i, n, r, a in FILTERS)
    return (
        "SELECT filter_id, filter_name, rule_definition, active, concat('Check ', filter_name) AS description, "
        "CASE WHEN filter_id % 4 = 0 THEN 'ASSOCIATION' ELSE 'MANUAL' END AS rule_type "
        f"FROM (VALUES {rows}) AS f(filter_id, filter_name, rule_definition, active)"
    )


def with_views(names: str, body: str) -> str:
    """``WITH`` clause of the named views in front of ``body``, for DuckDB. A body that starts
    with a comma adds its own tables."""
    plain = {t: t for t in TABLES}
    parts = []
    for name in names.split():
        text = _filters_sql() if name == "filters" else VIEWS[name].format(**plain)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts) + " " + body

"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

CLAIMS = T.StructType([
    T.StructField("claim_id", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("provider_id", T.StringType()),
    T.StructField("patient_age", T.IntegerType()),
    T.StructField("provider_type", T.StringType()),
    T.StructField("place_of_service", T.StringType()),
    T.StructField("total_charge_amount", T.DecimalType(12, 2)),
    T.StructField("service_date", T.DateType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("processed_date", T.TimestampType()),
    T.StructField("claim_data", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
])

DIAGNOSES = T.StructType([
    T.StructField("claim_id", T.StringType()),
    T.StructField("diagnosis_code", T.StringType()),
    T.StructField("diagnosis_type", T.StringType()),
    T.StructField("diagnosis_sequence", T.IntegerType()),
    T.StructField("is_principal", T.BooleanType()),
    T.StructField("description", T.StringType()),
])

PROCEDURES = T.StructType([
    T.StructField("claim_id", T.StringType()),
    T.StructField("procedure_code", T.StringType()),
    T.StructField("procedure_type", T.StringType()),
    T.StructField("procedure_sequence", T.IntegerType()),
    T.StructField("charge_amount", T.DecimalType(10, 2)),
    T.StructField("description", T.StringType()),
    T.StructField("service_date", T.DateType()),
    T.StructField("diagnosis_pointers", T.StringType()),
])

FILTERS = T.StructType([
    T.StructField("filter_id", T.IntegerType()),
    T.StructField("filter_name", T.StringType()),
    T.StructField("rule_definition", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("support", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("lift", T.DoubleType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("created_date", T.TimestampType()),
])

CODE_SETS = T.StructType([
    T.StructField("set_name", T.StringType()),
    T.StructField("code", T.StringType()),
])

RULE_OUTCOME = T.StructType([
    T.StructField("filter_id", T.IntegerType()),
    T.StructField("filter_name", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("error", T.StringType()),
])

VALIDATION_RESULTS = T.StructType([
    T.StructField("claim_id", T.StringType()),
    T.StructField("validation_status", T.StringType()),
    T.StructField("predicted_filters", T.ArrayType(T.IntegerType())),
    T.StructField("validation_results", T.ArrayType(RULE_OUTCOME)),
    T.StructField("processing_time", T.DecimalType(10, 6)),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
])

VALIDATION_RESULTS_ARCHIVE = T.StructType(
    VALIDATION_RESULTS.fields + [T.StructField("archived_date", T.TimestampType())]
)

PROCESSING_STATS = T.StructType([
    T.StructField("processing_date", T.DateType()),
    T.StructField("total_claims", T.LongType()),
    T.StructField("successful_validations", T.LongType()),
    T.StructField("failed_validations", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("avg_processing_time", T.DoubleType()),
    T.StructField("peak_memory_usage", T.DoubleType()),
    T.StructField("peak_cpu_usage", T.DoubleType()),
])

PROCESSED_CHUNKS = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("processed_date", T.TimestampType()),
    T.StructField("claims_count", T.LongType()),
    T.StructField("processing_duration_seconds", T.DecimalType(10, 3)),
])

RETRY_QUEUE = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.LongType()),
    T.StructField("resolved", T.BooleanType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("last_retry_date", T.TimestampType()),
])

# Keys that a claim's JSON payload may carry.
PAYLOAD = T.StructType([
    T.StructField("submission_date", T.StringType()),
    T.StructField("member_id", T.StringType()),
    T.StructField("patient_name", T.StringType()),
    T.StructField("provider_name", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("payer", T.StringType()),
    T.StructField("service_date_from", T.StringType()),
    T.StructField("service_date_to", T.StringType()),
])

UNPROCESSED = ["PENDING", "SENT", "RETRY"]

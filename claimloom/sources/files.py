"""Claim and code-list files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimloom import schemas
from claimloom.sources import json_arrays

REQUIRED = ["claim_id", "patient_id", "provider_id", "total_charge_amount"]

# Default diagnosis codes.
DEFAULT_ICD10 = [
    "Z00.00", "I10", "E11.9", "M79.89", "R06.02", "K21.9", "F32.9", "M25.50",
    "E78.5", "N39.0", "J44.1", "M54.5", "R50.9", "K59.00", "F41.9", "M19.90",
    "I25.10", "E66.9", "K76.0", "R51", "J06.9", "M62.81", "F43.10", "N18.6",
    "J02.9", "R06.00", "M79.3", "K30", "R05", "G44.1", "M25.511", "J45.9",
]

# Default procedure codes.
DEFAULT_CPT = [
    "99213", "99214", "99215", "99202", "99203", "99204", "99212", "99291",
    "99232", "99233", "99238", "99239", "36415", "85025", "80053", "93000",
    "71020", "73060", "76700", "99395", "99396", "99385", "99386", "90471",
    "99211", "99205", "99381", "99391", "90686", "90715", "87804", "80048",
]


def check_columns(columns: list[str]) -> None:
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def as_claims(df: DataFrame) -> DataFrame:
    """Cast the known columns to the claims schema; unreadable values become null."""
    return df.select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.CLAIMS.fields
    ])


def read_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """Claims from CSV with a header; raises when a required column is missing."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    check_columns(raw.columns)
    return as_claims(raw)


def read_claims_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Claims from a JSON list, from objects with a ``claims`` list, or (``multi_line=False``,
    the form that splits over tasks) from one claim per line. Other content is an error."""
    schema = T.StructType(schemas.CLAIMS.fields + [T.StructField("claims", T.ArrayType(schemas.CLAIMS))])
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    bare = F.struct(*[F.col(f.name) for f in schemas.CLAIMS.fields])
    invalid = F.raise_error(F.lit(
        "Invalid JSON structure: expected a list of claims or an object with a 'claims' key"))
    return raw.select(F.explode(
        F.when(F.col("claims").isNotNull(), F.col("claims"))
        .when(F.col("claim_id").isNotNull(), F.array(bare))
        .otherwise(invalid)
    ).alias("c")).select("c.*")


def read_claims_array(spark: SparkSession, path: str, range_bytes: int = json_arrays.RANGE) -> DataFrame:
    """Claims from files that hold one JSON list each, read by as many tasks as there are ranges of ``range_bytes``; a claim
    without id is an error, as in ``read_claims_json``."""
    rows = json_arrays.read_json_array(spark, path, schemas.CLAIMS, range_bytes)
    invalid = F.raise_error(F.lit("Invalid JSON structure: expected a list of claims or an object with a 'claims' key"))
    return rows.withColumn("claim_id", F.coalesce("claim_id", invalid.cast("string")))


def codes_of_text(text: Column | str) -> Column:
    """Codes in the text of one code file: the first line when it holds several fields, otherwise
    the first field of every line. Trimmed, blanks dropped, order kept."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    first_fields = F.split(F.get(lines, F.lit(0)), ",")

    def clean(field: Column) -> Column:
        return F.trim(F.regexp_replace(F.trim(field), '^"(.*)"$', "$1"))

    one_row = F.transform(first_fields, clean)
    per_line = F.transform(lines, lambda line: clean(F.get(F.split(line, ","), F.lit(0))))
    return F.filter(F.when(F.size(first_fields) > 1, one_row).otherwise(per_line), lambda c: c != "")


def read_code_list(spark: SparkSession, path: str, default: list[str] | None = None) -> DataFrame:
    """(position, code) of a code file; ``default`` when the file is missing or holds no code."""
    fallback = spark.createDataFrame(
        list(enumerate(DEFAULT_ICD10 if default is None else default)), "position int, code string"
    )
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback
    codes = files.select(F.posexplode(codes_of_text("value")).alias("position", "code"))
    return fallback if codes.isEmpty() else codes


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines as a ``line`` column, for the parsers in ``operators.metrics``."""
    return spark.read.text(path).withColumnRenamed("value", "line")

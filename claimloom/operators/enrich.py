"""Assembly of claims with their child records.

Children are always aggregated to one row per claim before they meet the claim, so
no join multiplies diagnoses by procedures. Map-side partial aggregation collapses
copies of a child before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimloom import schemas
from claimloom.functions import scalars as S
from claimloom.sizing import broadcast_small, reuse

CLAIM_COLUMNS = [
    "claim_id", "patient_age", "provider_type", "place_of_service", "total_charge_amount",
    "service_date", "claim_data", "patient_id", "provider_id", "processing_status",
]

DIAGNOSIS_FIELDS = ["diagnosis_code", "diagnosis_type", "diagnosis_sequence", "description", "is_principal"]
PROCEDURE_FIELDS = ["procedure_code", "procedure_type", "procedure_sequence", "description", "charge_amount",
                    "service_date", "diagnosis_pointers"]


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _diagnosis_entry(x: Column) -> Column:
    return F.struct(
        x["diagnosis_code"].alias("code"),
        x["diagnosis_type"].alias("type"),
        x["diagnosis_sequence"].alias("sequence"),
        x["description"].alias("description"),
        x["is_principal"].alias("is_principal"),
    )


def _procedure_entry(x: Column) -> Column:
    return F.struct(
        x["procedure_code"].alias("code"),
        x["procedure_type"].alias("type"),
        x["procedure_sequence"].alias("sequence"),
        x["description"].alias("description"),
        x["charge_amount"].alias("charge_amount"),
        x["service_date"].alias("service_date"),
        S.parse_pointers(x["diagnosis_pointers"]).alias("diagnosis_pointers"),
    )


def _child_sets(children: DataFrame, code: str, entry, name: str, fields: list[str]) -> DataFrame:
    """One array per claim, which has to fit in a row: copies go in the set that each map task keeps of a claim, so that lines are
    shuffled once, and a claim with very many copies is folded where they are read. Entries are then built once per distinct row."""
    sets = children.filter(F.col(code).isNotNull()).groupBy("claim_id").agg(F.collect_set(F.struct(*fields)).alias(name))
    return sets.withColumn(name, F.array_sort(F.transform(name, entry)))


def _with_arrays(claims: DataFrame, *sides: DataFrame) -> DataFrame:
    out = claims
    for side in sides:
        name = side.columns[-1]
        out = out.join(side, "claim_id", "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast(side.schema[name].dataType))
        )
    return out


def enrich_claims(
    claims: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Claims of the given statuses with arrays of their distinct coded children."""
    chosen = claims.filter(F.col("processing_status").isin(statuses or ["PENDING"]))
    return _with_arrays(
        chosen.select(*_present(claims, CLAIM_COLUMNS)),
        _child_sets(diagnoses, "diagnosis_code", _diagnosis_entry, "diagnoses", DIAGNOSIS_FIELDS),
        _child_sets(procedures, "procedure_code", _procedure_entry, "procedures", PROCEDURE_FIELDS),
    )


def enrich_unprocessed(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """As ``enrich_claims`` for every status that is still to be processed; page it with
    ``page(df, [F.desc("service_date"), "claim_id"], ...)``."""
    return enrich_claims(claims, diagnoses, procedures, schemas.UNPROCESSED)


def page(df: DataFrame, order_by: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET over a stated, unique order."""
    out = df.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def collect_codes(children: DataFrame, code: str, name: str = "codes") -> DataFrame:
    """Sorted distinct non-null codes per claim; bounded by the code vocabulary."""
    return (
        children.filter(F.col(code).isNotNull())
        .groupBy("claim_id")
        .agg(F.sort_array(F.collect_set(code)).alias(name))
    )


def claim_codes(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """Claims with sorted distinct code arrays ``diagnoses`` and ``procedures``."""
    return _with_arrays(
        claims,
        collect_codes(diagnoses, "diagnosis_code", "diagnoses"),
        collect_codes(procedures, "procedure_code", "procedures"),
    )


def page_codes(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """``claim_codes`` of few claims, like those of a page: lines of other claims go before anything is shuffled. Where the claims are
    too many to be broadcast, lines meet them in a shuffle join, to the same result."""
    claims = reuse(claims)
    ids = broadcast_small(claims.select("claim_id").distinct())
    return claim_codes(claims, diagnoses.join(ids, "claim_id", "left_semi"), procedures.join(ids, "claim_id", "left_semi"))


def claim_summary(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """One row per claim with its distinct code arrays, free of join fan-out."""
    return claim_codes(claims.select("claim_id"), diagnoses, procedures)


def _code_counts(children: DataFrame, code: str, side: str) -> DataFrame:
    return (
        children.groupBy("claim_id", F.col(code).alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("claim_id")
        .agg(
            F.collect_list(F.struct("code", "n")).alias(side),
            F.sum("n").alias(f"{side}_rows"),
        )
    )


def claim_summary_counts(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """How often each code (null included) occurs per claim in the join of both children.

    The join itself is never built: a diagnosis row appears once per procedure row of the
    claim (at least once) and the other way round, so counts multiply instead.
    """
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("code"), F.lit(1).cast("long").alias("n")))
    return (
        claims.select("claim_id")
        .join(_code_counts(diagnoses, "diagnosis_code", "d"), "claim_id", "left")
        .join(_code_counts(procedures, "procedure_code", "p"), "claim_id", "left")
        .select(
            "claim_id",
            F.transform(
                F.coalesce("d", nothing),
                lambda e: F.struct(e["code"].alias("code"), (e["n"] * F.coalesce("p_rows", F.lit(1))).alias("n")),
            ).alias("diagnoses"),
            F.transform(
                F.coalesce("p", nothing),
                lambda e: F.struct(e["code"].alias("code"), (e["n"] * F.coalesce("d_rows", F.lit(1))).alias("n")),
            ).alias("procedures"),
        )
    )


def claim_summary_raw(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """Both code arrays with the duplicates and nulls of the plain two-way join."""

    def expand(side: str) -> Column:
        return F.flatten(F.transform(F.col(side), lambda e: F.array_repeat(e["code"], e["n"].cast("int"))))

    return claim_summary_counts(claims, diagnoses, procedures).select(
        "claim_id",
        F.sort_array(expand("diagnoses")).alias("diagnoses"),
        F.sort_array(expand("procedures")).alias("procedures"),
    )


def training_set(
    claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, results: DataFrame
) -> DataFrame:
    """COMPLETED claims with code arrays, one row per distinct prediction list stored for them."""
    chosen = claims.filter(F.col("processing_status") == "COMPLETED").select(
        *_present(claims, ["claim_id", "patient_age", "provider_type", "place_of_service",
                           "total_charge_amount", "patient_id", "provider_id"])
    )
    predictions = (
        results.filter(F.col("validation_status") == "COMPLETED")
        .select("claim_id", "predicted_filters")
        .distinct()
    )
    return (
        claim_codes(chosen, diagnoses, procedures)
        .join(predictions, "claim_id", "left")
        .withColumn("applied_filters", S.parse_pointers("predicted_filters"))
        .drop("predicted_filters")
    )


def transactions(
    claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, limit: int | None = None
) -> DataFrame:
    """(claim_id, items) of COMPLETED claims; ``limit`` keeps the first claims by id."""
    chosen = claims.filter(F.col("processing_status") == "COMPLETED").select(
        "claim_id", "patient_age", "provider_type", "place_of_service"
    )
    if limit is not None:
        chosen = chosen.orderBy("claim_id").limit(limit)
    return claim_codes(chosen, diagnoses, procedures).select(
        "claim_id",
        S.item_tags("diagnoses", "procedures", "provider_type", "place_of_service", "patient_age").alias("items"),
    )


def claim_measures(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """Claim columns with code sets, counts, primary diagnosis and line total, without
    building arrays of child records.

    Exact copies are removed in a first aggregation keyed by the whole child row, which
    spreads a claim with very many lines over all tasks; the second one folds per claim.
    """
    d = (
        diagnoses.filter(F.col("diagnosis_code").isNotNull())
        .select("claim_id", *DIAGNOSIS_FIELDS).distinct()
        .groupBy("claim_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("diagnosis_count"),
            F.sort_array(F.collect_set("diagnosis_code")).alias("diagnosis_codes"),
            F.min(F.when(F.col("is_principal"), F.struct(*_principal_order()))).alias("principal"),
            F.min(F.struct(F.coalesce("diagnosis_sequence", F.lit(999)), *_principal_order())).alias("first_line"),
        )
        .select(
            "claim_id", "diagnosis_count", "diagnosis_codes",
            F.coalesce("principal.diagnosis_code", "first_line.diagnosis_code").alias("primary_diagnosis"),
        )
    )
    p = (
        procedures.filter(F.col("procedure_code").isNotNull())
        .select("claim_id", *PROCEDURE_FIELDS).distinct()
        .groupBy("claim_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("procedure_count"),
            F.sort_array(F.collect_set("procedure_code")).alias("procedure_codes"),
            F.sum("charge_amount").cast("decimal(22,2)").alias("total_procedure_amount"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        claims.join(d, "claim_id", "left")
        .join(p, "claim_id", "left")
        .withColumns({
            "diagnosis_count": F.coalesce("diagnosis_count", F.lit(0)),
            "procedure_count": F.coalesce("procedure_count", F.lit(0)),
            "diagnosis_codes": F.coalesce("diagnosis_codes", none),
            "procedure_codes": F.coalesce("procedure_codes", none),
            "total_procedure_amount": F.coalesce("total_procedure_amount", F.lit(0).cast("decimal(22,2)")),
        })
    )


def line_measures(diagnoses: Column | str, procedures: Column | str) -> dict[str, Column]:
    """The columns that ``claim_measures`` adds, for rows that hold their child records as arrays of structs: no shuffle and no join."""
    coded = lambda lines, code, fields: F.array_distinct(F.transform(
        F.filter(S.as_col(lines), lambda x: x[code].isNotNull()), lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    d, p = coded(diagnoses, "diagnosis_code", DIAGNOSIS_FIELDS), coded(procedures, "procedure_code", PROCEDURE_FIELDS)
    ordered = lambda x: [x[f].alias(f) for f in _principal_order()]
    principal = F.array_min(F.transform(F.filter(d, lambda x: x["is_principal"]), lambda x: F.struct(*ordered(x))))
    first_line = F.array_min(F.transform(d, lambda x: F.struct(F.coalesce(x["diagnosis_sequence"], F.lit(999)).alias("at"), *ordered(x))))
    codes = lambda lines, code: F.array_sort(F.array_distinct(F.transform(lines, lambda x: x[code])))
    return {
        "diagnosis_count": F.size(d),
        "diagnosis_codes": codes(d, "diagnosis_code"),
        "primary_diagnosis": F.coalesce(principal["diagnosis_code"], first_line["diagnosis_code"]),
        "procedure_count": F.size(p),
        "procedure_codes": codes(p, "procedure_code"),
        "total_procedure_amount": S.total_procedure_amount(p),
    }


def _principal_order() -> list[str]:
    """Field order of a diagnosis entry, so ties fall as in the sorted array form."""
    return ["diagnosis_code", "diagnosis_type", "diagnosis_sequence", "description"]


def facts(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """(claim_id, kind, value) rows; null values give no fact."""
    scalars = claims.select(
        "claim_id",
        F.explode(F.array(
            F.struct(F.lit("age").alias("kind"), F.col("patient_age").cast("string").alias("value")),
            F.struct(F.lit("charge").alias("kind"), F.col("total_charge_amount").cast("string").alias("value")),
            F.struct(F.lit("provider").alias("kind"), F.col("provider_type").alias("value")),
            F.struct(F.lit("place").alias("kind"), F.col("place_of_service").alias("value")),
        )).alias("fact"),
    ).select("claim_id", "fact.kind", "fact.value")
    return (
        scalars
        .unionByName(diagnoses.select("claim_id", F.lit("diagnosis").alias("kind"), F.col("diagnosis_code").alias("value")))
        .unionByName(procedures.select("claim_id", F.lit("procedure").alias("kind"), F.col("procedure_code").alias("value")))
        .filter(F.col("value").isNotNull())
        .distinct()
    )

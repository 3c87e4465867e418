"""Row-level expressions. Every function takes and returns Columns (or a DataFrame
when it adds several columns) and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimloom import schemas

# Provider type by place-of-service code.
PROVIDER_BY_PLACE = {
    "11": "PRIMARY_CARE",
    "12": "PRIMARY_CARE",
    "21": "HOSPITAL",
    "22": "HOSPITAL",
    "23": "EMERGENCY",
    "24": "URGENT_CARE",
    "31": "SPECIALIST",
    "41": "URGENT_CARE",
    "49": "SPECIALIST",
    "50": "SPECIALIST",
    "71": "SPECIALIST",
    "81": "SPECIALIST",
}
DEFAULT_PROVIDER = "SPECIALIST"

# Masking patterns and their replacements, applied in this order.
# (?U) makes \b and \d Unicode-aware.
MASKS = [
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "XXX-XX-XXXX"),
    (r"(?U)\b\d{16}\b", "XXXX-XXXX-XXXX-XXXX"),
    (r"(?iU)\bDOB[:\s]*\d{1,2}/\d{1,2}/\d{4}\b", "DOB: XX/XX/XXXX"),
]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_avg(c: Column | str) -> Column:
    """Average of a decimal column as a double: exact sum, one division, order-free."""
    c = as_col(c)
    n = F.count(c)
    return F.when(n > 0, F.sum(c).cast("double") / n)


def age_group(age: Column | str) -> Column:
    age = as_col(age)
    return F.when(age < 18, "CHILD").when(age >= 65, "SENIOR").otherwise("ADULT")


def provider_type_from_pos(pos: Column | str) -> Column:
    pos = as_col(pos)
    pairs = [F.lit(v) for kv in PROVIDER_BY_PLACE.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), pos), F.lit(DEFAULT_PROVIDER))


def prefixed(prefix: str, codes: Column | str) -> Column:
    """Each non-null code of an array as ``<prefix><code>``."""
    return F.transform(F.array_compact(as_col(codes)), lambda c: F.concat(F.lit(prefix), c))


def item_tags(
    diagnoses: Column | str,
    procedures: Column | str,
    provider_type: Column | str,
    place_of_service: Column | str,
    patient_age: Column | str,
) -> Column:
    """Flat item list of one claim; null inputs give no item."""
    return F.concat(
        prefixed("DIAG_", diagnoses),
        prefixed("PROC_", procedures),
        prefixed("PROVIDER_", F.array(as_col(provider_type))),
        prefixed("POS_", F.array(as_col(place_of_service))),
        F.array(F.concat(F.lit("AGE_"), age_group(patient_age))),
    )


def primary_diagnosis(diagnoses: Column | str) -> Column:
    """First principal entry, else the lowest sequence (missing counts as 999), else null."""
    numbered = F.transform(
        as_col(diagnoses),
        lambda d, i: F.struct(
            F.when(d["is_principal"], F.lit(0)).otherwise(F.lit(1)).alias("tier"),
            F.when(d["is_principal"], F.lit(0)).otherwise(F.coalesce(d["sequence"], F.lit(999))).alias("seq"),
            i.alias("pos"),
            d["code"].alias("code"),
        ),
    )
    return F.array_min(numbered)["code"]


def total_procedure_amount(procedures: Column | str) -> Column:
    """Sum of the non-null line charges of an array of procedures, 0 when there are none."""
    return F.aggregate(
        as_col(procedures),
        F.lit(0).cast("decimal(22,2)"),
        lambda acc, p: (acc + F.coalesce(p["charge_amount"], F.lit(0))).cast("decimal(22,2)"),
    )


def mask_phi(text: Column | str) -> Column:
    out = as_col(text)
    for pattern, replacement in MASKS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def priority_tier(priority: Column | str) -> Column:
    p = as_col(priority)
    return F.when(p >= 8, "high").when(p >= 5, "normal").otherwise("low")


def split_charge(total: Column | str, parts: Column | str, index: Column | str) -> Column:
    """Share of 1-based ``index`` when ``total`` is split into ``parts``; the last takes the rest."""
    total, parts, index = as_col(total).cast("decimal(12,2)"), as_col(parts), as_col(index)
    share = F.round(total / parts, 2).cast("decimal(12,2)")
    rest = total - share * (parts - 1).cast("decimal(10,0)")
    return F.when(index < parts, share).otherwise(rest).cast("decimal(12,2)")


def parse_pointers(pointers: Column | str) -> Column:
    """JSON array text to ``array<int>``; null or malformed text gives an empty array."""
    parsed = F.from_json(as_col(pointers), "array<int>")
    return F.coalesce(parsed, F.array().cast("array<int>"))


def applied_filters(predicted: Column | str) -> Column:
    """Positive filter ids of a JSON array text, in order."""
    return F.filter(parse_pointers(predicted), lambda x: x > 0)


def merge_payload(
    claims: DataFrame, schema: T.StructType = schemas.PAYLOAD, payload: str = "claim_data"
) -> DataFrame:
    """Add the payload's keys as columns; a key that is present overrides a column of that name,
    also with null. Rows without a JSON object keep their values."""
    keys = F.json_object_keys(F.col(payload))
    body = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"})
    merged = {}
    for field in schema.fields:
        if field.name in claims.columns:
            kept = F.col(field.name)
            value = body[field.name].cast(claims.schema[field.name].dataType)
        else:
            kept, value = F.lit(None).cast(field.dataType), body[field.name]
        merged[field.name] = F.when(
            F.coalesce(F.array_contains(keys, field.name), F.lit(False)), value
        ).otherwise(kept)
    return claims.withColumns(merged)


def with_claim_measures(enriched: DataFrame) -> DataFrame:
    """Counts, primary diagnosis and line total derived from the child arrays."""
    return enriched.withColumns({
        "diagnosis_count": F.size("diagnoses"),
        "procedure_count": F.size("procedures"),
        "primary_diagnosis": primary_diagnosis("diagnoses"),
        "total_procedure_amount": total_procedure_amount("procedures"),
    })

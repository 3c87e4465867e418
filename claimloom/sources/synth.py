"""Synthetic claims. Every draw is a part of the MD5 of (id, purpose, seed): reproducible by any engine, independent of
partitioning, and without state shared between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimloom.functions.scalars import provider_type_from_pos, split_charge
from claimloom.sources.files import DEFAULT_CPT, DEFAULT_ICD10

# Pools for generated people, payers and statuses.
FIRST_NAMES = [
    "JOHN", "MARY", "DAVID", "SARAH", "MICHAEL", "EMMA", "JAMES", "LISA",
    "ROBERT", "JENNIFER", "WILLIAM", "LINDA", "RICHARD", "PATRICIA", "CHARLES", "BARBARA",
    "THOMAS", "ELIZABETH", "CHRISTOPHER", "MARIA", "DANIEL", "SUSAN", "MATTHEW", "MARGARET",
]
LAST_NAMES = [
    "SMITH", "JOHNSON", "WILLIAMS", "BROWN", "JONES", "GARCIA", "MILLER", "DAVIS",
    "RODRIGUEZ", "MARTINEZ", "HERNANDEZ", "LOPEZ", "GONZALEZ", "WILSON", "ANDERSON", "THOMAS",
    "TAYLOR", "MOORE", "JACKSON", "MARTIN", "LEE", "PEREZ", "THOMPSON", "WHITE",
]
SEXES = ["F", "M", "U"]
PAYERS = [
    "Medicare", "Medicaid", "Blue Cross", "Others", "Self Pay", "HMO", "Tricare", "Commercial",
    "Workers Comp", "MC Advantage", "Aetna", "Cigna", "UnitedHealth", "Humana",
]
STATUSES = ["PENDING", "PROCESSING", "APPROVED"]
PLACES = [str(i) for i in range(1, 21)]

NPI_FIRST, NPI_COUNT = 1_000_000_000, 9_000_000_000
NPI_STEP = 7_368_787  # shares no factor with NPI_COUNT, so stepping never repeats a number


class Draws:
    def __init__(self, seed: int):
        self.seed = seed

    def bits(self, *parts: Column | str) -> Column:
        """60 bits for the parts, as text joined by bars, and the seed."""
        digest = F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(str(self.seed))).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def below(self, n: Column | int, purpose: str) -> Column:
        """Integer in [0, n)."""
        n = F.lit(n) if isinstance(n, int) else n
        return F.pmod(self.bits("id", F.lit(purpose)), n.cast("long"))

    def choice(self, values: list[str], purpose: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.below(len(values), purpose).cast("int"))

    def sample(self, values: Column, k: Column, purpose: str) -> Column:
        """``k`` distinct entries of an array, in the order of their draws."""
        ranked = F.array_sort(F.transform(values, lambda v, i: F.struct(self.bits("id", i, F.lit(purpose)).alias("h"), v.alias("v"))))
        return F.transform(F.slice(ranked, F.lit(1), k), lambda r: r["v"])


def synth_claims_for(ids: DataFrame, as_of, seed: int = 42) -> DataFrame:
    """One claim per row of ``ids`` (distinct non-negative ``id``)."""
    d = Draws(seed)
    as_of_date = F.to_date(as_of if isinstance(as_of, Column) else F.lit(as_of))
    base = ids.select("id").withColumns({
        "claim_id": F.concat(F.lit("CLM_"), F.lpad(F.hex("id"), F.greatest(F.lit(8), F.length(F.hex("id"))), F.lit("0"))),
        "patient_id": F.concat(F.lit("PAT_"), d.below(900_000, "patient") + 100_000),
        "provider_id": (F.pmod(F.col("id").cast("decimal(20,0)") * NPI_STEP + seed, F.lit(NPI_COUNT).cast("decimal(20,0)"))
                        .cast("long") + NPI_FIRST).cast("string"),
        "service_date": F.date_sub(as_of_date, d.below(731, "day").cast("int")),
        "total_charge_amount": ((d.below(497_501, "charge") + 2_500) / 100).cast("decimal(12,2)"),
        "patient_age": (d.below(95, "age") + 1).cast("int"),
        "place_of_service": d.choice(PLACES, "place"),
        "processing_status": d.choice(STATUSES, "status"),
    })
    person = lambda who: F.concat_ws(" ", d.choice(FIRST_NAMES, who + " first"), d.choice(LAST_NAMES, who + " last"))
    stay = d.below(d.below(31, "longest stay") + 1, "stay").cast("int")
    return base.withColumns({
        "provider_type": provider_type_from_pos("place_of_service"),
        "claim_data": F.to_json(F.struct(
            as_of_date.cast("string").alias("submission_date"),
            F.concat(F.lit("MBR_"), d.below(9_000_000, "member") + 1_000_000).alias("member_id"),
            person("patient").alias("patient_name"),
            F.concat(F.lit("Dr. "), person("provider")).alias("provider_name"),
            d.choice(SEXES, "sex").alias("sex"),
            d.choice(PAYERS, "payer").alias("payer"),
            F.col("service_date").cast("string").alias("service_date_from"),
            F.date_add("service_date", stay).cast("string").alias("service_date_to"),
        )),
    })


def synth_diagnoses(claims: DataFrame, codes: list[str] = DEFAULT_ICD10, seed: int = 42) -> DataFrame:
    """1 to 5 distinct codes per claim; the first is the principal one. Needs ``id``."""
    d = Draws(seed)
    count = _diagnosis_count(d, codes)
    chosen = d.sample(F.array(*map(F.lit, codes)), count, "diagnoses")
    return claims.select("claim_id", F.posexplode(chosen).alias("i", "diagnosis_code")).select(
        "claim_id", "diagnosis_code", F.lit("ICD10").alias("diagnosis_type"),
        (F.col("i") + 1).alias("diagnosis_sequence"), (F.col("i") == 0).alias("is_principal"),
        F.concat(F.lit("Diagnosis description for "), "diagnosis_code").alias("description"),
    )


def _diagnosis_count(d: Draws, codes: list[str]) -> Column:
    return (d.below(min(5, len(codes)), "diagnosis count") + 1).cast("int")


def synth_procedures(
    claims: DataFrame, codes: list[str] = DEFAULT_CPT, diagnosis_codes: list[str] = DEFAULT_ICD10, seed: int = 42
) -> DataFrame:
    """1 to 3 distinct codes per claim; lines share the charge, the last takes the rest, and each
    points at 1 to 4 of the claim's diagnoses. Needs ``id``."""
    d = Draws(seed)
    count = (d.below(min(3, len(codes)), "procedure count") + 1).cast("int")
    chosen = d.sample(F.array(*map(F.lit, codes)), count, "procedures")
    lines = claims.select(
        "id", "claim_id", "service_date", "total_charge_amount", count.alias("n"),
        _diagnosis_count(d, diagnosis_codes).alias("n_diagnoses"), F.posexplode(chosen).alias("i", "procedure_code"),
    )
    pointer_count = F.pmod(d.bits("id", "i", F.lit("pointer count")), F.least(F.lit(4), F.col("n_diagnoses")).cast("long")) + 1
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(1), F.col("n_diagnoses")),
        lambda p: F.struct(d.bits("id", "i", p, F.lit("pointers")).alias("h"), p.alias("p"))))
    pointers = F.array_sort(F.transform(F.slice(ranked, F.lit(1), pointer_count.cast("int")), lambda r: r["p"]))
    return lines.select(
        "claim_id", "procedure_code", F.lit("CPT").alias("procedure_type"),
        (F.col("i") + 1).alias("procedure_sequence"),
        split_charge("total_charge_amount", "n", F.col("i") + 1).cast("decimal(10,2)").alias("charge_amount"),
        F.concat(F.lit("Procedure description for "), "procedure_code").alias("description"),
        "service_date", F.to_json(pointers).alias("diagnosis_pointers"),
    )


def synth_claims(spark: SparkSession, n: int, as_of, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n`` claims with their diagnoses and procedures."""
    claims = synth_claims_for(spark.range(n), as_of, seed)
    return claims, synth_diagnoses(claims, seed=seed), synth_procedures(claims, seed=seed)

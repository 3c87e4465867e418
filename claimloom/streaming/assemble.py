"""Claims and their lines as three streams, put together by a session per claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimloom.operators.enrich import line_measures
from claimloom.plans.validate import validate_measured

PARTS = "claim", "diagnosis", "procedure"


def assemble_stream(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, at: str = "arrived_at", delay: str = "10 minutes", wait: str = "30 minutes") -> DataFrame:
    """One row per claim_id and session of arrivals: claim (struct), diagnoses and procedures (arrays of structs).

    All three streams have claim_id and the event time ``at``. What arrives for a claim within ``wait`` of something else of it belongs
    together, whichever comes first; the row comes once the watermark, ``delay`` behind the slowest of the three streams, has passed the
    session's end, and its state goes. Of several rows of a claim in a session the last counts. Lines that come later, or for a claim that
    never comes, form a session without claim: ``claim`` is null. A row without claim_id only tells the time.
    """
    sides = dict(zip(PARTS, (claims, diagnoses, procedures)))
    kinds = {name: df.drop(at).schema for name, df in sides.items()}

    def part(name: str, df: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in df.columns if c != at])
        return df.withWatermark(at, delay).select("claim_id", F.col(at).alias("at"), *[(whole if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in PARTS])

    rows = None
    for name, df in sides.items():
        rows = part(name, df) if rows is None else rows.unionByName(part(name, df))
    # One condition that looks at the time as well, so that Spark leaves it behind the watermark, which rows without claim have to pass;
    # rows without a time are in no session.
    rows = rows.filter(F.col("claim_id").isNotNull() | F.col("at").isNull())

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at")))

    return rows.groupBy(F.session_window("at", wait).alias("session"), "claim_id").agg(
        last("claim").alias("claim"), F.collect_list("diagnosis").alias("diagnoses"), F.collect_list("procedure").alias("procedures"), F.max("at").alias("last_at"))


def validate_assembled(assembled: DataFrame, filters: DataFrame, code_sets: DataFrame, sink: str, checkpoint: str, **validation) -> DataStreamWriter:
    """Writer that validates the claims of each micro-batch with the lines that came with them, and reads nothing else but rules.
    A session's lines are in its row, so they are measured there; a claim of several sessions gets a result of each.

    Results go to ``<sink>/results``, sessions without a claim to ``<sink>/without_claim`` as they are, each into the batch's own partition,
    which is overwritten when the batch is run again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        measures = line_measures("diagnoses", "procedures")
        whole = batch.filter("claim IS NOT NULL").select("claim.*", *[c.alias(n) for n, c in measures.items()])
        results = validate_measured(whole, filters, code_sets, **validation)
        results.write.mode("overwrite").parquet(f"{sink}/results/batch_id={batch_id}")
        batch.filter("claim IS NULL").drop("claim", "session").write.mode("overwrite").parquet(f"{sink}/without_claim/batch_id={batch_id}")
        batch.unpersist()

    return assembled.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)

"""Queries: the streaming forms, run to the end over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.catalog.registry import ORACLES, query, scratch
from claimloom.catalog.reporting import rounded
from claimloom.catalog.rulesets import _candidates, outcome_text
from claimloom.operators import metrics
from claimloom.sources.files import as_claims
from claimloom.streaming.alerts import ALERT, alert_stream
from claimloom.streaming.assemble import assemble_stream, validate_assembled
from claimloom.streaming.claims import claims_stream, dedupe_stream, rate_stream, validate_stream
from claimloom.streaming.state import state_on_disk

ALERT_LIMITS = dict(max_error_rate=0.005)


# Files that claims arrive in, at most: a batch that reads the lines reads all of them, so batches must not grow in number with the claims.
ARRIVING_FILES = 16


def _arriving(d, root):
    """Claims as files in a folder a stream can read."""
    claims = as_claims(d.claims).withColumn("created_date", F.col("service_date").cast("timestamp"))
    claims.coalesce(ARRIVING_FILES).write.parquet(f"{root}/in")
    return claims_stream(d.spark, f"{root}/in", files_per_batch=4)


def _run(writer):
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()


@query("X1_claims_stream", "claims", "SELECT claim_id, processing_status FROM claims")
def stream_claims(d):
    root = scratch(d.spark, "stream")
    _run(_arriving(d, root).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))
    return d.spark.read.schema(schemas.CLAIMS).parquet(f"{root}/out").select("claim_id", "processing_status")


@query("X2_validate_stream")
def stream_validation(d):
    """Pending claims validated batch by batch; the same rows as the batch query."""
    root = scratch(d.spark, "validate")
    pending = _arriving(d, root).filter(F.col("processing_status") == "PENDING")
    for name, lines in (("diagnoses", d.diagnoses), ("procedures", d.procedures)):
        lines.write.parquet(f"{root}/{name}")
    diagnoses, procedures = (d.spark.read.parquet(f"{root}/{name}") for name in ("diagnoses", "procedures"))
    _run(validate_stream(pending, diagnoses, procedures, d.filters, d.code_sets, f"{root}/out", f"{root}/cp",
                         candidates=_candidates(d)))
    return outcome_text(d.spark.read.parquet(f"{root}/out"))


ORACLES["X2_validate_stream"] = ORACLES["V5_validate_claims"]


@query("X3_dedupe_stream", "claims", "SELECT claim_id, processing_status FROM claims")
def stream_dedupe(d):
    """Every claim arrives twice."""
    root = scratch(d.spark, "dedupe")
    twice = _arriving(d, root).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    _run(dedupe_stream(twice).select("claim_id", "processing_status").writeStream.format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))
    return d.spark.read.schema("claim_id string, processing_status string").parquet(f"{root}/out")


@query("X3_dedupe_within", "claims", """
SELECT claim_id, CASE WHEN cast(right(claim_id, 10) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS n_passed FROM claims""")
def stream_dedupe_within(d):
    """Every claim comes again within the hour, and every third once more after two days, when its key has gone."""
    root = scratch(d.spark, "dedupe")
    number = F.right("claim_id", F.lit(10)).cast("long")
    as_claims(d.claims).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + number % 3000)).write.parquet(f"{root}/in/part0")
    rows = d.spark.read.parquet(f"{root}/in/part0")
    again = rows.withColumn("at", F.col("at") + F.expr("INTERVAL 20 MINUTES"))
    late = rows.filter(number % 3 == 0).withColumn("at", F.col("at") + F.expr("INTERVAL 2 DAYS"))
    # a row without claim only tells the time
    day_after = d.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "at"], F.timestamp_seconds(F.lit(1_700_108_000)).alias("at"))
    with state_on_disk(d.spark):
        for n, part in enumerate((rows, again, day_after, day_after.withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR")), late)):
            # A part is in as many files as it takes, all of one batch: each run goes on from the checkpoint of the one before it.
            if n:
                part.write.parquet(f"{root}/in/part{n}")
            stream = d.spark.readStream.schema(rows.schema).parquet(f"{root}/in/part*")
            _run(dedupe_stream(stream, "claim_id", "at", "1 hour").select("claim_id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))
    found = d.spark.read.schema("claim_id string").parquet(f"{root}/out").filter("claim_id IS NOT NULL")
    return found.groupBy("claim_id").agg(F.count(F.lit(1)).cast("int").alias("n_passed"))


@query("X2_assembled_stream")
def stream_assembled(d):
    """Claims, diagnoses and procedures as three streams: lines come before, with or after their claim."""
    root = scratch(d.spark, "assembled")
    number = F.right("claim_id", F.lit(10)).cast("long")
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000) + number % 7200 + 60 * minutes)
    pending = d.claims.filter(F.col("processing_status") == "PENDING")
    ids = pending.select("claim_id")
    shift = F.element_at(F.array(F.lit(-20), F.lit(0), F.lit(25)), (number % 3 + 1).cast("int"))
    sides = {
        "claims": pending.withColumn("arrived_at", at(F.lit(0))),
        "diagnoses": d.diagnoses.join(ids, "claim_id", "left_semi").withColumn("arrived_at", at(shift)),
        "procedures": d.procedures.join(ids, "claim_id", "left_semi").withColumn("arrived_at", at(-shift)),
    }
    streams = []
    for name, df in sides.items():
        df.sortWithinPartitions("arrived_at").write.parquet(f"{root}/{name}")
        # the last row of each stream only tells the time
        end = d.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "arrived_at"], F.timestamp_seconds(F.lit(1_700_100_000)).alias("arrived_at"))
        end.write.mode("append").parquet(f"{root}/{name}")
        streams.append(d.spark.readStream.schema(df.schema).parquet(f"{root}/{name}"))
    with state_on_disk(d.spark):
        _run(validate_assembled(assemble_stream(*streams), d.filters, d.code_sets, f"{root}/out", f"{root}/cp", candidates=_candidates(d)))
    return outcome_text(d.spark.read.parquet(f"{root}/out/results"))


ORACLES["X2_assembled_stream"] = ORACLES["V5_validate_claims"]


@query("X5_alert_stream")
def stream_alerts(d):
    """Alerts of the event stream, at the limits of the batch query; what fires after the last event is left out."""
    root = scratch(d.spark, "alerts")
    events = d.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/in")
    last = events.agg(F.max("ts").alias("ts")).first().ts
    events.limit(1).select((F.lit(last) + F.expr("INTERVAL 3 HOURS")).alias("ts"), F.lit(None).cast("boolean").alias("failed")).write.mode("append").parquet(f"{root}/in")
    stream = d.spark.readStream.schema("ts timestamp, failed boolean").parquet(f"{root}/in")
    with state_on_disk(d.spark):
        _run(alert_stream(stream, **ALERT_LIMITS).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp"))
    found = d.spark.read.schema(ALERT).parquet(f"{root}/out").filter(F.col("fired_at") <= F.date_trunc("minute", F.lit(last)) + F.expr("INTERVAL 1 MINUTE"))
    return found.select("alert", "severity", F.unix_timestamp("fired_at").alias("fired_at"))


ORACLES["X5_alert_stream"] = ORACLES["X5_alerts"]


@query("X4_windowed_rate_stream")
def stream_rate(d):
    """Sliding windows of the event stream, all of them, from counts per minute."""
    root = scratch(d.spark, "rate")
    d.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed")).write.parquet(f"{root}/in")
    _run(rate_stream(d.spark.readStream.schema("ts timestamp, failed boolean").parquet(f"{root}/in"), f"{root}/out", f"{root}/cp"))
    counts = d.spark.read.schema("minute long, processed long, errors long").parquet(f"{root}/out")
    return metrics.rates_of_minutes(counts).select(
        F.unix_timestamp("window_end").alias("window_end"), rounded("processed_rate"), rounded("error_rate"))


ORACLES["X4_windowed_rate_stream"] = ORACLES["X4_windowed_rate"]

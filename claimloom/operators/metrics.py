"""Operational measures: histograms, run figures, log analysis, rates and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimloom.functions.scalars import mask_phi
from claimloom.operators.numbering import running_totals
from claimloom.sizing import reuse

# Histogram bucket bounds.
CLAIM_SECONDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
VALIDATION_SECONDS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0]
BATCH_SIZES = [10, 50, 100, 250, 500, 1000, 2000]
BATCH_SECONDS = [1, 5, 10, 30, 60, 120, 300]

DAY = 86_400


def duration_histogram(df: DataFrame, column: str, buckets: list[float] = CLAIM_SECONDS) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf, count and sum; one pass, one output row
    per bound."""
    value = F.col(column).cast("decimal(22,6)")
    bounds = [(str(float(b)), F.count_if(F.col(column) <= float(b))) for b in buckets] + [("+Inf", F.count(column))]
    folded = df.agg(
        F.array(*[F.struct(F.lit(le).alias("le"), n.alias("cumulative_count")) for le, n in bounds]).alias("bounds"),
        F.count(column).alias("total_count"),
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total_sum"),
    )
    return folded.select(F.explode("bounds").alias("b"), "total_count", "total_sum").select("b.*", "total_count", "total_sum")


def _per(part: Column, whole: Column, factor: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole * factor).otherwise(F.lit(0.0))


def _result_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col("validation_status") == "COMPLETED").alias("processed"),
        F.count_if(F.col("validation_status") == "ERROR").alias("validation_errors"),
    )


def _with_chunk_totals(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk figures to a one-row frame, as a scalar subquery."""
    totals = chunks.agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("status") == "FAILED", F.col("claims_count"))), F.lit(0)).alias("storage_errors"),
        F.coalesce(F.sum("processing_duration_seconds").cast("double"), F.lit(0.0)).alias("total_duration_seconds"),
    )).scalar()
    return counts.withColumn("_t", totals).select("*", "_t.*").drop("_t")


def metrics_summary(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Processed results, errors, duration and hourly rate as one row."""
    return _with_chunk_totals(_result_counts(results), chunks).select(
        F.col("processed").alias("claims_processed"), "validation_errors", "storage_errors",
        "total_duration_seconds",
        _per(F.col("processed"), F.col("total_duration_seconds"), 3600.0).alias("processing_rate_per_hour"),
    )


def run_report(claims: DataFrame, results: DataFrame, chunks: DataFrame, batch_size: int = 1000) -> DataFrame:
    """Figures of a run: progress over the claims, throughput and success of the stored results."""
    total = claims.agg(F.count(F.lit(1))).scalar()
    done, seconds = F.col("processed"), F.col("total_duration_seconds")
    return (
        _with_chunk_totals(_result_counts(results), chunks).withColumn("total_claims", total)
        .select(
            "total_claims",
            done.alias("total_processed"),
            F.col("validation_errors").alias("total_errors"),
            seconds.alias("duration_seconds"),
            _per(done, seconds, 3600.0).alias("claims_per_hour"),
            _per(done, F.col("total_claims"), 100.0).alias("progress_percent"),
            F.greatest(F.col("total_claims") - done, F.lit(0)).alias("remaining"),
            _per(done, F.col("total_results"), 100.0).alias("success_rate"),
            _per(done, seconds).alias("throughput_per_second"),
            F.when(done > 0, seconds / (done / batch_size)).otherwise(F.lit(0.0)).alias("avg_batch_seconds"),
        )
    )


# ---------------------------------------------------------------------------
# Logs
# ---------------------------------------------------------------------------

def parse_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``ts - logger - LEVEL - message`` text as columns; keeps the other columns."""
    parts = F.split(F.col(column), " - ", 4)
    names = ["logged_at", "logger", "level", "message"]
    return lines.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def parse_log_json(lines: DataFrame, column: str = "line") -> DataFrame:
    """One JSON record per line as columns."""
    schema = "timestamp string, level string, logger string, message string, module string, function string, line int"
    return lines.withColumn("_r", F.from_json(F.col(column), schema)).select(
        *[c for c in lines.columns if c != column],
        F.col("_r.timestamp").alias("logged_at"), "_r.logger", "_r.level", "_r.message", "_r.module", "_r.function",
        F.col("_r.line").alias("line_no"),
    )


def redact_log_record(records: DataFrame, column: str = "message") -> DataFrame:
    """Mask the message of every record; every other field is kept."""
    return records.withColumn(column, mask_phi(column))


def _is_error(column: str) -> Column:
    return F.col(column).rlike("ERROR|CRITICAL")


def error_patterns(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines that mention ERROR or CRITICAL, counted by their third field."""
    return (
        lines.filter(_is_error(column))
        .groupBy(F.get(F.split(column, " - "), F.lit(2)).alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pattern")
    )


def recent_error_count(lines: DataFrame, as_of, threshold: int = 10, column: str = "line", ts: str = "ts") -> DataFrame:
    """Error lines of the last 24 hours up to ``as_of``, and whether that is below the threshold."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    recent = (F.col(ts) > as_of - F.make_dt_interval(F.lit(1))) & (F.col(ts) <= as_of)
    return lines.filter(recent & _is_error(column)).agg(F.count(F.lit(1)).alias("error_count")).withColumn(
        "healthy", F.col("error_count") < threshold
    )


# ---------------------------------------------------------------------------
# Rates and alerts
# ---------------------------------------------------------------------------

def _grid(bounds: DataFrame, step: int) -> DataFrame:
    """Every ``step`` second of the range in a one-row frame (first_at, last_at), made day by day
    so no row holds more than a day."""
    days = bounds.select(
        "first_at", "last_at",
        F.explode(F.sequence(F.floor(F.col("first_at") / DAY), F.floor(F.col("last_at") / DAY))).alias("day"),
    )
    return days.select(
        F.explode(F.sequence(
            F.greatest(F.col("first_at"), F.col("day") * DAY),
            F.least(F.col("last_at"), F.col("day") * DAY + DAY - step),
            F.lit(step).cast("long"),
        )).alias("at"),
    )


def interval_rate(results: DataFrame, seconds: int = 30, recent: int = 1000) -> DataFrame:
    """Per interval: results so far, results per second in the interval, and the mean time of the
    ``recent`` newest results at its end. Idle intervals are rows too.

    ``results`` needs created_date, result_id and processing_time.
    """
    if DAY % seconds:
        raise ValueError("seconds must divide a day")
    rows = results.select(
        "created_date", "result_id", F.coalesce(F.col("processing_time"), F.lit(0)).cast("decimal(22,6)").alias("t"),
        (F.floor(F.unix_timestamp("created_date") / seconds) * seconds).alias("at"),
    )
    totals = reuse(running_totals(
        rows, {"n": F.lit(1).cast("long"), "total": F.col("t")}, ["created_date", "result_id"],
    ).select("at", "n", "total"))
    ends = totals.groupBy("at").agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("processed"))
    grid = _grid(rows.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")), seconds)
    counts = grid.join(ends, "at", "left").select("at", F.coalesce("count", F.lit(0)).alias("count"))
    filled = running_totals(
        counts, {"processed": F.col("count")}, ["at"], bucket=F.floor(F.col("at") / DAY)
    )
    at_end = totals.select(F.col("n").alias("processed"), F.col("total").alias("upto"))
    before = totals.select((F.col("n") + recent).alias("processed"), F.col("total").alias("dropped"))
    return (
        filled.join(at_end, "processed", "left").join(before, "processed", "left")
        .select(
            F.timestamp_seconds("at").alias("interval_start"),
            "processed",
            (F.col("count") / seconds).alias("rate"),
            ((F.col("upto") - F.coalesce("dropped", F.lit(0))).cast("double")
             / F.least("processed", F.lit(recent))).alias("avg_time"),
        )
    )


def windowed_rate(events: DataFrame, minutes: int = 5, ts: str = "ts", failed: str = "failed") -> DataFrame:
    """Processed and failed events per second in the trailing ``minutes``, evaluated each minute.

    Events are folded per minute first, so a row is not copied into every window it is in. A stream is folded batch by batch
    (``rate_stream``), and its minutes are turned into windows by ``rates_of_minutes``.
    """
    return rates_of_minutes(per_minute(events, ts, failed), minutes)


def rates_of_minutes(counts: DataFrame, minutes: int = 5) -> DataFrame:
    """Trailing rates from counts per minute; a minute may have several rows."""
    return _rates(counts, minutes).select(F.timestamp_seconds("at").alias("window_end"), "processed_rate", "error_rate")


def per_minute(events: DataFrame, ts: str, failed: str) -> DataFrame:
    minute = F.floor(F.unix_timestamp(ts) / 60) * 60
    return events.groupBy(minute.alias("minute")).agg(
        F.count_if(~F.col(failed)).alias("processed"), F.count_if(F.col(failed)).alias("errors")
    )


def _rates(per_minute: DataFrame, minutes: int) -> DataFrame:
    return (
        per_minute.select(
            F.explode(F.sequence(F.col("minute") + 60, F.col("minute") + 60 * minutes, F.lit(60).cast("long"))).alias("at"),
            "processed", "errors",
        )
        .groupBy("at")
        .agg((F.sum("processed") / (60 * minutes)).alias("processed_rate"), (F.sum("errors") / (60 * minutes)).alias("error_rate"))
    )


def _firing(violations: DataFrame, minutes: int) -> DataFrame:
    """Minutes at which a violation has lasted for ``minutes``: all of the last ``minutes`` + 1
    evaluations violate. Each violation supports the minutes it can be part of, and a count
    decides, so no ordered pass over all minutes is needed."""
    supported = violations.select(
        F.explode(F.sequence(F.col("at"), F.col("at") + 60 * minutes, F.lit(60).cast("long"))).alias("at")
    )
    full = supported.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == minutes + 1)
    return full.select("at")


def alerts(
    events: DataFrame,
    ts: str = "ts",
    failed: str = "failed",
    max_error_rate: float = 0.1,
    error_minutes: int = 2,
    idle_minutes: int = 10,
    idle_for: int = 10,
) -> DataFrame:
    """(alert, severity, fired_at): every minute at which an alert fires.

    HighErrorRate: errors/s over 5 minutes above the limit for ``error_minutes``.
    ProcessingStopped: nothing processed within ``idle_minutes``, for ``idle_for`` minutes.
    Evaluations run each minute from the first to the last event.
    """
    minutes = reuse(per_minute(events, ts, failed))
    bounds = minutes.agg((F.min("minute") + 60).alias("first_at"), (F.max("minute") + 60).alias("last_at"))
    grid = _grid(bounds, 60)
    high = _rates(minutes, 5).filter(F.col("error_rate") > max_error_rate).join(grid, "at", "left_semi")
    busy = _rates(minutes, idle_minutes).filter(F.col("processed_rate") > 0)
    idle = grid.join(busy, "at", "left_anti")

    def fired(violations: DataFrame, lasting: int, name: str, severity: str) -> DataFrame:
        return _firing(violations, lasting).select(
            F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.timestamp_seconds("at").alias("fired_at")
        )

    return fired(high, error_minutes, "HighErrorRate", "warning").unionByName(
        fired(idle, idle_for, "ProcessingStopped", "critical")
    )

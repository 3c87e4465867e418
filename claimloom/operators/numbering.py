"""Running totals and row numbers over a whole table without a one-task window.

Rows are put into buckets that follow the sort order. Bucket totals (a few hundred rows)
give each bucket its start, and a window inside each bucket does the rest in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimloom.sizing import broadcast_small

SAMPLES_PER_BUCKET = 16
FAN_OUT = 32


def sort_bucket(df: DataFrame, order_by: list[str], buckets: int | None = None) -> Column:
    """Bucket number that never decreases along ``order_by`` (ascending).

    Bounds come from a fixed-size sample: the rows with the smallest key hashes, which each
    task finds alone. Any bounds give right results; good ones give even buckets.
    """
    spark = df.sparkSession
    n = buckets or min(FAN_OUT * FAN_OUT, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*order_by)
    sample = (
        keys.orderBy(F.xxhash64(*order_by), *order_by).limit(n * SAMPLES_PER_BUCKET)
        .orderBy(*order_by).collect()
    )
    picks = [sample[i * len(sample) // n] for i in range(1, n)] if len(sample) >= n else sample
    bounds = sorted_unique(picks)
    if not bounds:
        return F.lit(0)
    types = [keys.schema[c].dataType for c in order_by]

    def literal(row):
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, order_by)])

    key = F.struct(*order_by)
    groups = [bounds[i:i + FAN_OUT] for i in range(0, len(bounds), FAN_OUT)]
    heads = F.array(*[literal(g[0]) for g in groups])
    inner = F.array(*[F.array(*[literal(b) for b in g]) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= key))
    within = F.when(group > 0, F.size(F.filter(F.element_at(inner, F.greatest(group, F.lit(1))), lambda b: b <= key)))
    return group * FAN_OUT + F.coalesce(within, F.lit(0))


def sorted_unique(rows: list) -> list:
    """Drop neighbours that repeat; the input is already sorted by Spark."""
    return [r for i, r in enumerate(rows) if i == 0 or r != rows[i - 1]]


def running_totals(
    df: DataFrame,
    measures: dict[str, Column],
    order_by: list,
    group_by: list[str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` along ``order_by`` within ``group_by``.

    ``order_by`` must be unique within a group. ``bucket`` may be given when a cheap
    expression follows the order (a date, the top bits of a hash); otherwise it is sampled,
    which needs column names in ``order_by``.
    """
    group_by = group_by or []
    # Sampled bounds give a fixed number of buckets; only other keys can be many.
    few = bucket is None and not group_by
    if bucket is None:
        bucket = sort_bucket(df, order_by)
    rows = df.withColumn("_bucket", bucket)
    per_bucket = rows.groupBy(*group_by, "_bucket").agg(
        *[F.sum(expr).alias(f"_start_{name}") for name, expr in measures.items()]
    )
    before = Window.partitionBy(*group_by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        *group_by, "_bucket",
        *[F.coalesce(F.sum(f"_start_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in measures],
    )
    inside = (
        Window.partitionBy(*group_by, "_bucket").orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(F.broadcast(starts) if few else broadcast_small(starts), group_by + ["_bucket"])
        .withColumns({n: F.sum(expr).over(inside) + F.col(f"_start_{n}") for n, expr in measures.items()})
        .drop("_bucket", *[f"_start_{n}" for n in measures])
    )


def number_rows(
    df: DataFrame,
    order_by: list,
    name: str = "row_no",
    group_by: list[str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """1-based row number along ``order_by``, equal to a global ``row_number()``."""
    return running_totals(df, {name: F.lit(1)}, order_by, group_by, bucket)


def assign_chunks(df: DataFrame, size: int, key: str = "claim_id") -> DataFrame:
    """Consecutive chunks of ``size`` rows along ``key``; the last one may be short."""
    return (
        number_rows(df, [key], "_row_no")
        .withColumn("chunk_id", F.ceil(F.col("_row_no") / size).cast("int"))
        .drop("_row_no")
    )

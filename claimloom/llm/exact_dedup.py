"""Exact deduplication as a stream with keyed state on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimloom.llm.storage import Workspace, settings
from claimloom.llm.text import SPACE
from claimloom.sizing import broadcast_small

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A file stream passes over files that are so much older than the newest it has seen.
MAX_FILE_AGE = "36500d"


def normalized(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _entries(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Digest, id and content locator (file and row in it) of every row, with its normalised text."""
    return df.select(
        F.col(id_col).alias("id"), normalized(text_col).alias("norm"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("norm")))


def _first(id_col: str = "id") -> Column:
    """What state keeps of a digest: the smallest id, ids that are null last, and where its text is."""
    return F.min(F.struct(F.isnull(id_col).alias("no_id"), F.col(id_col).alias("id"), F.col("file"), F.col("row")))


def update_state(
    spark: SparkSession, path: str, schema: StructType, state: str, id_col: str = "doc_id", text_col: str = "text",
    files_per_batch: int | None = None, digest=sha256,
) -> None:
    """Take in all files below ``path`` that the state in folder ``state`` has not seen.

    The state is keyed by digest, lives in RocksDB on the executors' disks, is checkpointed to ``state`` and never
    expires: a copy is recognised however long ago the first came. Each batch appends the entries it changed, under
    its batch number, so a repeated batch overwrites itself.
    """
    # As a pattern, the path may be one file as well as a folder; a plain path to a stream has to be a folder.
    path = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    reader = spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    keyed = _entries(reader.parquet(path), id_col, text_col, digest).groupBy("digest").agg(_first().alias("first"), F.count("*").alias("n"))

    def sink(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/entries/batch={batch}")

    rocks = "spark.sql.streaming.stateStore.rocksdb"
    with settings(spark, **{
        "spark__sql__streaming__stateStore__providerClass": ROCKSDB,
        f"{rocks}.boundedMemoryUsage".replace(".", "__"): "true",
        f"{rocks}.maxMemoryUsageMB".replace(".", "__"): "200",
        f"{rocks}.changelogCheckpointing.enabled".replace(".", "__"): "true",
        # else every one of the state's partitions takes megabytes of disk before it holds anything
        f"{rocks}.allowFAllocate".replace(".", "__"): "false",
    }):
        query = (
            keyed.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, first (no_id, id, file, row) and n as they are after the last batch."""
    entry = "struct<no_id: boolean, id: bigint, file: string, row: bigint>"
    schema = f"digest string, first {entry}, n bigint, batch bigint"
    changes = spark.read.schema(schema).parquet(f"{state}/entries")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("e"))
    return last.select("digest", "e.first", "e.n")


def exact_duplicates(
    spark: SparkSession, path: str, ws: Workspace, state: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    files_per_batch: int | None = None, digest=sha256,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: id, keep_id, group_size, kept, digest.

    The stream brings the state up to date; then the full bytes of all rows of a digest are compared, and where they
    differ (a digest collision) with the row that the locator names; rows that differ from it are grouped by their bytes.
    A row whose digest the state doesn't know is an error.
    Null texts count as empty. Of equal ids the first in file order stays; a null id stays only if its group has no
    other. Rows that are repeated in full are copies like others. An empty table gives an empty result, and columns
    besides id and text are not read.
    """
    table = spark.read.parquet(path)
    state = state or f"{ws.folder}/state"
    if table.isEmpty():
        return spark.createDataFrame([], f"{id_col} bigint, keep_id bigint, group_size bigint, kept boolean, digest string")
    keep = {c: table.schema[c] for c in (id_col, text_col)}
    update_state(spark, path, StructType(list(keep.values())), state, id_col, text_col, files_per_batch, digest)
    known = ws.save(read_state(spark, state))
    entries = _entries(table, id_col, text_col, digest)
    rows = entries.drop("norm").join(known, "digest", "left")
    rows = rows.withColumn("first", F.coalesce("first", F.raise_error(F.concat(F.lit("the state has no entry for a row of "), "file"))))
    first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    # Texts travel for digests of several rows only. All are equal if the least and the greatest are, which tasks fold before they send anything.
    several = entries.join(broadcast_small(known.where("n > 1").select("digest")), "digest")
    apart = several.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest")).where("least <> greatest")
    collided = ws.save(apart.select("digest"))
    heads = several.join(collided, "digest").join(known.select("digest", "first"), "digest").where(first).select("digest", F.col("norm").alias("head"))
    other = ws.save(several.join(collided, "digest").join(heads, "digest").where("norm <> head").select("digest", "norm", "id", "file", "row"))
    plain = rows.select("id", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), first.alias("kept"), "file", "row")
    if not other.isEmpty():
        apart = other.groupBy("digest", "norm").agg(_first().alias("own"), F.count("*").alias("own_n"))
        member = other.join(apart, ["digest", "norm"]).select("file", "row", "own", "own_n")
        fewer = other.groupBy("digest").agg(F.count("*").alias("fewer"))
        own = F.col("own").isNotNull()
        plain = plain.join(member, ["file", "row"], "left").join(fewer, "digest", "left").select(
            "id", "digest", F.when(own, F.col("own.id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(own, F.col("own_n")).otherwise(F.col("group_size") - F.coalesce("fewer", F.lit(0))).alias("group_size"),
            F.when(own, (F.col("own.file") == F.col("file")) & (F.col("own.row") == F.col("row"))).otherwise(F.col("kept")).alias("kept"),
        )
    return plain.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(spark, f"{folder}/documents.parquet", Workspace(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = r"""
with n as (
  select doc_id, row_number() over () as r, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents
)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id, r) = 1 as kept, text_sha256
from n
"""

"""Near-duplicates by SimHash fingerprints, found with multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.llm.graph import components
from claimloom.llm.storage import Workspace
from claimloom.llm.text import spans, texts

BITS = 64


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words of the text with A-Z lower-cased; of all words if there are fewer."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    data, starts, ends = spans(words)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(raw, seed)], dtype=np.uint64)
    n = len(words) - width + 1
    return np.fromiter((digest(raw[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=n)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes; no words: zero."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text_col: str, width: int = 4) -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint's 64 bits as a bigint. Null and empty texts have fp 0."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def task(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "key long, fp long")


def _segments(fp: str | Column, count: int) -> list[tuple[Column, int]]:
    """The fingerprint in ``count`` runs of bits of nearly equal length, with their lengths."""
    out, at = [], 0
    for k in range(count):
        size = BITS // count + (k < BITS % count)
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1)), size))
        at += size
    return out


def _ball(value: Column, size: int, radius: int) -> Column:
    """All values of ``size`` bits that differ from ``value`` in at most ``radius`` (0 to 2) bits."""
    flips = [0]
    if radius >= 1:
        flips += [1 << i for i in range(size)]
    if radius >= 2:
        flips += [(1 << i) | (1 << j) for i in range(size) for j in range(i)]
    return F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: value.bitwiseXOR(x))


def probe_radii(segments: int, distance: int) -> list[int]:
    """How far to look in each segment so that no pair within ``distance`` is missed.

    Were every segment further away than its radius, the distances would add up to more than ``distance``:
    a + 1 segments at floor(distance / segments) + 1 each and the rest at floor(distance / segments).
    """
    each, a = divmod(distance, segments)
    return [each if k <= a else each - 1 for k in range(segments)]


def links(values: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct bigints ``values(fp)`` that differ in at most ``distance`` bits.

    One hash table per segment, keyed by (segment, value); each fingerprint looks up the ball around its own
    segments and the full distance decides in the join. A pair can come from several tables.
    """
    radii = probe_radii(segments, distance)
    parts = _segments("fp", segments)
    used = [(k, part, size, r) for (k, (part, size)), r in zip(enumerate(parts), radii) if r >= 0]
    table = values.select(
        F.col("fp").alias("b"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), part.alias("val")) for k, part, _, _ in used])).alias("s"),
    ).select("b", "s.seg", "s.val")

    def keyed(k: int, ball: Column) -> Column:
        return F.transform(ball, lambda v: F.struct(F.lit(k).alias("seg"), v.alias("val")))

    balls = [keyed(k, _ball(part, size, r)) for k, part, size, r in used]
    probes = values.select(F.col("fp").alias("a"), F.explode(F.concat(*balls)).alias("s")).select("a", "s.seg", "s.val")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(table, ["seg", "val"]).where(near).select("a", "b")


def near_duplicates(
    docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, segments: int = 3
) -> DataFrame:
    """One row per row of ``docs``: its id (bigint), ``fp`` (bigint) and ``component``, the smallest id that can be
    reached over links between fingerprints of at most ``distance`` differing bits.

    Only distinct fingerprints are compared, so copies add no pairs. Null and empty texts have fingerprint zero and
    link like others; a null id counts in no minimum, and the component is null where all its ids are; an empty
    table gives an empty result. Further columns of ``docs`` are not read.

    More ``segments`` mean fewer look-ups but fuller buckets; two suit billions of fingerprints.
    """
    rows = ws.save(fingerprints(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col, width))
    least = ws.save(rows.groupBy("fp").agg(F.min("key").alias("least")))
    groups = components(links(least.select("fp"), distance, segments), ws)
    labelled = least.join(groups, least.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component"))
    by_fp = labelled.join(smallest, "label").select("fp", "component")
    return rows.join(by_fp, "fp").select(F.col("key").alias(id_col), "fp", "component")


def op4(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = near_duplicates(docs, Workspace(spark))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

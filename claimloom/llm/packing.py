"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.llm.storage import Workspace, unused, with_row_key
from claimloom.llm.text import WORD

LENGTHS = (256, 512, 1024, 2048)
# Cost of a sequence of c tokens: a fixed share, its tokens, and attention that grows with their square.
FIXED, SQUARE = 48.0, 1 / 8192
# Tokens packed by one task at a time; a piece counts as some tokens more, so that very many short ones are bounded too.
SHARD_TOKENS, PIECE_TOKENS = 2_000_000, 16


def cost(c: float) -> float:
    return FIXED + c + SQUARE * c * c


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin.

    Pieces go from the largest down into the open bin that they leave least room in. If none has room, a bin is opened in
    the permitted length that costs least per token it can expect to hold: the piece, and as much of the smaller pieces
    still to come as fits beside it. At the end each bin shrinks to the shortest permitted length for what it holds.
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = np.array([sizes[i] for i in order], dtype=np.int64)
    left_after = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]])
    rising = -falling
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    used: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            def per_token(c: int) -> float:
                rest = c - size
                to_come = left_after[max(k + 1, int(np.searchsorted(rising, -rest)))]
                return cost(c) / max(1, min(c, size + int(to_come)))

            free = min((c for c in lengths if c >= size), key=per_token)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [next(c for c in lengths if c >= n) for n in used]


def pieces_of(docs: DataFrame, tokens, key: str, keep: list, longest: int) -> DataFrame:
    """One row per run of at most ``longest`` tokens of a row: piece, start, n_tokens. No tokens: one row of none."""
    lengths = docs.select(F.col(key).alias("_row"), *keep, tokens.cast("bigint").alias("_total"))
    last = F.greatest(F.ceil(F.col("_total") / longest) - 1, F.lit(0))
    cut = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return cut.withColumn("start", F.col("piece") * longest).withColumn("n_tokens", F.least(F.lit(longest), F.col("_total") - F.col("start"))).drop("_total")


def pack_documents(
    docs: DataFrame, ws: Workspace, id_col: str = "doc_id", tokens=None, text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per piece of a document: id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    ``tokens`` is the number of tokens of a row, by default its words between white space. Rows longer than the longest of
    ``lengths`` are cut into pieces of that length and a rest; none is dropped. Rows without tokens (null and empty texts)
    come out with one piece of none and no bin. Rows with equal or null ids are rows of their own. Pieces are dealt by a hash
    of the row's number to shards of about ``shard_tokens``, whose number follows the total; each is packed by itself, so a
    shard wastes at most its own last bins. An empty table gives an empty result. Columns besides id and text are not read.
    """
    key = unused("row", docs)
    rows, _ = with_row_key(docs.select(id_col, text_col), id_col, ws, key)
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)) if tokens is None else tokens
    pieces = ws.save(pieces_of(rows, tokens, key, [F.col(id_col).alias("_id")], max(lengths)))
    total = pieces.where("n_tokens > 0").agg(F.sum(F.col("n_tokens") + PIECE_TOKENS)).first()[0] or 0
    shards = -(-int(total) // shard_tokens) or 1
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "piece"], kind="stable")
        bins, offsets, caps = pack(pdf["n_tokens"].tolist(), lengths)
        return pd.DataFrame({
            "_id": pdf["_id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "start": pdf["start"].to_numpy(), "n_tokens": pdf["n_tokens"].to_numpy(),
            "bin_id": pdf["shard"].to_numpy(np.int64) * (1 << 24) + np.array(bins, np.int64), "bin_offset": np.array(offsets, np.int64), "bin_capacity": np.array([caps[b] for b in bins], np.int64),
        })

    packed = dealt.select("_row", F.col("_id").cast("string").alias("_id"), "piece", "start", "n_tokens", "shard").groupBy("shard").applyInPandas(
        task, "_id string, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_capacity long")
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens <= 0").select(F.col("_id").cast("string").alias("_id"), "piece", "start", "n_tokens", none.alias("bin_id"), none.alias("bin_offset"), none.alias("bin_capacity"))
    return packed.unionByName(empty).select(F.col("_id").cast(id_type).alias(id_col), "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), Workspace(spark))

"""Substring deduplication with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimloom.llm.storage import Workspace, others, unused, with_row_key
from claimloom.llm.text import Buffer, split_mix, texts

# Period and residues of a difference cover: every difference modulo the period is one of two residues.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
# Words that are hashed together; a longer document is a group of its own.
GROUP = 1 << 16


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit halves (2 x n) of each word's XXH3."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2).T


def run_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` symbols: two runs half as long are mixed into one, and so on, so that no sum or product of
    symbols of one run can make up for a change in another."""
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return split_mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03)))

    level, size, out, done = symbols, 1, None, 0
    while True:
        if width & size:  # the runs of lower bits of the width come last
            out, done = (level, size) if out is None else (joined(level[: max(0, len(out) - size)], out[size:]), done + size)
        size *= 2
        if size > width:
            return out[: max(0, len(symbols) - width + 1)]
        level = joined(level[: -(size // 2)], level[size // 2 :]) if len(level) > size // 2 else level[:0]


def anchor_width(window: int) -> int:
    """Two equal windows share an anchor at the same offset below the period; it lies within both if this wide."""
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"windows of fewer than {PERIOD} words are not covered")
    return width


def candidate_starts(positions: np.ndarray, words: int, window: int) -> np.ndarray:
    """Starts of all windows that hold one of the anchors at ``positions`` whole and no more than a period in."""
    steps = np.zeros(words + 1, dtype=np.int32)
    np.add.at(steps, np.maximum(positions - PERIOD + 1, 0), 1)
    np.add.at(steps, positions + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps[:words]) > 0)
    return starts[starts <= words - window]


def _grouped(batch: pa.RecordBatch):
    """Lists of (row in the batch, words) of about GROUP words together."""
    group, size = [], 0
    for k, text in enumerate(texts(batch.column(1))):
        words = (text or b"").split()
        if size + len(words) > GROUP and group:
            yield group
            group, size = [], 0
        group.append((k, words))
        size += len(words)
    if group:
        yield group


def _positions(group: list[tuple[int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a group: hashes, row in the batch, position in the document, and how many words are left there."""
    sizes = np.array([len(w) for _, w in group])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return word_hashes([w for _, words in group for w in words]), np.repeat([k for k, _ in group], sizes), place, np.repeat(sizes, sizes) - place


def _anchor_rows(docs: DataFrame, window: int, with_place: bool) -> DataFrame:
    """Hashes of the words from every position in the cover modulo the period, in documents of a window or more."""
    fields = [("h", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())][: 3 if with_place else 1]
    schema, width = pa.schema(fields), anchor_width(window)

    def task(batches):
        out = Buffer(schema)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for group in _grouped(batch):
                hashes, k, place, left = _positions(group)
                here = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= width) & (place + left >= window))
                if len(here):
                    values = run_hashes(hashes[0], width)[here].view(np.int64)
                    yield from out.add(*(values, rows[k[here]], place[here])[: len(fields)])
        yield from out.flush()

    return docs.mapInArrow(task, "h long, row long, pos int" if with_place else "h long")


def _window_rows(docs: DataFrame, window: int, with_place: bool) -> DataFrame:
    """Two hashes (64 and 32 bits) of every candidate window of ``docs(row, text, at)``."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("row", pa.int64()), ("pos", pa.int32())][: 4 if with_place else 2])

    def task(batches):
        out = Buffer(schema)
        for batch in batches:
            rows, places = batch.column(0).to_numpy(), batch.column(2)
            for group in _grouped(batch):
                hashes, k, place, _ = _positions(group)
                begun, wanted = 0, []
                for row, words in group:
                    wanted.append(begun + candidate_starts(places[row].values.to_numpy(), len(words), window))
                    begun += len(words)
                starts = np.concatenate(wanted)
                if len(starts):
                    h = run_hashes(hashes[0], window)[starts].view(np.int64)
                    g = (run_hashes(hashes[1], window)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield from out.add(*(h, g, rows[k[starts]], place[starts])[: len(schema)])
        yield from out.flush()

    return docs.mapInArrow(task, "h long, g int, row long, pos int" if with_place else "h long, g int")


def repeated_windows(docs: DataFrame, ws: Workspace, window: int = 35, keep_first: bool = False) -> DataFrame:
    """(row, starts, firsts): for each row of ``docs(row, text)`` with some, the starts of windows that also start elsewhere. With
    ``keep_first`` those of the smallest row, and in it position, of each group are ``firsts`` instead; otherwise ``firsts`` is empty.

    Anchors that occur once cannot lie in a repeated window. Those that occur again mark the windows around them as
    candidates (the extension to full length), which are hashed whole and counted in turn. Counting aggregates
    before the shuffle and places meet counts in a join whose hot keys Spark splits, so no group is ever gathered.
    Windows are equal if 96 bits of hash are: they come from 128 bits per word, mixed pairwise without any sum over a window.
    """
    again = ws.save(_anchor_rows(docs, window, False).groupBy("h").count().where("count > 1").select("h"))
    shared = _anchor_rows(docs, window, True).join(again, "h", "left_semi").groupBy("row").agg(F.collect_list("pos").alias("at"))
    shared = ws.save(shared)
    ws.drop(again)
    around = docs.join(shared, "row").select("row", "text", "at")
    if keep_first:
        groups = _window_rows(around, window, True).groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1")
        twice = ws.save(groups.select("h", "g", "first"))
        first = F.struct("row", "pos") == F.col("first")
        places = _window_rows(around, window, True).join(twice, ["h", "g"])
    else:
        twice = ws.save(_window_rows(around, window, False).groupBy("h", "g").count().where("count > 1").select("h", "g"))
        first = F.lit(False)
        places = _window_rows(around, window, True).join(twice, ["h", "g"], "left_semi")
    starts = lambda which: F.collect_list(F.when(which, F.col("pos")))
    found = ws.save(places.groupBy("row").agg(starts(~first).alias("starts"), starts(first).alias("firsts")))
    ws.drop(shared, twice)
    return found


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_first: bool = False,
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text"),
) -> DataFrame:
    """``docs`` with columns n_words, n_removed and kept_text: the text without any word of a window of ``window`` words
    whose word sequence also starts elsewhere, in the same or another row; windows are judged on the input. With ``keep_first`` the
    words of each group's first window, that of the smallest row and position, stay whatever other windows they are in.

    Kept words are joined by one space. Null and empty texts have no words and an empty kept_text. Rows repeated in
    full, or with equal or null ids, are rows of their own, so their windows repeat. Columns of ``docs`` named like the
    three new ones (``names``), in any case, are replaced; an empty table gives an empty result.
    """
    key = unused("row", docs)
    rows, _ = with_row_key(docs, id_col, ws, key)
    found = repeated_windows(rows.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), ws, window, keep_first)
    rest = others(docs, names)
    joined = rows.join(found, rows[key] == found["row"], "left")
    joined = joined.select(*[rows[c] for c in rest], rows[text_col].cast("string").alias(unused("_text", docs)), found["starts"].alias(unused("_starts", docs)), found["firsts"].alias(unused("_firsts", docs)))

    def task(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            starts, firsts = batch.column(len(rest) + 1), batch.column(len(rest) + 2)
            for k, text in enumerate(texts(batch.column(len(rest)))):
                words = left = (text or b"").split()
                if starts[k].is_valid and len(starts[k].values):
                    gone = _covered(len(words), starts[k].values.to_numpy(), window) & ~_covered(len(words), firsts[k].values.to_numpy(), window)
                    left = [words[i] for i in np.flatnonzero(~gone)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            arrays = [batch.column(i) for i in range(len(rest))] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *names])

    schema = StructType(joined.schema.fields[: len(rest)] + [StructField(names[0], LongType()), StructField(names[1], LongType()), StructField(names[2], StringType())])
    return joined.mapInArrow(task, schema)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, Workspace(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select r, i, array_to_string(w[i:i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35)
), hits as (
  select r, i from (select r, i, count(*) over (partition by s) as n from starts) where n > 1
), words as (
  select r, i, w[i] as word from (select r, w, unnest(range(1, len(w) + 1)) as i from docs)
), covered as (
  select distinct r, i + d as i from hits, range(0, 35) t(d)
), kept as (
  select r, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join covered using (r, i) group by r
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (r)
"""

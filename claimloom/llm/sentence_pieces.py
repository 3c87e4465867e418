"""Encoding and decoding with a SentencePiece model over a relational lattice of its distinct words."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from claimloom.llm.storage import Workspace, others, settings, unused, with_row_key
from claimloom.llm.text import texts

BAR = "▁"
WORDS = re.compile(f"{BAR}*[^{BAR}]+|{BAR}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Units of up to this many characters, whose boundaries fit the bits of a bigint, are folded in Spark; the few longer ones merge
# with a heap, to the same result.
LONGEST_UNIT = 62
# Units whose lattice one task builds; their rows are small before they are exploded, so Spark would join too many tasks into one.
# The edges of so many units fit in a task's memory, so they are grouped there without the sort that Spark turns to beyond 128 keys.
UNITS_PER_TASK = 10_000
IN_MEMORY = {"spark__sql__objectHashAggregate__sortBased__fallbackThreshold": str(4 * UNITS_PER_TASK)}
# So many of the most frequent units travel to every task; all others come by a join.
FREQUENT = 150_000
# Words that a task remembers, and words that it counts before it hands counts on.
REMEMBERED = 60_000
COUNTED = 150_000


@dataclass
class Pieces:
    """The piece table: ids and scores of ordinary pieces, the id of byte 0, of the unknown piece, and all strings by id."""

    table: dict[str, tuple[int, float]]
    byte0: int | None
    unknown: int
    strings: list[str]
    is_bpe: bool = True

    @property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    def pairs(self) -> set[str]:
        """Neighbouring characters inside any piece; text may be cut safely between any others."""
        return {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}


def load_model(path: str, is_bpe: bool = True) -> Pieces:
    """Read a model file; of byte pieces, only a full run from <0x00> on is used."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    strings = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    plain = {s: (i, m.get_score(i)) for i, s in enumerate(strings) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    byte0 = next((i for i in range(len(strings)) if m.is_byte(i)), None)
    return Pieces(plain, byte0, m.unk_id(), strings, is_bpe)


def cut(word: str, pairs: set[str]) -> list[str]:
    """The word cut wherever no piece reaches across."""
    ends = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in pairs]
    return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)])] if ends else [word]


def words_of(text: str) -> list[str]:
    """The words of a text in order: a space is a bar, one bar is put in front, words begin with their bars."""
    if not text:
        return []
    if BAR in text or "  " in text or text[0] == " " or text[-1] == " ":
        return WORDS.findall(BAR + text.replace(" ", BAR))
    return (BAR + text.replace(" ", " " + BAR)).split(" ")


def merge_with_heap(unit: str, table: dict[str, tuple[int, float]]) -> list[str]:
    """Pieces of a unit by merging the best-scored neighbours, leftmost first of equals."""
    parts: list[str | None] = list(unit)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if j < len(parts):
            both = parts[i] + parts[j]
            if both in table:
                heapq.heappush(heap, (-table[both][1], i, j, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [p for p in parts if p is not None]


def ids_of_parts(parts: list[str], pieces: Pieces) -> list[int]:
    out: list[int] = []
    for p in parts:
        if p in pieces.table:
            out.append(pieces.table[p][0])
        elif pieces.byte0 is None:
            out.append(pieces.unknown)
        else:
            out += [pieces.byte0 + b for b in p.encode("utf-8")]
    return out


def count_units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n) over all texts of ``docs(text)``, counted within each batch before the shuffle."""
    pairs, schema = pieces.pairs(), pa.schema([("unit", pa.string()), ("n", pa.int64())])

    def out(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def cut_up(words: Counter) -> pa.RecordBatch:
        counts: dict[str, int] = {}
        for word, n in words.items():
            for unit in cut(word, pairs):
                counts[unit] = counts.get(unit, 0) + n
        return out(counts)

    def task(batches):
        words: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                words.update(words_of((text or b"").decode("utf-8", "replace")))
                if len(words) > COUNTED:
                    yield cut_up(words)
                    words = Counter()
        if words:
            yield cut_up(words)

    return docs.select("text").mapInArrow(task, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edges): for each unit its pieces as (cost, s, l, id, ends, inner), cheapest and then leftmost first. An edge starts
    at character s (from 1) and is l characters long; cost is the negative score. Bit i of ``ends`` and ``inner`` stands for the
    boundary behind character i: those at both ends of the edge, and those within it. Every single character has an edge, with a
    null id where it is no piece.

    Substrings of at most the longest piece's length meet the piece table in an equi-join. The table is as large as the
    model's vocabulary, whatever the data, and is broadcast; units are dealt out once, and their edges are grouped where
    they were made.
    """
    spark = units.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    table = F.broadcast(table) if len(pieces.table) <= 1_000_000 else table
    tasks = math.ceil(max(units.count(), 1) / UNITS_PER_TASK)
    starts = units.select("unit").repartition(tasks, "unit").select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("unit") - F.col("s") + 1))
    parts = starts.select("unit", "s", F.explode(lengths).alias("l")).select("unit", "s", "l", F.substring("unit", F.col("s"), F.col("l")).alias("piece"))
    bit = lambda at: f"shiftleft(1L, {at})"
    edge = F.struct(
        (-F.col("score")).alias("cost"), "s", "l", "id",
        F.expr(f"{bit('s - 1')} | {bit('s + l - 1')}").alias("ends"), F.expr(f"{bit('s + l - 1')} - {bit('s')}").alias("inner"))
    edges = parts.join(table, "piece", "left").where("id IS NOT NULL OR l = 1")
    return edges.select("unit", edge.alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _all_ends() -> Column:
    """The boundaries of a unit cut into characters."""
    return F.expr("shiftleft(1L, length(unit) + 1) - 1")


def fold_merges() -> Column:
    """Boundaries (a bit each) that are left after as many merges as the unit allows: an aggregate whose step takes the first
    of the sorted edges that spans exactly two symbols, and removes the boundary between them."""
    zero = F.lit(0).cast("bigint")
    longer = F.transform(F.filter("edges", lambda e: e["l"] > 1), lambda e: F.struct(e["ends"].alias("ends"), e["inner"].alias("inner")))

    def step(acc: Column, _: Column) -> Column:
        """The edges that no merge can use any more go, so that the next step looks at few."""
        left = acc["left"]
        usable = F.filter(acc["open"], lambda e: (left.bitwiseAND(e["ends"]) == e["ends"]) & (left.bitwiseAND(e["inner"]) != zero))
        best = lambda o: F.get(F.filter(o, lambda e: F.bit_count(left.bitwiseAND(e["inner"])) == 1), F.lit(0))["inner"]
        merged = lambda o: F.struct(left.bitwiseAND(F.bitwise_not(F.coalesce(best(o), zero))).alias("left"), o.alias("open"))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(F.get(F.transform(F.array(usable), merged), F.lit(0)))

    merges = F.sequence(F.lit(2), F.greatest(F.length("unit"), F.lit(2)))
    return F.aggregate(merges, F.struct(_all_ends().alias("left"), longer.alias("open")), step, lambda acc: acc["left"])


def fold_best_path(unknown_score: float) -> Column:
    """Boundaries of the path with the highest sum of scores (Viterbi): an aggregate over end positions whose state holds the
    best score and last length of every prefix. A character without a piece costs ``unknown_score``; of equal paths the one
    with the longer last piece wins."""
    n = F.length("unit")
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("l")))

    def step(acc: Column, end: Column) -> Column:
        def arrive(e: Column) -> Column:
            return F.struct((F.element_at(acc, e["s"])["score"] + F.coalesce(-e["cost"], F.lit(unknown_score))).alias("score"), e["l"].alias("l"))

        return F.concat(acc, F.array(F.array_max(F.transform(F.filter("edges", lambda e: e["s"] + e["l"] - 1 == end), arrive))))

    def back(left: Column, behind: Column) -> Column:
        """Walks from the end: the lowest boundary found so far, and on through its last piece."""
        at = left["at"]
        arrived = at - F.element_at("best", at + 1)["l"]
        on = F.struct(arrived.alias("at"), left["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), arrived)).alias("mask"))
        return F.when(at == 0, left).otherwise(on)

    best = F.aggregate(F.sequence(F.lit(1), n), begin, step)
    end = F.struct(n.alias("at"), F.expr("shiftleft(1L, length(unit))").alias("mask"))
    return best, lambda: F.aggregate(F.sequence(F.lit(1), n), end, back)["mask"]


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of units of at most LONGEST_UNIT characters, by the fold that the model's kind asks for."""
    edges = lattice(units, pieces)
    if pieces.is_bpe:
        folded = edges.select("unit", "edges", fold_merges().alias("left"))
    else:
        scores = [s for _, s in pieces.table.values()]
        best, walk = fold_best_path(min(scores, default=0.0) - 10.0)
        folded = edges.select("unit", "edges", best.alias("best")).select("unit", "edges", walk().alias("left"))

    def ids(x: Column) -> Column:
        code = F.hex(F.encode(F.substring("unit", x["s"], x["l"]), "UTF-8"))
        if pieces.byte0 is None:
            rest = F.array(F.lit(pieces.unknown))
        else:
            rest = F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda k: F.conv(F.substring(code, k * 2 - 1, 2), 16, 10).cast("int") + pieces.byte0)
        return F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(rest)

    left = F.col("left")
    symbols = F.filter("edges", lambda e: (left.bitwiseAND(e["ends"]) == e["ends"]) & (left.bitwiseAND(e["inner"]) == 0))
    symbols = F.sort_array(F.transform(symbols, lambda e: F.struct(e["s"].alias("s"), e["l"].alias("l"), e["id"].alias("id"))))
    return folded.select("unit", F.flatten(F.transform(symbols, ids)).alias("ids"))


def encode(docs: DataFrame, pieces: Pieces, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", ids_name: str = "ids", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with the ids of each whole text.

    Spaces become bars and one bar is put in front, as models with an unchanged alphabet do; texts are cut where no piece
    can reach, and each distinct unit is encoded once. The ``frequent`` commonest units go to every task; the others come to
    their rows by a join, by unit and then by row, as ids in the order in which the text first has these units. Null and empty texts have no ids. Repeated rows, and rows with equal or null ids,
    are rows of their own; an empty table gives an empty result. A column named like the ids is replaced.
    """
    key = unused("row", docs)
    rows, _ = with_row_key(docs, id_col, ws, key)
    plain = rows.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text"))
    counted = ws.save(count_units(plain, pieces))
    with settings(docs.sparkSession, **IN_MEMORY):
        coded = ws.save(encode_units(counted.where(F.length("unit") <= LONGEST_UNIT), pieces))
    common = counted.where(F.length("unit") <= LONGEST_UNIT).orderBy(F.desc("n"), "unit").limit(frequent).join(coded, "unit").select("unit", "ids").toPandas()
    # plain containers: the classes of this package are not known where a broadcast is read
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(common["unit"], [np.asarray(x, "<i4").tobytes() for x in common["ids"]])))
    pairs = pieces.pairs()

    def rare(batches):
        table, easy = known.value, set()
        schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("unit", pa.string())])
        for batch in batches:
            at, order, found = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                new: dict[str, None] = {}
                for word in dict.fromkeys(words_of((text or b"").decode("utf-8", "replace"))):
                    if word in table or word in easy:
                        continue
                    seldom = [u for u in cut(word, pairs) if u not in table]
                    new.update((u, None) for u in seldom if len(u) <= LONGEST_UNIT)
                    if not seldom and len(easy) < REMEMBERED:
                        easy.add(word)
                at += [row] * len(new)
                order += range(len(new))
                found += new
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(order, pa.int32()), pa.array(found, pa.string())], schema=schema)

    seldom = plain.mapInArrow(rare, "row long, k int, unit string").join(coded, "unit").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("more"))
    # flat, as an array in an array takes some 24 bytes more in a shuffle
    seldom = ws.save(seldom.select("row", F.flatten("more.ids").alias("more"), F.transform("more.ids", lambda x: F.size(x).cast("smallint")).alias("sizes")))
    ws.drop(counted, coded)
    rest = others(docs, (ids_name,))
    joined = rows.join(seldom, rows[key] == seldom["row"], "left").select(
        *[rows[c] for c in rest], rows[text_col].cast("string").alias(unused("_text", docs)), seldom["more"].alias(unused("_more", docs)), seldom["sizes"].alias(unused("_sizes", docs)))
    model = (pieces.table, pieces.byte0, pieces.unknown)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        codes, (table, byte0, unknown) = known.value, model.value
        own, remembered = Pieces(table, byte0, unknown, []), dict(codes)
        most = len(codes) + REMEMBERED

        def code(word: str, extra: dict[str, bytes], more: list[bytes]) -> bytes:
            out, common_only = b"", True
            for u in cut(word, pairs):
                if u in codes:
                    out += codes[u]
                    continue
                common_only = False
                if len(u) > LONGEST_UNIT:
                    out += np.asarray(ids_of_parts(merge_with_heap(u, table), own), "<i4").tobytes()
                    continue
                if u not in extra:
                    extra[u] = more[len(extra)]
                out += extra[u]
            if common_only and len(remembered) < most:
                remembered[word] = out
            return out

        for batch in batches:
            more, sizes = batch.column(len(rest) + 1), batch.column(len(rest) + 2)
            rows = sizes.offsets.to_pylist()
            units = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False), dtype=np.int64) * 4]).tolist()
            raw = more.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            lists = []
            for k, text in enumerate(texts(batch.column(len(rest)))):
                extra, own_codes = {}, [raw[units[j] : units[j + 1]] for j in range(rows[k], rows[k + 1])]
                words = words_of((text or b"").decode("utf-8", "replace"))
                lists.append(b"".join([remembered[w] if w in remembered else code(w, extra, own_codes) for w in words]))
                if len(extra) != len(own_codes):
                    raise ValueError(f"a text has {len(extra)} rare units, {len(own_codes)} were encoded")
            ends = np.cumsum([0, *map(len, lists)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(lists), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [ids], names=[*rest, ids_name])

    return joined.mapInArrow(task, StructType(joined.schema.fields[: len(rest)] + [StructField(ids_name, ArrayType(IntegerType()))]))


def decode_ids(ids, strings: list[str], byte0: int | None) -> str:
    """Pieces joined, runs of byte pieces read as UTF-8, bars as spaces, without the first space."""
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if byte0 is not None and byte0 <= i < byte0 + 256:
            raw.append(i - byte0)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        out.append(strings[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(BAR, " ")
    return text[1:] if text.startswith(" ") else text


def decode_lists(lists: pa.Array, strings: list[str], byte0: int | None) -> pa.Array:
    """``decode_ids`` of each list, for all of them at once. The joined bytes are valid if each run of byte pieces is, as no character goes
    on from a run into the next piece; lists with other runs are decoded one by one."""
    if not len(lists):
        return pa.array([], pa.string())
    plain = [bytes([i - byte0]) if byte0 is not None and byte0 <= i < byte0 + 256 else x.encode() for i, x in enumerate(strings)]
    first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
    parts = pa.array(plain, pa.large_binary()).take(lists.values.slice(first, last - first))
    joined = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(lists.offsets, first), parts), pa.scalar(b"", pa.large_binary()))
    try:
        text = pc.replace_substring(joined.cast(pa.large_string()), BAR, " ")
    except pa.ArrowInvalid:
        return pa.array([decode_ids(x.values.to_numpy().tolist() if x.is_valid else [], strings, byte0) for x in lists], pa.string())
    return pc.replace_substring_regex(text, r"\A ", "").cast(pa.string())


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", text_name: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null and empty ids are an empty text. A column named like the text, in any case, is
    replaced; repeated rows stay, and an empty table gives an empty result."""
    rest = others(df, (text_name,))
    model = df.sparkSession.sparkContext.broadcast((pieces.strings, pieces.byte0))
    plain = df.select(*rest, F.col(ids_col).alias(unused("_ids", df)))

    def task(batches):
        strings, byte0 = model.value
        for batch in batches:
            found = decode_lists(batch.column(len(rest)), strings, byte0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [found], names=[*rest, text_name])

    return plain.mapInArrow(task, StructType(plain.schema.fields[: len(rest)] + [StructField(text_name, StringType())]))


def op7(spark: SparkSession, folder: str, model: str = MODEL) -> DataFrame:
    """Per document the number of tokens, a digest of the ids, and whether decoding gives the text back (with bars as spaces)."""
    pieces = load_model(model)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs, pieces, Workspace(spark)), pieces)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BAR), F.lit(" "))).alias("round_trip"),
    )

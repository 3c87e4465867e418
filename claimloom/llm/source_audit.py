"""How far the vocabularies of sources lie apart: frequent terms, a recount over minimal perfect hashes, and divergences in exact integers."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimloom.llm.storage import Workspace
from claimloom.llm.text import split_mix, texts
from claimloom.sizing import broadcast_small

# In UTF-8 every byte of a code point above 7F is above 7F as well, so bytes match as code points do.
TERM = re.compile(rb"[a-z\x80-\xff]+")
# Keys of one perfect hash; bytes of all hashes with their keys up to which they are broadcast; counters and slots that a task holds.
SHARD_KEYS, BROADCAST_BYTES = 20_000, 48 << 20
HELD_TERMS, HELD_SLOTS, HELD_CELLS, HELD_SOURCES = 300_000, 6_000_000, 2_000_000, 1_024
SCALE_STEPS = 3  # three steps of 1,000: parts per 1,000,000,000


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text with A-Z lower-cased, in lists of bounded length."""
    text = (text or b"").lower()  # of bytes: ASCII letters only
    if len(text) < 1 << 20:
        yield TERM.findall(text)
    else:
        yield from map(list, batched((m.group() for m in TERM.finditer(text)), 100_000))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit hashes: levels of bits, each twice as long as the hashes left for it.

    A hash takes its place in a level if no other wants it; the others go on to the next level. Its number is the count of
    bits before its own. Any other hash may get a number as well, so a caller has to compare the stored key.
    """

    def __init__(self, hashes: np.ndarray):
        self.levels, words, at = [], [], 0
        left = hashes
        while len(left):
            size = (2 * len(left) + 63) // 64 * 64
            place = (split_mix(left + np.uint64(len(self.levels) * 0x9E3779B9)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[place[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            self.levels.append((at, size))
            at, left = at + size, left[~alone]
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1 where no level has its bit."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        for k, (at, size) in enumerate(self.levels):
            place = at + (split_mix(hashes[todo] + np.uint64(k * 0x9E3779B9)) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.before[place >> 6] + np.bitwise_count(under))[hit]
            todo = todo[~hit]
        return out


class Shard:
    """A perfect hash with its keys in the order of their numbers. Keys whose 64-bit hashes are equal are kept beside it."""

    def __init__(self, keys: list[bytes]):
        hashes = hash_terms(keys)
        _, first = np.unique(hashes, return_index=True)
        alone = np.zeros(len(keys), dtype=bool)
        alone[first] = True
        self.hash = PerfectHash(hashes[alone])
        numbers = np.full(len(keys), -1, dtype=np.int64)
        numbers[alone] = self.hash.find(hashes[alone])
        rest = np.flatnonzero(~alone)
        numbers[rest] = np.arange(len(first), len(keys))
        self.beside = {keys[i]: int(numbers[i]) for i in rest}
        order = np.argsort(numbers)
        self.blob = b"".join(keys[i] for i in order)
        self.ends = np.cumsum([0, *(len(keys[i]) for i in order)]).astype(np.int32)

    def pack(self) -> bytes:
        return pickle.dumps((self.hash.levels, self.hash.words, self.hash.before, self.beside, self.blob, self.ends))

    @classmethod
    def unpack(cls, packed: bytes | None) -> Shard:
        out = cls([])
        if packed:
            out.hash.levels, out.hash.words, out.hash.before, out.beside, out.blob, out.ends = pickle.loads(packed)
        return out

    def __len__(self) -> int:
        return len(self.ends) - 1

    def keys(self) -> list[bytes]:
        return [self.blob[a:b] for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist())]

    def find(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 if it is none of this shard's: the stored key decides."""
        out = self.hash.find(hashes)
        known = np.flatnonzero(out >= 0)
        blob, starts, ends = self.blob, self.ends[out[known]].tolist(), self.ends[out[known] + 1].tolist()
        for i, a, b in zip(known.tolist(), starts, ends):
            if blob[a:b] != keys[i]:
                out[i] = self.beside.get(keys[i], -1)
        return out


def hash_terms(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class Vocabulary:
    """The shards of one language: slots 0 to V - 1 over all of them."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.base = np.cumsum([0, *map(len, shards)])

    def __len__(self) -> int:
        return int(self.base[-1])

    def find(self, keys: list[bytes]) -> np.ndarray:
        hashes = hash_terms(keys)
        shard, out = shard_of(hashes, len(self.shards)), np.full(len(keys), -1, dtype=np.int64)
        for k, own in enumerate(self.shards):
            at = np.flatnonzero(shard == k)
            found = own.find([keys[i] for i in at.tolist()], hashes[at])
            out[at] = np.where(found >= 0, found + self.base[k], -1)
        return out

    def place(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and number of each slot."""
        shard = np.searchsorted(self.base, slots, side="right") - 1
        return shard, slots - self.base[shard]


def _spread(batches: Iterator[pa.RecordBatch]):
    """(lang, term, shards of the language) with the term's shard."""
    for batch in batches:
        keys = list(texts(batch.column(1)))
        hashes = hash_terms(keys)
        shards = np.asarray(batch.column(2))
        shard = (hashes >> np.uint64(32)) % shards.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], ["lang", "term", "shards", "shard"])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    shard = Shard([t.encode() for t in rows["term"]])
    return rows[:1][["lang", "shards", "shard"]].assign(keys=[[k.decode() for k in shard.keys()]], packed=[shard.pack()])


def _document_counts(batches: Iterator[pa.RecordBatch]):
    """(lang, text) rows become (lang, term, n documents), summed within the task as far as memory goes."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            own = held.setdefault(lang, Counter())
            seen: set[bytes] = set()
            for part in terms_of(text):
                seen.update(part)
            own.update(seen)
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from rows()
    yield from rows()


def _count_by_group(batches: Iterator[pa.RecordBatch], put) -> Iterator[pa.RecordBatch]:
    """Feeds ``put(held)`` with terms counted over many documents, by language and source; ``put`` yields batches."""
    held: dict[tuple[str, str], Counter] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            own = held.setdefault((lang, source), Counter())
            size -= len(own)
            for part in terms_of(text):
                own.update(part)
            size += len(own)
            if size > HELD_TERMS:
                yield from put(held)
                held, size = {}, 0
    yield from put(held)


def _recount(shared):
    """(lang, source, text) rows become (lang, source, shard, slot, n): counts in dense slots, one array per group, found by perfect hashes."""

    def task(batches: Iterator[pa.RecordBatch]):
        vocabularies = {lang: Vocabulary([Shard.unpack(x) for x in shards]) for lang, shards in shared.value.items()}
        slots: dict[tuple[str, str], np.ndarray] = {}

        def rows():
            for (lang, source), counts in slots.items():
                used = np.flatnonzero(counts)
                shard, number = vocabularies[lang].place(used)
                n = len(used)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(shard.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(counts[used])], ["lang", "source", "shard", "slot", "n"])
            slots.clear()

        def put(held: dict[tuple[str, str], Counter]):
            for lang in {a for a, _ in held} & vocabularies.keys():
                known, groups = vocabularies[lang], {b: counts for (a, b), counts in held.items() if a == lang}
                terms = list(set().union(*groups.values()))  # looked up once, whatever the number of sources
                at = dict(zip(terms, known.find(terms).tolist()))
                for source, counts in groups.items():
                    if (lang, source) not in slots:
                        if sum(map(len, slots.values())) + len(known) > HELD_SLOTS:
                            yield from rows()
                        slots[lang, source] = np.zeros(len(known), dtype=np.int64)
                    found = np.fromiter(map(at.__getitem__, counts), dtype=np.int64, count=len(counts))
                    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                    slots[lang, source][found[found >= 0]] += n[found >= 0]

        yield from _count_by_group(batches, put)
        yield from rows()

    return task


def _plain_counts(batches: Iterator[pa.RecordBatch]):
    def put(held: dict[tuple[str, str], Counter]):
        for (lang, source), counts in held.items():
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "source", "term", "n"])

    yield from _count_by_group(batches, put)


def parts_per_billion(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), with no number above 1,000 x total on the way."""
    left, out = count + 2, 0
    for _ in range(SCALE_STEPS):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


FOUND = "lang string, kind int, a int, b int, shard int, slot int, value long"


def _compare(top: int):
    """Rows (lang, shard, slot, source number, n), sorted; slot -1 has the totals N + 2 V, with number -1 for the language.

    Out come sums of divergence per pair of sources (kind 0) and, per source, the slots of each block whose divergence from the
    language is among its ``top`` largest, ties included (kind 1).
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), *[pa.int32()] * 5, pa.int64()])))

    def emit(lang, kind, a, b, shard, slot, value):
        n = len(value)
        fill = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int32), n))
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), fill(kind), fill(a), fill(b), fill(shard), fill(slot), pa.array(np.asarray(value, dtype=np.int64))], schema=schema)

    def pair_rows(lang, sums):
        for a in range(len(sums) - 1):
            yield emit(lang, 0, a, np.arange(a + 1, len(sums)), 0, 0, sums[a, a + 1 :])

    def block(lang, shard, totals, whole, cells, sums):
        """cells: (slot, source number, n) of whole slots."""
        slot, at = np.unique(cells[:, 0], return_inverse=True)
        counts = np.zeros((len(slot), len(totals)), dtype=np.int64)
        counts[at, cells[:, 1]] = cells[:, 2]
        p = parts_per_billion(counts, totals[None, :])
        q = parts_per_billion(counts.sum(axis=1), whole)
        for a in range(len(totals) - 1):
            value = apart(p[:, a, None], p[:, a + 1 :]).sum(axis=0)
            if sums is None:
                yield emit(lang, 0, a, np.arange(a + 1, len(totals)), 0, 0, value)
            else:
                sums[a, a + 1 :] += value
        for a in range(len(totals)):
            own = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
            value = apart(p[own, a], q[own])
            if len(own) > top:
                best = value >= np.partition(value, len(value) - top)[len(value) - top]
                own, value = own[best], value[best]
            if len(own):
                yield emit(lang, 1, a, a, shard, slot[own], value)

    def runs(batches):
        """Rows (slot, source number, n) of one language and shard; those of a batch at a time."""
        for batch in batches:
            lang, shard = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            rest = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (2, 3, 4)], axis=1)
            at = 0
            for (name, number), same in groupby(zip(lang, shard.tolist())):
                n = sum(1 for _ in same)
                yield (name, number), rest[at : at + n]
                at += n

    def task(batches: Iterator[pa.RecordBatch]):
        now, sums, heads, cells, wide = None, None, [], [], 0

        def work(last: bool):
            """Blocks of all slots held, but for the last one, if rows of it may still come."""
            nonlocal sums, cells, wide
            head = np.concatenate(heads)
            named = head[head[:, 1] >= 0]
            totals = np.zeros(len(named), dtype=np.int64)
            totals[named[:, 1]] = named[:, 2]
            if sums is None and len(totals) <= HELD_SOURCES:
                sums = np.zeros((len(totals), len(totals)), dtype=np.int64)
            rows = np.concatenate(cells)
            end = len(rows) if last else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield from block(*now, totals, int(head[head[:, 1] == -1][0, 2]), rows[:end], sums)
            cells, wide = [rows[end:]], 1

        for where, rows in runs(batches):
            if where != now:
                if now:
                    yield from work(True)
                    if now[0] != where[0] and sums is not None:
                        yield from pair_rows(now[0], sums)
                        sums = None
                now, heads, cells, wide = where, [], [], 0
            heads.append(rows[rows[:, 0] == -1])
            cells.append(rows[rows[:, 0] >= 0])
            wide += np.count_nonzero(np.diff(cells[-1][:, 0])) + 1
            if wide > 1 and wide * sum(map(len, heads)) > HELD_CELLS:
                yield from work(False)
        if now:
            yield from work(True)
            if sums is not None:
                yield from pair_rows(now[0], sums)

    return task


def frequent_terms(docs: DataFrame, ws: Workspace, least_documents: int = 10) -> DataFrame:
    """(lang, term): the terms in at least so many documents of each language. ``docs`` has lang, source and text without nulls."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents)
    return ws.save(kept.select("lang", F.col("term").cast("string").alias("term")))


def build_hashes(kept: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, shards, shard, keys, packed): a perfect hash for every shard of about SHARD_KEYS terms, and its keys in the order of their slots."""
    sizes = broadcast_small(kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("shards")))
    spread = kept.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(_spread, "lang string, term string, shards int, shard int")
    return ws.save(spread.groupBy("lang", "shard").applyInPandas(_build, "lang string, shards int, shard int, keys array<string>, packed binary"))


def recount(docs: DataFrame, shards: DataFrame, ws: Workspace, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, shard, slot, n): how often each frequent term of a language occurs in each of its sources, where it does.

    Up to ``most_bytes`` the perfect hashes go to every task, which counts in dense slots. Beyond that, terms are counted per task and
    meet the keys in an equi-join; the counts are the same.
    """
    size = shards.agg(F.coalesce(F.sum(F.octet_length("packed")), F.lit(0))).first()[0]
    rows = docs.select("lang", "source", "text")
    if size > most_bytes:
        keys = shards.select("lang", "shard", F.posexplode("keys").alias("slot", "word")).select("lang", "shard", "slot", F.col("word").cast("binary").alias("term"))
        counts = rows.mapInArrow(_plain_counts, "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        return ws.save(counts.join(keys, ["lang", "term"]).select("lang", "source", "shard", "slot", "n"))
    packed: dict[str, list[bytes | None]] = {}
    for r in shards.select("lang", "shards", "shard", "packed").toLocalIterator():
        packed.setdefault(r["lang"], [None] * r["shards"])[r["shard"]] = bytes(r["packed"])
    shared = ws.spark.sparkContext.broadcast(packed)
    counts = rows.mapInArrow(_recount(shared), "lang string, source string, shard int, slot int, n long")
    return ws.save(counts.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")))


def source_divergence(
    docs: DataFrame, ws: Workspace, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = 10, top: int = 10, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far apart the sources of a language are.

    Terms are runs of ASCII letters (lower-cased) and of any characters beyond ASCII; each language keeps those in ``least_documents`` of its
    documents or more. A group (language, source), and a language as a whole, give a kept term 1 + floor(10^9 (n + 2) / (N + 2 V)) parts, where n
    counts it there, N all kept terms there, and V is the number of kept terms. Two shares p and q are floor((p - q)^2 / (p + q)) apart; all
    numbers are integers. Part ``pair`` ranks the other sources of the language by the sum over all kept terms, part ``term`` the ``top`` terms
    that the group has more of than its language; ties go by name.

    Nulls in the three columns are empty strings, and an empty name is a language or source like others. Very long texts are read in pieces.
    Repeated rows count as often as they are there. A group without terms, and a language without kept terms (V = 0), has its pairs, the
    latter with value 0. Other columns are not read; an empty table gives an empty result. The result has a row per ordered pair of sources
    of one language, so it grows with the square of their number by definition.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = frequent_terms(rows, ws, least_documents)
    shards = build_hashes(kept, ws)
    counts = recount(rows, shards, ws, most_bytes)
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")
    groups = rows.groupBy("lang", "source").count().select("lang", "source", number)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = shards.groupBy("lang").agg(F.sum(F.size("keys")).cast("long").alias("kept"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    groups = ws.save(groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", "number", zero("total").alias("total"), zero("kept").alias("kept")))
    places = shards.select("lang", "shard").union(groups.groupBy("lang").agg(F.max("kept").alias("v")).where("v = 0").select("lang", F.lit(0)))
    whole = groups.groupBy("lang").agg((F.sum("total") + 2 * F.max("kept")).alias("n")).select("lang", F.lit(-1).alias("number"), "n")
    heads = places.join(groups.select("lang", "number", (F.col("total") + 2 * F.col("kept")).alias("n")).union(whole), "lang")
    cells = counts.join(broadcast_small(groups), ["lang", "source"]).select("lang", "shard", "slot", "number", "n")
    order = ["lang", "shard", "slot", "number"]
    dealt = cells.union(heads.select("lang", "shard", F.lit(-1), "number", "n")).repartition("lang", "shard").sortWithinPartitions(*order)
    found = ws.save(dealt.mapInArrow(_compare(top), FOUND))
    named = groups.select("lang", "source", "number")
    one = found.where("kind = 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = one.union(one.select("lang", F.col("b"), F.col("a"), "value"))
    pairs = both.join(named.withColumnRenamed("number", "a"), ["lang", "a"]).join(named.select("lang", F.col("source").alias("item"), F.col("number").alias("b")), ["lang", "b"])
    keys = shards.select("lang", "shard", F.posexplode("keys").alias("slot", "item"))
    terms = found.where("kind = 1").withColumnRenamed("a", "number").join(keys, ["lang", "shard", "slot"]).join(named, ["lang", "number"])
    listed = ["lang", "source", "part", "item", "value"]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("part", F.lit("pair")).select(*listed, rank.alias("rank"))
    terms = terms.withColumn("part", F.lit("term")).select(*listed, rank.alias("rank")).where(F.col("rank") <= top)
    return pairs.union(terms)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{folder}/documents.parquet"), Workspace(spark))


OP12_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents
), counted as (
  select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs) group by all
), kept as (select lang, term from counted group by lang, term having count(*) >= 10),
per_group as (select lang, source, term, sum(n) as n from counted join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
grid as (select g.lang, g.source, k.term, coalesce(n, 0)::hugeint as n from groups g join kept k using (lang) left join per_group using (lang, source, term)),
shares as (
  select *, 1 + 1000000000::hugeint * (n + 2) // (sum(n) over w + 2 * count(*) over w)::hugeint as p from grid window w as (partition by lang, source)
), whole as (
  select lang, term, 1 + 1000000000::hugeint * (n + 2) // (sum(n) over w + 2 * count(*) over w)::hugeint as q
  from (select lang, term, sum(n)::hugeint as n from grid group by all) window w as (partition by lang)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from shares join whole using (lang, term) where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= 10
"""

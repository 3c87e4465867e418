"""Groups of spelling variants: words one letter apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.llm.storage import Workspace
from claimloom.llm.text import M64, split_mix, texts

# In valid UTF-8, C3 and the byte after it are one code point from C0 to FF.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
# One run in NOISE loses a code point, by its document.
NOISE = 97
HELD_WORDS = 400_000
# Parts that the elements of a multiset are dealt into. Two words of one length differ in two elements at most, so all but two parts
# agree; one with a letter more differs in one element, so all but one agree.
PARTS = 4


def runs_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Maximal runs of letters with A-Z lower-cased, in lists of bounded length."""
    text = (text or b"").lower()  # of bytes: ASCII letters only
    if len(text) < 1 << 20:
        yield RUN.findall(text)
    else:
        yield from map(list, batched((m.group() for m in RUN.finditer(text)), 100_000))


def without(word: bytes, h: int) -> bytes:
    """The word without its code point number ``h`` modulo its length."""
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(batches: Iterator[pa.RecordBatch]):
    """(id, text) rows become (word, n), summed within the task as far as memory goes."""
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    crc = zlib.crc32
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            begun = crc(f"{'' if doc is None else doc}:".encode())
            for part in runs_of(text):
                held.update(part)
                # the noise is a function of document and run, so all of a run's occurrences here go the same way
                hit = [w for w in set(part) if crc(w, begun) % NOISE == 0]
                if hit:
                    times = Counter(part)
                    for w in hit:
                        held[w] -= times[w]
                        held[without(w, crc(w, begun))] += times[w]
            if len(held) > HELD_WORDS:
                yield rows()
                held = Counter()
    if held:
        yield rows()


def count_words(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): words of at least so many code points that occur so often in all of ``docs``."""
    counts = docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(_counts, "word string, n long")
    counts = counts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return ws.save(counts.where(F.col("n") >= least_count))


@cache
def element(letter: str, k: int) -> tuple[int, int]:
    """Part and hash of the multiset element that stands for the k-th occurrence of a letter."""
    return zlib.crc32(f"{letter}{k}".encode()) % PARTS, xxhash.xxh64_intdigest(f"{letter}{k}")


def multiset(word: str) -> list[int]:
    """Per part the sum of the hashes of the word's elements: (letter, k) is one if the letter occurs k times or more."""
    seen: dict[str, int] = {}
    parts = [0] * PARTS
    for letter in word:
        k = seen[letter] = seen.get(letter, 0) + 1
        part, h = element(letter, k)
        parts[part] += h
    return [x & M64 for x in parts]


SAME, SHORT, LONG = 0, 1, 2


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures (words x count) of the words' letter multisets, and the role of each column.

    A SAME signature stands for words of one length whose multisets differ in two elements at most, so all parts but two agree; SHORT and LONG
    ones meet where a word has one element more, so all parts but one agree. One letter's change leaves the first or the last half of the
    shorter word as it is, so every signature is held once with either half, which keeps anagrams apart.
    """
    parts = np.array([multiset(w) for w in words], dtype=np.uint64).reshape(len(words), PARTS)
    total = parts.sum(axis=1, dtype=np.uint64)
    digest = lambda pieces: np.fromiter((xxhash.xxh64_intdigest(x) for x in pieces), dtype=np.uint64, count=len(words))
    size = np.fromiter(map(len, words), dtype=np.uint64, count=len(words))
    halves = {
        False: (digest(w[: len(w) // 2] + "<" for w in words), digest(">" + w[len(w) // 2 :] for w in words)),
        True: (digest(w[: (len(w) - 1) // 2] + "<" for w in words), digest(">" + w[(len(w) - 1) // 2 + 1 :] for w in words)),
    }
    columns, roles = [], []
    for role in (SAME, SHORT, LONG):
        for left in combinations(range(PARTS), 2 if role == SAME else 1):
            rest = total - parts[:, left].sum(axis=1, dtype=np.uint64)
            mark = np.uint64(xxhash.xxh64_intdigest(f"{min(role, SHORT)}{left}"))
            for half in halves[role == LONG]:
                columns.append(split_mix(split_mix(rest + mark) ^ (half + (size - np.uint64(role == LONG)) * np.uint64(0x9E3779B97F4A7C15))))
                roles.append(role)
    return np.stack(columns, axis=1), np.array(roles, dtype=np.int8)


def _signed(batches: Iterator[pa.RecordBatch]):
    """(word, n) rows become one row (sig, role, word, n) per signature."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            sigs, roles = signatures(part.column(0).to_pylist())
            n, count = sigs.shape
            take = pa.array(np.repeat(np.arange(n), count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs.ravel().view(np.int64)), pa.array(np.tile(roles, n)), part.column(0).take(take), part.column(1).take(take)], ["sig", "role", "word", "n"])


def near_pairs(words: DataFrame, ws: Workspace) -> DataFrame:
    """(a, a_n, b, b_n), once per pair: all words of ``words(word, n)`` that differ by exactly one inserted, deleted or replaced code point.

    Words meet in an equi-join on their signatures, where the edit distance is verified; a pair found by several is told once.
    """
    signed = words.mapInArrow(_signed, "sig long, role byte, word string, n long")
    left, right = (signed.select("sig", *[F.col(c).alias(f"{x}_{c}") for c in ("role", "word", "n")]) for x in "ab")
    facing = ((F.col("a_role") == SAME) & (F.col("b_role") == SAME) & (F.col("a_word") < F.col("b_word"))) | ((F.col("a_role") == SHORT) & (F.col("b_role") == LONG))
    found = left.hint("merge").join(right, "sig").where(facing & (F.levenshtein("a_word", "b_word", 1) == 1))
    return ws.save(found.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n").distinct())


def follow(forms: DataFrame, ws: Workspace, max_rounds: int = 64) -> DataFrame:
    """(word, root): where the chains of ``forms(word, form)``, which has no circles, end. Each round doubles the steps taken."""
    now = ws.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = ws.save(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ws.drop(now)
        now = following
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
    raise RuntimeError("the chains did not end")


def spelling_variants(
    docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` with ``least_length`` code points or more that occurs ``least_count`` times or more.

    Words are runs of ASCII letters (lower-cased) and of U+00C0 to U+00FF; by its document, one run in NOISE loses a code point first. A word's
    form is its near word (one inserted, deleted or replaced code point) that occurs most, if at least ``ratio`` times as often, the first in
    code-point order if several do; its root is where forms lead to.

    Null and empty texts have no words; very long ones are read in pieces. A null id stands as an empty string in the noise. Repeated rows
    count as often as they are there. Further columns are not read; an empty table gives an empty result. ``ratio`` has to be over 1, or forms
    could go in circles.
    """
    words = count_words(docs, ws, id_col, text_col, least_length, least_count)
    pairs = near_pairs(words, ws)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    judged = ws.save(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    ws.drop(words, pairs)
    roots = follow(judged.where("form IS NOT NULL"), ws)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), Workspace(spark))


# The CRC goes byte by byte over a table; near words share a word with one place cut out, at the same place if one is as long as the other.
OP11_SQL = r"""
with recursive crc_table as (
  select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, b) order by b) as t from range(256) r(b)
), runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents
  ) group by all
), hashed as (
  select run, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x) - 64] end)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint)) as h
  from runs, crc_table
), noisy as (
  select n, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
), words as (
  select word, sum(n)::bigint as n from noisy where length(word) >= 5 group by word having sum(n) >= 3
), cuts as (
  select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as other, b.n as m from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select w.word, c.word, c.n from words w join cuts c on c.rest = w.word
  union select c.word, w.word, w.n from words w join cuts c on c.rest = w.word
), best as (
  select word, count(*) as n_near, min(struct_pack(m := -m, other := other)) as b from near group by word
), judged as (
  select word, n, coalesce(n_near, 0) as n_near, case when -b.m >= 2 * n then b.other end as form, case when -b.m >= 2 * n then -b.m end as form_n from words left join best using (word)
), steps as (
  select word, form as root from judged where form is not null
  union all select s.word, j.form from steps s join judged j on j.word = s.root where j.form is not null
), roots as (
  select s.word, s.root from steps s join judged j on j.word = s.root where j.form is null
)
select word, form, coalesce(root, word) as root, n, n_near, form_n from judged left join roots using (word)
"""

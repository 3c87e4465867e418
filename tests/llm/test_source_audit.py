"""Divergence of sources against exact arithmetic in plain Python."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import source_audit
from claimloom.llm.source_audit import PerfectHash, Shard, Vocabulary, hash_terms, shard_of

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def slow_divergence(rows, least=10, top=10):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs, n = Counter(), Counter()
    for t, lang, source in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        docs.update((lang, x) for x in set(terms))
        n.update((lang, source, x) for x in terms)
    out = set()
    for lang in {x[1] for x in rows}:
        kept = sorted(x for (a, x), k in docs.items() if a == lang and k >= least)
        sources = {x[2] for x in rows if x[1] == lang}
        counts = {s: {x: n[lang, s, x] for x in kept} for s in sources}
        whole = {x: sum(counts[s][x] for s in sources) for x in kept}
        share = lambda c: {x: 1 + floor(Fraction(10**9 * (c[x] + 2), sum(c.values()) + 2 * len(kept))) for x in kept}
        p, q = {s: share(counts[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [("pair", b, sum(f(p[s][x], p[b][x]) for x in kept)) for b in sources - {s}]
            terms = [("term", x, f(p[s][x], q[x])) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, most in ((pairs, len(pairs)), (terms, top)):
                for rank, (name, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.add((lang, s, name, item, value, rank))
    return out


def sample(seed, n=240):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéz中") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", "", None]), rng.choice(["hot"] * 6 + ["a", "b", "", None, "ä"])
        text = rng.choice([" ", "-", "\x7f", "7"]).join(rng.choice(words[(len(lang or "") * 10) :]).upper() for _ in range(rng.randint(0, 40)))
        rows.append((text, lang, source))
    return rows + [(None, "en", "a"), ("", "rare", "x"), ("only once", "rare", "y"), (None, "rare", "z")] + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "n", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, shard int")


def rows_of(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("most", [source_audit.BROADCAST_BYTES, 0])
def test_divergence_equals_plain_arithmetic(spark, ws, most):
    rows = sample(1)
    got = source_audit.source_divergence(frame(spark, rows), ws, most_bytes=most)
    want = slow_divergence(rows)
    assert rows_of(got) == want and got.count() == len(want)


def test_small_blocks_many_shards_and_little_memory(spark, ws, monkeypatch):
    for name, value in (("SHARD_KEYS", 4), ("HELD_CELLS", 3), ("HELD_SOURCES", 1), ("HELD_TERMS", 5), ("HELD_SLOTS", 1)):
        monkeypatch.setattr(source_audit, name, value)
    rows = sample(2, 120)
    assert rows_of(source_audit.source_divergence(frame(spark, rows), ws, least_documents=4)) == slow_divergence(rows, 4)


def test_top_terms_with_ties(spark, ws):
    rows = [(" ".join("t" + chr(97 + i) for i in range(26)), "en", s) for s in "ab" for _ in range(6)] + [("za zb zc", "en", "c")] * 12
    assert rows_of(source_audit.source_divergence(frame(spark, rows), ws, top=3)) == slow_divergence(rows, top=3)


def test_nothing_gives_nothing(spark, ws):
    assert source_audit.source_divergence(frame(spark, []).where(F.lit(False)), ws).count() == 0


def test_perfect_hash_numbers_every_key_once():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(PerfectHash(hashes).find(hashes).tolist()) == list(range(len(hashes)))
    assert PerfectHash(hashes[:0]).find(hashes).tolist() == [-1] * len(hashes)


def test_stored_keys_turn_strangers_away(monkeypatch):
    keys, strangers = [b"k%d" % i for i in range(3000)], [b"s%d" % i for i in range(3000)]
    shard = Shard.unpack(Shard(keys).pack())
    found = shard.find(keys, hash_terms(keys))
    assert sorted(found.tolist()) == list(range(3000)) and [shard.keys()[i] for i in found.tolist()] == keys
    assert set(shard.find(strangers, hash_terms(strangers)).tolist()) == {-1}
    # keys whose hashes are equal still have places of their own
    monkeypatch.setattr(source_audit, "hash_terms", lambda ks: np.array([len(k) for k in ks], dtype=np.uint64))
    shard = Shard(keys)
    found = shard.find(keys, source_audit.hash_terms(keys))
    assert sorted(found.tolist()) == list(range(3000)) and [shard.keys()[i] for i in found.tolist()] == keys


def test_vocabulary_slots_are_dense():
    keys = [b"k%d" % i for i in range(500)]
    at = shard_of(hash_terms(keys), 7)
    vocabulary = Vocabulary([Shard([k for k, s in zip(keys, at) if s == n]) for n in range(7)])
    slots = vocabulary.find([*keys, b"other"])
    assert sorted(slots[:-1].tolist()) == list(range(500)) and slots[-1] == -1
    shard, number = vocabulary.place(slots[:-1])
    assert shard.tolist() == at.tolist() and [vocabulary.shards[s].keys()[i] for s, i in zip(shard, number)] == keys


def test_shares_are_exact_for_large_counts():
    for c, total in ((0, 7), (10**12, 10**12 + 5), (999_999_999_999, 3 * 10**12), (5, 10**13)):
        assert source_audit.parts_per_billion(np.array([c]), np.array([total])).tolist() == [1 + 10**9 * (c + 2) // total]

"""Spelling variants against brute force on small cases."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from claimloom.llm import spelling


def slow_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def slow_variants(rows):
    n = slow_words(rows)
    others = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            others[a].append(b)
            others[b].append(a)
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    return {tuple(r) for r in df.collect()}


def test_variants_equal_brute_force(spark, ws, docs):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abeéÿr") for _ in range(rng.randint(4, 12))) for _ in range(40)]
    words = []
    for b in bases:
        for _ in range(12):
            at, c = rng.randrange(len(b)), rng.choice("abeéÿr")
            words += [b, b, b, rng.choice([b[:at] + b[at + 1 :], b[:at] + c + b[at:], b[:at] + c + b[at + 1 :], b.upper()])] * rng.randint(1, 3)
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "—", "1"]).join(words[i::60])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "Āā 12 ..."), (None, "hello hello Hello"), (None, "hallo"), (3, "hello"), (3, "hello"), (70, "maken " * 3 + "makes " * 8 + "mates " * 20)]
    want = slow_variants(rows)
    assert any(form for _, form, *_ in want) and any(form and root != form for _, form, root, *_ in want)
    assert found(spelling.spelling_variants(docs(rows), ws)) == want


def test_ties_go_by_code_point_and_a_small_lead_gives_no_form(spark, ws, docs):
    text = " ".join(["crane"] * 3 + ["crave"] * 6 + ["craze"] * 6 + ["crabe"] * 5 + ["stone"] * 4 + ["stove"] * 7)
    got = {r.word: (r.form, r.n_near, r.form_n) for r in spelling.spelling_variants(docs([(2, text)]), ws).collect()}
    assert got["crane"] == ("crave", 3, 6) and got["crabe"] == (None, 3, None)
    assert got["stone"] == (None, 1, None)


def test_chains_are_followed_to_their_end(spark, ws):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)]
    got = {r.word: r.root for r in spelling.follow(spark.createDataFrame(chain, "word string, form string"), ws).collect()}
    assert got == {w: "w20" for w, _ in chain}


def test_no_words_give_no_rows(spark, ws, docs):
    assert spelling.spelling_variants(docs([]), ws).count() == 0
    assert spelling.spelling_variants(docs([(1, None), (2, "a b c")]), ws).count() == 0


def test_long_texts_are_read_in_pieces():
    text = ("Abcé-" * 300_000).encode()
    assert len(text) > 1 << 20 and sum(map(Counter, spelling.runs_of(text)), Counter()) == {"abcé".encode(): 300_000}


@pytest.mark.parametrize("a, b", [("abcde", "abXde"), ("abcde", "abcdeX"), ("abcde", "Xabcde"), ("abcde", "abXcde"), ("aaaaa", "aaaaaa"), ("abcdef", "Xbcdef"), ("abcdef", "abcdeX"), ("étést", "etést")])
def test_near_words_share_a_signature(a, b):
    (x, y), roles = spelling.signatures([a, b])
    if len(a) == len(b):
        assert set(x[roles == spelling.SAME].tolist()) & set(y[roles == spelling.SAME].tolist())
    else:
        assert set(x[roles == spelling.SHORT].tolist()) & set(y[roles == spelling.LONG].tolist())

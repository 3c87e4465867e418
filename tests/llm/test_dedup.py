"""Exact, SimHash, substring, line and vector deduplication against brute force on small cases."""

import hashlib
import math
import os
import random
import re
from itertools import combinations

import pytest
import test_line_runs
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import embedding_dedup, exact_dedup, graph, line_dedup, simhash, substring_dedup


def groups_of(n, links):
    low = list(range(n))
    find = lambda i: i if low[i] == i else find(low[i])
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark, ws):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (5, 6), (6, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_components_of_nothing(spark, ws):
    assert graph.components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


EXACT = [(3, "a  b"), (1, "a\tb"), (2, "c"), (None, "c"), (4, None), (5, ""), (6, " "), (7, "x" * 50_000), (8, "x" * 50_000), (9, "a b"), (9, "a b")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_even_if_digests_collide(spark, ws, docs, tmp_path, weak):
    path = str(tmp_path / "docs")
    docs(EXACT).coalesce(2).write.parquet(path)
    digest = (lambda x: (F.length(x) % 2).cast("string")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_duplicates(spark, path, ws, digest=digest).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in EXACT:
        by.setdefault(norm(t), []).append(i)
    want = sorted((i or 0, min(x for x in ids if x is not None), len(ids)) for ids in by.values() for i in ids)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_state_outlives_a_run_and_takes_new_files(spark, ws, docs, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    docs([(5, "same"), (6, "other")]).coalesce(1).write.parquet(path)
    exact_dedup.exact_duplicates(spark, path, ws, state=state).collect()
    docs([(2, "same")]).coalesce(1).write.mode("append").parquet(path)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(spark, path, ws, state=state, files_per_batch=1).collect()}
    assert got == {5: (2, False), 2: (2, True), 6: (6, True)}


def test_exact_state_takes_files_however_old(spark, ws, docs, tmp_path):
    path, state = tmp_path / "docs", str(tmp_path / "state")
    docs([(5, "same"), (6, "other")]).coalesce(1).write.parquet(str(path))
    exact_dedup.exact_duplicates(spark, str(path), ws, state=state).collect()
    known = set(path.glob("*.parquet"))
    docs([(2, "same"), (9, "new")]).coalesce(1).write.mode("append").parquet(str(path))
    for f in set(path.glob("*.parquet")) - known:
        os.utime(f, (1, 1))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark, str(path), ws, state=state).collect()}
    assert got == {5: (2, 2), 2: (2, 2), 6: (6, 1), 9: (9, 1)}


def test_exact_rows_that_the_state_does_not_know_are_an_error(spark, ws, docs, tmp_path, monkeypatch):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    docs([(5, "same")]).write.parquet(path)
    exact_dedup.exact_duplicates(spark, path, ws, state=state).collect()
    docs([(7, "unseen")]).write.mode("append").parquet(path)
    monkeypatch.setattr(exact_dedup, "update_state", lambda *a, **k: None)
    with pytest.raises(Exception, match="no entry"):
        exact_dedup.exact_duplicates(spark, path, ws, state=state).collect()


def test_exact_of_an_empty_table(spark, ws, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_duplicates(spark, str(tmp_path / "none"), ws).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, ws, docs):
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    rows = [(100 + i, " ".join(w if rng.random() > 0.01 * (i % 5) else "Zz" for w in base[i % 6])) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "ÄB c"), (5, "Äb C"), (6, "w " * 20_000), (None, "w " * 20_000), (100, rows[0][1])]
    got = simhash.near_duplicates(docs(rows), ws).collect()
    fps = sorted({slow_fingerprint(t) for _, t in rows})
    group = groups_of(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    at = {f: group[k] for k, f in enumerate(fps)}
    low = {}
    for i, t in rows:
        if i is not None:
            low[at[slow_fingerprint(t)]] = min(i, low.get(at[slow_fingerprint(t)], i))
    want = sorted((i or 0, slow_fingerprint(t), low[at[slow_fingerprint(t)]]) for i, t in rows)
    assert sorted((r.doc_id or 0, r.fp % (1 << 64), r.component) for r in got) == want


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_multi_index_misses_no_link(spark, segments):
    rng = random.Random(segments)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 3, 4, 5)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, segments)
    assert {(r.a, r.b) for r in got.collect()} == want


def slow_removal(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (key, _), w in zip(rows, words):
        gone = {i + d for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for d in range(window)}
        out.append((key or 0, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_substrings_at_every_offset(spark, ws, docs):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    shared, exact = fresh(60), fresh(35)
    rows = [(i, " ".join(fresh(i) + shared + fresh(9))) for i in range(0, 45)]
    rows += [(50 + i, "\n".join(fresh(3 * i) + exact[: 34 + i % 2] + fresh(5))) for i in range(8)]
    rows += [(70, " ".join(exact * 3)), (71, None), (72, ""), (None, " ".join(fresh(40))), (74, "é " * 30_000), (75, "one two"), (75, "one two")]
    got = substring_dedup.remove_repeats(docs(rows), ws).select("doc_id", F.col("n_words").cast("long"), "n_removed", "kept_text", "row")
    assert sorted((r[0] or 0, *r[1:4]) for r in got.collect()) == slow_removal(rows, 35)
    assert {r["row"] for r in got.collect()} == {7}


def test_every_difference_is_in_the_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_rows_repeated_in_full_count_as_repeats(spark, ws, docs):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring_dedup.remove_repeats(docs([(1, text), (1, text)]), ws).collect()
    assert [(r.n_removed, r.kept_text) for r in got] == [(40, ""), (40, "")]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_no_sum_over_a_window_makes_up_for_a_change(spark, ws, docs):
    """Strings that collide under every polynomial modulo 2^64, as letters of a word and as words."""
    one, two = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join(thue_morse(64)[:35])), (4, " ".join(thue_morse(64)[29:]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(rows), ws).collect()}
    assert got == {k: n for (k, _), (_, _, n, _) in zip(rows, slow_removal(rows, 35))} and got[1] == got[2] == 0


@pytest.mark.parametrize("width", [1, 2, 15, 35, 64])
def test_run_hashes_depend_on_the_run_only(width):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    x[150:150 + min(width, 50)] = x[20:20 + min(width, 50)]
    got = substring_dedup.run_hashes(x, width)
    assert len(got) == 200 - width + 1 and len(substring_dedup.run_hashes(x[: width - 1], width)) == 0
    for i in (0, 20, 77):
        assert substring_dedup.run_hashes(x[i : i + width], width).tolist() == [got[i]]
    assert width > 50 or got[20] == got[150]
    assert len(set(got.tolist())) == len({tuple(x[i : i + width].tolist()) for i in range(len(got))})


def test_substring_names_that_differ_in_case_only_are_replaced(spark, ws):
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, N_WORDS string"), ws)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"] and got.first().n_words == 2


def test_substrings_of_an_empty_table(spark, ws, docs):
    assert substring_dedup.remove_repeats(docs([]), ws).count() == 0


def slow_chunks(text):
    lines = (text or "").split("\n")
    return test_line_runs.slow_chunks(lines, test_line_runs.marks_of(lines))


def test_line_chunks(spark, ws, docs):
    rng = random.Random(4)
    passage = [f"line {rng.getrandbits(30)}" for _ in range(20)]
    rows = [(i, "\n".join([f"own {i}"] * (i % 3) + passage[i % 4 :] + [f"end {i}"])) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n\n\n"), (43, "\n\n\n\n"), (44, "x\n" * 5_000), (45, "single"), (46, "single")]
    seen, want = set(), []
    for key, text in rows:
        chunks = slow_chunks(text)
        kept = []
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                continue
            seen.add(tuple(c))
            kept.append("\n".join(c))
        want.append((key, sum(map(len, chunks)), "\n".join(kept)))
    got = line_dedup.remove_repeated_chunks(docs(rows), ws)
    assert sorted((r.doc_id, r.n_lines, r.kept_text) for r in got.collect()) == want
    assert got.where("n_removed_lines > 0").count() > 20


def test_line_chunks_with_null_and_equal_ids(spark, ws, docs):
    text = "\n".join(f"line {i}" for i in range(30))
    got = line_dedup.remove_repeated_chunks(docs([(None, text), (None, text), (1, text), (1, text)]), ws).collect()
    assert len(got) == 4 and sum(r.kept_text == text for r in got) == 1
    assert line_dedup.remove_repeated_chunks(docs([]), ws).count() == 0


def test_vectors_against_brute_force(spark, ws):
    rng = random.Random(6)
    rows = []
    for c in range(30):
        centre = [rng.gauss(0, 1) for _ in range(64)]
        for _ in range(12):
            rows.append((len(rows), [x + rng.gauss(0, rng.choice([0.02, 0.12])) for x in centre], c % 3))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, [0.0] * 64, 0), (1003, None, 0), (1004, [], 0), (1005, [math.nan] + [1.0] * 63, 0), (1006, [None] + [1.0] * 63, 0), (1007, rows[0][1], None), (1008, rows[0][1][:10], 0)]
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = set()
    for a, b in combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            dot = sum(x * y for x, y in zip(a[1], b[1])) / math.sqrt(sum(x * x for x in a[1]) * sum(y * y for y in b[1]))
            if dot >= 0.98:
                links.add((a[0], b[0]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(frame, ws, block=8).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got) / 2
    assert 0.98 * len(links) <= found <= len(links) and len(links) > 300
    degree = {r.vec_id: r.n_links for r in got}
    for i in degree:
        assert degree[i] <= sum(i in x for x in links)
    place = {r[0]: k for k, r in enumerate(rows)}
    group = groups_of(len(rows), [(place[a], place[b]) for a, b in links])
    if found == len(links):
        assert {r.vec_id: r.component_id for r in got} == {r[0]: rows[group[k]][0] for k, r in enumerate(rows)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_without_ids_or_rows(spark, ws):
    schema = "vec_id long, embedding array<double>, label int"
    v = [1.0] * 16
    got = embedding_dedup.near_vectors(spark.createDataFrame([(None, v, 1), (4, v, 1), (4, v, 1)], schema), ws).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema), ws).count() == 0


def test_lattice_points_are_nearest():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    home = embedding_dedup.nearest_e8(x)
    gap = ((x - home) ** 2).sum(axis=1)
    for v in embedding_dedup.minimal_vectors():
        assert (((x - home - v) ** 2).sum(axis=1) >= gap - 1e-9).all()
    doubled = home * 2
    assert (doubled == np.rint(doubled)).all() and ((home.sum(axis=1) % 2) == 0).all()

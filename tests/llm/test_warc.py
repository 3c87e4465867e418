"""Archives: a round trip, foreign archives, and what is refused."""

import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from claimloom.llm import warc

COLUMNS = "page_id long, url string, html string, row int, payload string, R string"
LONG = "<p>" + "long text " * 40_000


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "p", "r") for i, u, h in rows], COLUMNS)


def round_trip(spark, ws, rows, path, **options):
    warc.write_archives(frame(spark, rows).repartition(3), path, ws, **options)
    found = ws.save(warc.read_archives(spark, path))
    warc.check_records(found)
    return found


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [(i, f"http://x.org/{i}", f"<html><body>page {i % 37} of many " + "words " * (i % 5) + "</body></html>") for i in range(400)]
ODD = [(900, None, None), (901, "http://x.org/a b\r\nX-Page-ID: 7", ""), (902, "http://x.org/é", "中é\r\n\r\nWARC/1.1\r\n"), (903, "u", LONG), (899, "u", LONG), (904, "g", warc.GAP * 3), (None, "n", "null id"), (None, "n", "null id"), (905, "n", "null id"), (906, "d", "twice"), (906, "d", "twice"), (-5, "m", "negative")]


@pytest.mark.parametrize("least", [0, 60])
def test_round_trip(spark, ws, tmp_path, least):
    rows = ROWS + ODD
    found = round_trip(spark, ws, rows, str(tmp_path / "a"), least=least).collect()
    assert len(found) == len(rows) == len({r.record for r in found})
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    by_page = {}
    for r in found:
        by_page.setdefault(r.page, []).append(r)
    for i, _, h in rows:
        size = len((h or "").encode())
        assert {(r.size, r.digest) for r in by_page[i]} == {(size, digest(h))}
        head = min((x for x in groups[h or ""] if x is not None), default=None)
        kinds = sorted((r.type, r.refers_page) for r in by_page[i])
        if i not in (906, None):
            assert kinds == [("response", None) if size < least or i == head else ("revisit", head)]
    if not least:
        assert sorted(r.type for r in by_page[906]) == ["response", "revisit"] and {r.type for r in by_page[None]} == {"revisit"}
        assert sorted(r.payload.decode() for r in found if r.type == "response") == sorted(groups)


def test_files_are_plain_zstandard_with_a_dictionary_first(spark, ws, tmp_path):
    round_trip(spark, ws, ROWS, str(tmp_path / "a"))
    files = [p.read_bytes() for p in (tmp_path / "a").glob("part-*") if p.stat().st_size]
    assert files
    for data in files:
        assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
        size = int.from_bytes(data[4:8], "little")
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        whole = opener.stream_reader(data[8 + size :], read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and whole == b"".join(r for _, r, _ in warc.records(data))


def test_an_empty_table_and_an_empty_archive(spark, ws, tmp_path):
    assert round_trip(spark, ws, [], str(tmp_path / "a")).count() == 0
    assert list(warc.records(b"")) == []


PAYLOADS = [b"<p>some page number %d with common words</p>" % i * 3 for i in range(300)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("sized", [False, True])
def test_foreign_archives(spark, tmp_path, packed, sized):
    """A compressed dictionary, frames without their size or checksum, empty skippable frames in between."""
    dictionary = zstandard.train_dictionary(2048, PAYLOADS)
    raw = dictionary.as_bytes()
    lead = zstandard.ZstdCompressor().compress(raw) if packed else raw
    press = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=sized, write_checksum=sized)
    frames = [press.compress(warc.record_bytes(f"urn:x:{i}", i, "http://x.org", p, warc.EPOCH)) for i, p in enumerate(PAYLOADS)]
    data = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(lead).to_bytes(4, "little") + lead + warc.GAP.encode().join(frames)
    (tmp_path / "x.warc.zst").write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.error for r in got] == [None] * len(PAYLOADS) and [r.payload for r in got] == PAYLOADS
    cut = list(warc.records(data[:-9]))
    assert len(cut) == len(PAYLOADS) and cut[-1][2] and not any(e for _, _, e in cut[:-1])
    lone = list(warc.records(b"".join(frames)))
    assert all(r is None and e for _, r, e in lone)  # their dictionary is missing


def test_folded_fields_and_old_versions():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:a>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Note: one\r\n two\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    x = warc.parse(record)
    assert x["fields"]["x-note"] == "one two" and x["payload"] == b"abc" and x["size"] == 3


GOOD = warc.record_bytes("urn:x:1", 1, "http://x.org", b"payload", warc.EPOCH)


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 7", b"Content-Length: 8"), (b"payload", b"Payload"), (b"WARC-Date", b"WARC-Day"), (b"WARC-Type: response", b"WARC-Type response"),
    (b"payload\r\n\r\n", b"payload\r\n"), (b"payload\r\n\r\n", b"payload\r\n\r\nx"), (b"X-Page-ID", b"WARC-Type"), (b"sha1:", b"sha1:A"), (b"\r\nContent-Length: ", b"\r\nContent-Length: +"),
])
def test_broken_records_are_refused(old, new):
    warc.parse(GOOD)
    with pytest.raises(warc.Broken):
        warc.parse(GOOD.replace(old, new))


def test_errors_are_rows_and_lost_responses_are_found(spark, ws, tmp_path):
    press = zstandard.ZstdCompressor()
    revisit = warc.record_bytes("urn:x:2", 2, "u", b"payload", warc.EPOCH, head=("urn:x:1", 1))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.zst").write_bytes(press.compress(GOOD) + press.compress(b"nothing") + press.compress(revisit) + b"torn")
    got = warc.read_archives(spark, str(tmp_path / "bad")).collect()
    assert [(r.type, r.error is None) for r in got] == [("response", True), (None, False), ("revisit", True), (None, False)]
    with pytest.raises(warc.Broken):
        warc.check_records(warc.read_archives(spark, str(tmp_path / "bad")))
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "a.zst").write_bytes(press.compress(revisit))
    with pytest.raises(warc.Broken):
        warc.check_records(warc.read_archives(spark, str(tmp_path / "lost")))

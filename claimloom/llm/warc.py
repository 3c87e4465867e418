"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.llm.storage import Workspace, settings, unused, with_row_key

# Fixed values of the formats: magic numbers of Zstandard frames, the skippable frame that holds a dictionary, and of a dictionary.
FRAME, SKIPPABLE, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0xEC30A437
# An empty skippable frame. Spark's text writer puts it after every row, so its files are plain sequences of frames.
GAP = "P*M\x18\x00\x00\x00\x00"
# The dictionary of an archive is trained on its first payloads, up to so many and so many bytes of them; it has at most DICTIONARY_BYTES.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 1 << 14
BATCH_ROWS = "256"
EPOCH = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, record: str) -> str:
    """The url with what may not stand in a header percent-encoded; the record's own URN if there is none."""
    return re.sub(rb"[\x00-\x20\x7F-\xFF]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()).decode() or record


def record_bytes(record: str, page: int | None, url: str | None, payload: bytes, date: str, head: tuple[str, int | None] | None = None) -> bytes:
    """One record: a response with its payload, or, with ``head`` (record and page), a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if head else http + payload
    fields = [
        ("WARC-Type", "revisit" if head else "response"), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, record)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if head:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{head[0]}>")]
        if head[1] is not None:
            fields.append(("X-Refers-To-Page-ID", str(head[1])))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for payloads like ``samples``; None if they are too few or too short for one."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples) if total else None
    except zstandard.ZstdError:
        return None


def _writer(run: int, date: str, level: int):
    """Rows (r, page, url, html, head, head_page) become the frames of an archive, its dictionary first."""
    urn = lambda r: uuid.UUID(int=(run << 64) | (r & (1 << 64) - 1)).urn

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x in zip(*(batch.column(k) for k in range(6))):
                r, page, url, html, head, head_page = (v.as_py() for v in x)
                yield r, page, url, html or b"", None if head is None else (urn(head), head_page)

    def task(batches: Iterator[pa.RecordBatch]):
        source, first, size = rows(batches), [], 0
        for row in source:
            first.append(row)
            size += len(row[3])
            if len(first) >= SAMPLE_ROWS or size >= SAMPLE_BYTES:
                break
        dictionary = train_dictionary([x[3][: SAMPLE_BYTES // 8] for x in first])
        press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        out = []
        if dictionary is not None:
            raw = dictionary.as_bytes()
            out.append(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        held = sum(map(len, out))
        for part in (first, source):
            for r, page, url, payload, head in part:
                out.append(press.compress(record_bytes(urn(r), page, url, payload, date, head)))
                held += len(out[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return task


def write_archives(
    pages: DataFrame, path: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = EPOCH, level: int = 3
) -> None:
    """One WARC record per row of ``pages`` in archives under ``path``, which Spark's own writer commits.

    Of rows whose payloads (the html in UTF-8; null: empty) are equal and have ``least`` bytes or more, that with the smallest id becomes
    a response and the others revisits of it; payloads are equal if SHA-256 and length are. Shorter ones are all responses. Equal ids are
    told apart by a row number, and null ids come last in a group. A very long payload is one record; an empty table gives no record.
    Columns are read by name only, so others do not matter. Payloads pass one shuffle, by row, so a group of copies of any size is spread
    evenly; the archives are as large as Spark's advisory partition size makes them.
    """
    key = unused("row", pages)
    keyed, _ = with_row_key(pages.select(F.col(id_col).cast("bigint").alias(id_col), *dict.fromkeys((url_col, html_col))), id_col, ws, key)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = keyed.select(F.col(key).alias("r"), F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sums = rows.select("r", "page", F.unhex(F.sha2("payload", 256)).alias("sum"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    sums = ws.save(sums)
    first = F.min(F.struct(F.col("page").isNull(), F.col("page").alias("id"), F.col("r").alias("row"))).alias("first")
    heads = sums.groupBy("sum", "size").agg(first, F.count("*").alias("n")).where("n > 1").select("sum", "size", F.col("first.row").alias("head"), F.col("first.id").alias("head_page"))
    copies = sums.join(heads.hint("merge"), ["sum", "size"]).where("r <> head").select("r", "head", "head_page")
    told = rows.join(copies.hint("merge"), "r", "left").select("r", "page", "url", "payload", "head", "head_page")
    frames = told.mapInArrow(_writer(uuid.uuid4().int >> 64, date, level), "frame binary")
    with settings(ws.spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS, spark__sql__files__maxRecordsPerFile="0"):
        frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).text(path)
    ws.drop(sums)


class Broken(ValueError):
    """An archive or a record that does not keep to the format."""


def _number(data: memoryview, at: int, size: int) -> int:
    if at + size > len(data):
        raise Broken("the archive ends inside of a frame")
    return int.from_bytes(data[at : at + size], "little")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by the sizes of its blocks."""
    magic = _number(data, at, 4)
    if magic & ~0xF == SKIPPABLE:
        end = at + 8 + _number(data, at + 4, 4)
    elif magic == FRAME:
        try:
            checksum = zstandard.get_frame_parameters(data[at : at + 32]).has_checksum
            end = at + zstandard.frame_header_size(data[at : at + 32])
        except zstandard.ZstdError as e:
            raise Broken(f"frame header: {e}") from None
        last = 0
        while not last:
            head = _number(data, end, 3)
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise Broken("a block of a reserved type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
    else:
        raise Broken(f"no frame begins with {magic:08x}")
    if end > len(data):
        raise Broken("the archive ends inside of a frame")
    return end


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading frame, which may itself be compressed."""
    if content[:4] == FRAME.to_bytes(4, "little"):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != DICTIONARY.to_bytes(4, "little"):
        raise Broken("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)


def records(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of every frame of an archive. A frame that cannot be decoded has no record; one whose end is unknown is the last."""
    view, at, opener = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
            magic = _number(view, at, 4)
            if at == 0 and magic == DICTIONARY_FRAME:
                opener = zstandard.ZstdDecompressor(dict_data=load_dictionary(bytes(view[8:end])))
        except (Broken, zstandard.ZstdError) as e:
            yield at, None, str(e)
            return
        if magic == FRAME:
            try:
                found = opener.decompressobj()
                record, error = found.decompress(view[at:end]), None
                if not found.eof:
                    record, error = None, "the frame is not complete"
            except zstandard.ZstdError as e:
                record, error = None, str(e)
            yield at, record, error
        at = end


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-cased name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.split(b"\r\n"):
        text = line.decode("utf-8", "strict")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.lower()
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9a-z]+", name):
            raise Broken(f"no field: {text[:80]}")
        if name in out:
            raise Broken(f"{name} stands twice")
        out[name] = value.strip()
    return out


def _length(fields: dict[str, str], found: int, what: str) -> None:
    text = fields.get("content-length", "")
    if not re.fullmatch("[0-9]+", text) or int(text) != found:
        raise Broken(f"Content-Length of the {what} is {text or 'missing'}, not {found}")


def parse(record: bytes) -> dict:
    """A record's fields and payload, after its version, fields, lengths and digests are found to be right."""
    top, blank, rest = record.partition(b"\r\n\r\n")
    version, _, head = top.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise Broken("no WARC header")
    fields = _fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise Broken(f"{name} is missing")
    if not rest.endswith(b"\r\n\r\n"):
        raise Broken("two line ends after the block are missing")
    block = rest[:-4]
    _length(fields, len(block), "record")
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        raise Broken("the block has another digest")
    kind, payload, size = fields["warc-type"], block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        answer, blank, payload = block.partition(b"\r\n\r\n")
        status, _, lines = answer.partition(b"\r\n")
        if not blank or not status.startswith(b"HTTP/"):
            raise Broken("no HTTP header")
        http = _fields(lines) if lines else {}
        size = len(payload)
        if kind == "revisit":
            size = int(http["content-length"]) if re.fullmatch("[0-9]+", http.get("content-length", "")) else None
        elif "content-length" in http:
            _length(http, size, "HTTP body")
    said = fields.get("warc-payload-digest", "")
    if kind != "revisit" and said.startswith("sha1:") and said[5:] != digest_of(payload):
        raise Broken("the payload has another digest")
    if kind == "revisit" and not fields.get("warc-refers-to"):
        raise Broken("a revisit refers to nothing")
    return {"fields": fields, "type": kind, "payload": payload, "size": size, "digest": said.removeprefix("sha1:") or None}


SCHEMA = "archive string, at long, record string, type string, uri string, page long, size long, digest string, refers_to string, refers_page long, payload binary, error string"


def _reader(payloads: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "))])
    number = lambda x: int(x) if x and re.fullmatch("-?[0-9]+", x) else None

    def row(name: str, at: int, record: bytes | None, error: str | None):
        out = dict.fromkeys(names) | {"archive": name, "at": at, "error": error}
        if record is None:
            return out
        try:
            x = parse(record)
        except (Broken, UnicodeDecodeError) as e:
            return out | {"error": str(e)}
        f = x["fields"]
        return out | {
            "record": f["warc-record-id"].strip("<>"), "type": x["type"], "uri": f.get("warc-target-uri"), "page": number(f.get("x-page-id")), "size": x["size"], "digest": x["digest"],
            "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None, "refers_page": number(f.get("x-refers-to-page-id")),
            "payload": x["payload"] if payloads and x["type"] != "revisit" else None,
        }

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                out, held = [], 0
                for found in records(data.as_py()):
                    out.append(row(name.as_py(), *found))
                    held += 200 + len(out[-1]["payload"] or b"")
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return task


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, in the columns of SCHEMA: whose archive and offset, the fields that matter here, the
    payload (null for revisits, and without ``payloads``) and its size, and ``error``, null for a valid record.

    An archive is one task's work, frame by frame; Spark refuses files of over 2 GB. An archive without a leading dictionary frame is read
    without one, and skippable frames elsewhere are passed over. A frame that cannot be decoded or a record that fails a check is a row with
    an error; after a frame whose end cannot be told the rest of its archive is one such row. An empty archive has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), SCHEMA)


def check_records(found: DataFrame) -> None:
    """Raises for records with errors, and for revisits whose response is not there or has another page, size or digest."""
    bad = found.where("error IS NOT NULL").limit(1).collect()
    if bad:
        raise Broken(f"{bad[0]['archive']} at {bad[0]['at']}: {bad[0]['error']}")
    # Revisits are folded before they meet their response, so very many of one response are no hot key.
    said = found.where("type = 'revisit'").select("refers_to", "refers_page", "size", "digest").distinct()
    heads = found.where("type = 'response'").select(F.col("record").alias("refers_to"), F.col("page").alias("p"), F.col("size").alias("s"), F.col("digest").alias("d"))
    same = F.col("refers_page").eqNullSafe(F.col("p")) & (F.col("size") == F.col("s")) & (F.col("digest") == F.col("d"))
    lost = said.join(heads, "refers_to", "left").where(~F.coalesce(same, F.lit(False))).limit(1).collect()
    if lost:
        raise Broken(f"no response {lost[0]['refers_to']} of this page, size and digest")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark)
    archives = f"{ws.folder}/archives"
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), archives, ws)
    found = ws.save(read_archives(spark, archives, payloads=False).drop("payload"))
    check_records(found)
    return found.select(
        F.col("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to")
    )


OP13_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as body, min(page_id) over (partition by coalesce(html, '')) as head from pages
), sums as (
  select *, sha1(body) as h from p
), named as (
  select page_id, head, strlen(body)::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest
  from sums
)
select page_id, payload_bytes, payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type,
       case when page_id <> head then head end as refers_to
from named
"""

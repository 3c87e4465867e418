"""Large JSON arrays read by many tasks, each from its own byte range.

Whether a position lies inside of a string, and how deep, depends on everything before it. A first pass sums up every range for each state it
may begin in; put together in order, these tell where each range really begins. The second pass then takes the records that begin in it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE = 32 << 20
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
OPENERS, CLOSERS, BLANKS = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8), np.frombuffer(b" \t\r\n", np.uint8)


class NoArray(ValueError):
    """The content is not one list of objects."""


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that aren't escaped, and whether the byte after the last is escaped; ``escaped`` says so of the first."""
    slash = data == BACKSLASH
    at = np.arange(len(data))
    before = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at  # the last byte that is no backslash
    run = at - before  # length of the run of backslashes that ends here
    # the run at the very start goes on from before
    odd = (run + np.where(before < 0, int(escaped), 0)) % 2 == 1
    after = np.concatenate([[escaped], odd[:-1]]) if len(data) else np.zeros(0, bool)
    return (data == QUOTE) & ~after, bool(odd[-1]) if len(data) else escaped


def summary(data: np.ndarray) -> list[tuple[bool, bool, int]]:
    """For each state a range may begin in (within a string, first byte escaped): the state behind it and the change of depth."""
    out = []
    step = np.isin(data, OPENERS).astype(np.int64) - np.isin(data, CLOSERS)
    for inside in (False, True):
        for escaped in (False, True):
            quotes, next_escaped = _quotes(data, escaped)
            within = (np.cumsum(quotes) - quotes + inside) % 2 == 1
            out.append((bool((quotes.sum() + inside) % 2), next_escaped, int(step[~within].sum())))
    return out


def records(data: np.ndarray, end: int, inside: bool, escaped: bool, depth: int) -> Iterator[bytes]:
    """The objects of a top-level list that begin before ``end``; ``data`` has to reach to where the last of them closes."""
    quotes, _ = _quotes(data, escaped)
    within = (np.cumsum(quotes) - quotes + inside) % 2 == 1
    plain = ~within & ~quotes
    step = np.where(plain, np.isin(data, OPENERS).astype(np.int64) - np.isin(data, CLOSERS), 0)
    deep = depth + np.cumsum(step)
    # between the list's objects there are commas and blanks only; the list itself opens and closes once
    between = plain & (deep == 1) & (step == 0)
    odd = between & (data != COMMA) & ~np.isin(data, BLANKS) | (quotes & (deep == 1)) | ((deep == 2) & (step == 1) & (data != ord("{")))
    beyond = (deep < 1) & ~np.isin(data, BLANKS) & ~((deep == 0) & (data == ord("]")) & (step == -1))
    if (odd | beyond)[:end].any() or (depth == 0 and (deep == 1).any() and data[np.flatnonzero(deep == 1)[0]] != ord("[")):
        raise NoArray("Invalid JSON structure: expected a list of claims or an object with a 'claims' key")
    begins = np.flatnonzero((deep == 2) & (step == 1))
    ends = np.flatnonzero((deep == 1) & (step == -1))
    for a in begins[begins < end]:
        k = np.searchsorted(ends, a)
        if k == len(ends):
            raise NoArray("the list ends inside of an object")
        yield data[a : ends[k] + 1].tobytes()


def _summaries(batches):
    for batch in batches:
        for path, at, size in zip(*(c.to_pylist() for c in batch.columns)):
            store, name = _open(path)
            with store.open_input_file(name) as f:
                states = summary(np.frombuffer(f.read_at(size, at), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([json.dumps(states)])], ["path", "at", "states"])


def _objects(batches):
    for batch in batches:
        for path, at, size, inside, escaped, depth in zip(*(c.to_pylist() for c in batch.columns)):
            store, name = _open(path)
            with store.open_input_file(name) as f:
                total, more = f.size(), 1 << 16
                while True:  # until the last object that begins here has closed
                    reach = min(total, at + size + more)
                    try:
                        found = list(records(np.frombuffer(f.read_at(reach - at, at), np.uint8), size, inside, escaped, depth))
                        break
                    except NoArray as e:
                        if "ends inside" not in str(e) or reach == total:
                            raise
                        more *= 8
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in found[k : k + 10_000]], pa.string())], ["value"])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE) -> DataFrame:
    """The objects of a file, or of all files below a folder, that hold one JSON list each, as rows of ``schema``.

    Files are cut into ranges of ``range_bytes``, whose summaries (a line each) come to the driver between the two passes. Anything but a list of
    objects is an error; an object that isn't valid JSON or hasn't the types of ``schema`` has nulls, as in Spark's reader. Executors open the
    files themselves (local or shared paths, s3, gcs, hdfs); ``files.read_claims_json`` reads what only Spark's readers reach.
    """
    from pyarrow import fs

    store, name = _open(path)
    info = store.get_file_info(name)
    listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    prefix = path[: len(path.rstrip("/")) - len(name.rstrip("/"))] if path.rstrip("/").endswith(name.rstrip("/")) else ""
    ranges = [(prefix + f.path, at, min(range_bytes, f.size - at)) for f in listed if f.type == fs.FileType.File and f.base_name[:1] not in "._" for at in range(0, f.size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], schema)
    # a task takes ranges one after the other, up to about RANGE bytes of them
    tasks = min(len(ranges), max(spark.sparkContext.defaultParallelism, sum(size for _, _, size in ranges) // RANGE + 1))
    spread = lambda rows, kinds: spark.createDataFrame(rows, kinds).repartition(tasks, "path", "at")
    found = spread(ranges, "path string, at long, size long").mapInArrow(_summaries, "path string, at long, states string").collect()
    states = {(r.path, r.at): json.loads(r.states) for r in found}
    begun, behind = [], {}
    for file, at, size in sorted(ranges):
        inside, escaped, depth = behind.get(file, (False, False, 0))
        begun.append((file, at, size, inside, escaped, depth))
        after = states[file, at][2 * inside + escaped]
        behind[file] = after[0], after[1], depth + after[2]
    torn = [f for f, state in behind.items() if state != (False, False, 0)]
    if torn:
        raise NoArray(f"{torn[0]} ends inside of a list, an object or a string")
    text = spread(begun, "path string, at long, size long, inside boolean, escaped boolean, depth long").mapInArrow(_objects, "value string")
    return text.select(F.from_json("value", schema).alias("c")).select("c.*")

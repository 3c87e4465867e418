"""Words and hashes over UTF-8 bytes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
M64 = (1 << 64) - 1


def split_mix(x: np.ndarray) -> np.ndarray:
    """A mixing step after which every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space as bytes, and where each begins and ends in them."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return np.frombuffer(b" ".join(words), dtype=np.uint8), ends - lengths, ends


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind) if not pa.types.is_binary(column.type) else column:
        yield x.as_py()


class Buffer:
    """Collects arrays of equal length for the columns of an output and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 100_000):
        self.schema, self.rows, self.parts, self.size = schema, rows, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            arrays = [pa.array(np.concatenate(x)).cast(f.type) for x, f in zip(zip(*self.parts), self.schema)]
            for at in range(0, self.size, self.rows):
                yield pa.RecordBatch.from_arrays([a.slice(at, self.rows) for a in arrays], schema=self.schema)
        self.parts, self.size = [], 0

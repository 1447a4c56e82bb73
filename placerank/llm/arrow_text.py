"""Word codes of Arrow text batches, in slices of bounded size: the vectorised core of the Python-side operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20
#: Text bytes handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def bounded(df: DataFrame) -> DataFrame:
    """The table, once its session cuts Arrow batches at BATCH_BYTES: whole texts by the ten thousand do not fit a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as strings, nulls as empty texts.

    Offsets are rebased to 0: the ASCII kernels misread arrays that begin inside their data buffer."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), data)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` text bytes."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def split_pieces(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The strings of a list column and, for each, the row it is from."""
    offsets = np.asarray(lists.offsets)
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(offsets))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text: codes in order, the distinct words they stand for, and row starts
    (one more than rows)."""
    flat, row = split_pieces(pc.ascii_split_whitespace(texts))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        flat, row = flat.filter(pa.array(full)), row[full]
    coded = flat.dictionary_encode()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(texts)), out=starts[1:])
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, starts


def byte_counts(texts: pa.Array, of: bytes) -> np.ndarray:
    """How many bytes of each text are among `of` (ASCII characters)."""
    wanted = np.zeros(256, bool)
    wanted[list(of)] = True
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    hit = np.flatnonzero(wanted[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]) + ends[0]
    return np.diff(np.searchsorted(hit, ends)).astype(np.int64)

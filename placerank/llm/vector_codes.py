"""Vector code compression: product codes of integer vectors, trained and assigned by equal-average search.

Every vector is cut into equal consecutive parts, and each part position has a small codebook.  Training is a fixed number of
rounds over all vectors: tasks assign their parts and send up one sum per codebook entry, so a round moves
(tasks x entries) short rows and the driver holds the codebooks alone (`entries` vectors, a proven bound).  All arithmetic is on
integers, so the result does not depend on how the rows are dealt.

The search sorts a codebook's entries by the sum of their components.  Since (sum(x) - sum(y))^2 <= dimension * |x - y|^2, it
expands outward from the part's own sum and stops where the squared gap of the sums exceeds dimension times the best distance;
at equality it goes on, as that entry may tie and have a lower index.

Nulls, odd rows: a vector that is null, or holds a null or a non-finite component, is left out, as is one of another length than
the first kept vector (the smallest vec_id, nulls last).  Components beyond +-2^36 are read as +-2^36, and errors beyond 63 bits
are null.  If the parts do not divide the length, the last ones are shorter, possibly empty.  Equal vectors and repeated or null
vec_ids are rows of their own; of equal vec_ids the smaller vector seeds the codebooks first.  Fewer vectors than entries make
smaller codebooks; no vectors, an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded
from placerank.llm.common import attach_counted, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are cut off at this size, so that all sums stay exact.
LARGEST = 2.0**36
#: While the largest component times the length is below this, squares fit 64 bits; else Python's integers are used.
FAST = 2**30

Codebooks = list[list[list[int]]]


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers."""
    return np.floor(np.clip(values.astype(np.float64), -LARGEST, LARGEST) * SCALE).astype(np.int64)


def part_ends(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    size = -(-length // parts)
    return [(min(k * size, length), min((k + 1) * size, length)) for k in range(parts)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and its squared distance, for every row of integers.

    Step r looks at every row's entry with the r-th smallest gap of sums, which is what expanding to both sides reaches
    next; rows that have stopped are left out, and no later entry can be nearer for them."""
    wide = max(rows.shape[1], 1)
    if max((int(np.abs(m).max()) for m in (rows, entries) if m.size), default=0) * wide >= FAST:
        rows, entries = rows.astype(object), entries.astype(object)
    by_sum = np.argsort(entries.sum(axis=1), kind="stable")
    sums = entries.sum(axis=1)[by_sum]
    own = rows.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    index = np.full(len(rows), len(entries), np.int64)
    best = np.full(len(rows), -1, rows.dtype)
    live = np.arange(len(rows))
    last = len(sums) - 1
    for _ in range(len(entries)):
        l, r = left[live], right[live]
        down = own[live] - sums[np.maximum(l, 0)]
        up = sums[np.minimum(r, last)] - own[live]
        goes_left = (l >= 0) & ((r > last) | (down <= up))
        gap = np.where(goes_left, down, up)
        on = (best[live] < 0) | (gap * gap <= best[live] * wide)
        live, goes_left = live[on], goes_left[on]
        if not len(live):
            break
        at = by_sum[np.where(goes_left, left[live], right[live])]
        left[live[goes_left]] -= 1
        right[live[~goes_left]] += 1
        off = rows[live] - entries[at]
        far = (off * off).sum(axis=1) if off.shape[1] else np.zeros(len(live), rows.dtype)
        closer = (best[live] < 0) | (far < best[live]) | ((far == best[live]) & (at < index[live]))
        won = live[closer]
        best[won], index[won] = far[closer], at[closer]
    return index, best


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten()
    return to_integers(np.asarray(flat)).reshape(-1, length) if length else np.zeros((len(column), 0), np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], ends: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, index and squared distance of each part."""
    whole = _matrix(batch.column("embedding"), ends[-1][1])
    for (a, b), entries in zip(ends, books, strict=True):
        yield (whole[:, a:b], *nearest(whole[:, a:b], entries))


def _summing(books: list[np.ndarray], ends: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per part, entry and position with its sum and count, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, object) for e in books]
        counts = [np.zeros(len(e), np.int64) for e in books]
        for batch in batches:
            for k, (rows, at, _) in enumerate(_assigned(batch, books, ends)):
                for j in np.unique(at):
                    sums[k][j] += rows[at == j].sum(axis=0)
                    counts[k][j] += int((at == j).sum())
        found = [(k, j, [str(x) for x in sums[k][j]], int(counts[k][j])) for k in range(len(books)) for j in np.flatnonzero(counts[k]).tolist()]
        part, entry, total, n = zip(*found, strict=True) if found else ((), (), (), ())
        types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((part, entry, total, n), types, strict=True)], ["part", "entry", "total", "n"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    """Vector length and codebooks (part, entry, component) of all usable `vectors` (vec_id, embedding); -1 and none without any.

    Every round reads `vectors` once; pass a stored table."""
    kept = usable(vectors.select("vec_id", "embedding"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()
    if not first:
        return -1, []
    length = len(first[0].embedding)
    kept = kept.where(F.size("embedding") == length)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = to_integers(np.array([r.embedding for r in seeds], np.float64).reshape(len(seeds), length))
    ends = part_ends(length, parts)
    books = [start[:, a:b].copy() for a, b in ends]
    for _ in range(rounds):
        partial = bounded(kept.select("embedding")).mapInArrow(_summing(books, ends), "part int, entry int, total array<string>, n long")
        split = partial.select("part", "entry", "n", F.posexplode_outer("total").alias("position", "x"))
        split = split.groupBy("part", "entry", "position").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        for r in split.where("position is not null").collect():
            books[r.part][r.entry, r.position] = int(r.x) // r.n
    return length, [b.tolist() for b in books]


def codebook_digest(books: Codebooks) -> str:
    """Hex SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def encode(vectors: DataFrame, length: int, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over parts) of every usable vector."""
    ends = part_ends(max(length, 0), max(len(books), 1))
    tables = [np.array(b, np.int64).reshape(len(b), e - a) for b, (a, e) in zip(books, ends, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = [""] * batch.num_rows, np.zeros(batch.num_rows, object)
            for _, at, far in _assigned(batch, tables, ends):
                codes = [c + f"{j:02x}" for c, j in zip(codes, at.tolist(), strict=True)]
                error = error + far
            errors = pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), errors], ["vec_id", "label", "code", "error"])

    kept = usable(vectors.select("vec_id", "label", "embedding")).where(F.size("embedding") == length)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return bounded(kept).mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256 of all usable vectors
    (vec_id, embedding, label).  Sums of labels are partial aggregates; a hot label is a broadcast row."""
    length, books = train(vectors, parts, entries, rounds)
    rows = materialise(encode(vectors, length, books))
    sums = materialise(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("n")))
    rows = attach_counted(rows, sums, "label", "n")
    return rows.select(
        "vec_id", "code", "error", F.expr("try_cast(_sum as bigint)").alias("label_error"),
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )

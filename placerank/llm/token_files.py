"""Token ids as Parquet: list columns with delta encoding, small row groups, page indexes, and selective reads.

A file row is one document: doc_id, n_tokens, n_chars and the list `ids`.  Files are range-sorted by doc_id, so row-group
and page statistics let a reader skip to the documents it wants, and metadata is read without touching a token page.
"""

from __future__ import annotations

import itertools
import os
import string
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placerank.llm.arrow_text import bounded, slices, split_pieces, text_of
from placerank.llm.common import materialise, small
from placerank.session import ensure_checkpoint_dir

END = 2
#: Distinct words a worker remembers the ids of; then it starts afresh.
KNOWN = 600_000
#: Text bytes encoded at once.
SLICE = 2_000_000
#: Writer settings: data-page version 2 gives delta encoding of integers where no dictionary is used; a dictionary is
#: kept for the ids until it outgrows its page; row groups of 16 MB and pages of 64 kB keep selective reads small.
WRITER = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10), "parquet.column.index.access": "true", "compression": "zstd",
}


#: Letters that end in a combining mark once they are normalised and lowered; it shares a piece with what follows.
MARKED = "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum())


def without_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without the ASCII marks at their end, and these marks, if a letter or number stands before them: there the
    tokenizer's pieces part, so both can be looked up alone."""
    head = pc.ascii_rtrim(words, string.punctuation)
    whole, kept = np.asarray(pc.binary_length(words)).astype(np.int64), np.asarray(pc.binary_length(head)).astype(np.int64)
    parts = kept < whole
    ended = head.filter(pa.array(parts))
    parts[parts] = np.asarray(pc.match_substring_regex(ended, r"[\p{L}\p{N}]$")) & ~np.asarray(pc.match_substring_regex(ended, f"[{MARKED}]$"))
    parts &= ~np.asarray(pc.match_substring(words, "<|"))  # may be a special token, which is one piece
    head = pc.if_else(pa.array(parts), head, words)
    count = np.where(parts, whole - kept, 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    _, offsets, data = words.buffers()
    first = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words)] + kept
    marks = np.frombuffer(data, np.uint8)[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.uint8)
    return head, pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(marks.tobytes()))


#: One per worker process and tokenizer file; tasks that follow each other share it.
_WORKER: dict[str, WordIds] = {}


#: Random factors of a word's bytes by their place, for `hashes`.
FACTORS = np.random.default_rng(6).integers(1, 1 << 63, 4_096, np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words by their lengths and first 4,096 bytes; the empty word's is 0."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    out = np.diff(ends).astype(np.uint64) * FACTORS[-1]
    for low in range(0, len(words), 100_000):  # sums of so many words exist at once
        start, end = ends[low : low + 100_001][:-1], ends[low : low + 100_001][1:]
        size = np.minimum(end - start, len(FACTORS))
        done = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(done[-1]) - np.repeat(done[:-1], size)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum((raw[np.repeat(start, size) + place] + np.uint64(1)) * FACTORS[place], out=sums[1:])
        out[low : low + 100_000] += sums[done[1:]] - sums[done[:-1]]
    return out


class WordIds:
    """Ids of ASCII-space separated words by a tokenizer that drops white space: a worker encodes a word, without the
    marks at its end, once while it remembers it.

    White space never joins two words here: the tokenizer's pieces contain none, and no normalisation crosses a blank.
    As the tokenizer lower-cases, A-Z are lowered first unless a text may hold the name of a special token."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would hold memory of its own
        self.tokenizer = Tokenizer.from_file(file)
        #: Which ids close a piece, if the model marks the end of pieces and no letters alone are a special token.
        self.closing = None
        #: Encodes words of a-z by the model alone, if the tokenizer leaves these letters as they are, in one piece.
        self.plain = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and not any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            size = self.tokenizer.get_vocab_size()
            self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
            letters, normal, parted = string.ascii_lowercase, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            if parted and (not normal or normal.normalize_str(letters) == letters) and [w for w, _ in parted.pre_tokenize_str(letters)] == [letters]:
                self.plain = Tokenizer(self.tokenizer.model)
                self.plain.pre_tokenizer = WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        """Know the empty word alone: the words by number, and their numbers by ascending hash."""
        self.known = pa.array([""], pa.large_string())
        self.hashed, self.number = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and their counts; a few thousand encodings exist at once."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def _together(self, words: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, as one text: each is one piece, so the ids that close pieces part them."""
        tokenizer = self.plain if plain and self.plain else self.tokenizer
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py()
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:
            return self._one_by_one(words)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, new: pa.Array) -> None:
        """Append the new words, numbered in this order, and their ids."""
        letters = np.asarray(pc.utf8_is_alpha(new)) & (self.closing is not None)
        plain = letters & np.asarray(pc.ascii_is_alpha(new)) & np.asarray(pc.ascii_is_lower(new))
        order = np.argsort(2 - letters.astype(np.int8) - plain, kind="stable")
        ordered, cuts = new.take(pa.array(order)), [0, int(plain.sum()), int(letters.sum()), len(new)]
        ids, counts = [self.ids], []
        for (low, high), encode in zip(itertools.pairwise(cuts), (partial(self._together, plain=True), self._together, self._one_by_one), strict=True):
            for at in range(low, high, 2_000):
                got, n = encode(ordered.slice(at, min(2_000, high - at)))
                ids.append(got)
                counts.append(n)
        count, first = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        count[order] = done = np.concatenate(counts)
        first[order] = len(self.ids) + np.cumsum(done) - done
        self.ids, self.first, self.count = np.concatenate(ids), np.append(self.first, first), np.append(self.count, count)
        self.known = pa.concat_arrays([self.known, new])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words.  A word is known if it equals the one found by its hash; of two with one hash
        the other is learned anew each time."""
        if len(self.known) > KNOWN:
            self._forget()
        hashed = hashes(words)
        order = np.argsort(hashed)
        hashed = hashed[order]
        at = np.searchsorted(self.hashed, hashed)
        numbers = np.empty(len(words), np.int64)
        numbers[order] = self.number[np.minimum(at, len(self.number) - 1)]
        new = ~np.asarray(pc.equal(self.known.take(pa.array(numbers)), words))
        if new.any():
            numbers[new] = len(self.known) + np.arange(np.count_nonzero(new))
            self._learn(words.filter(pa.array(new)))
            late = new[order]
            self.hashed = np.insert(self.hashed, at[late], hashed[late])
            self.number = np.insert(self.number, at[late], numbers[order][late])
        return numbers

    def _pool(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, concatenated, and where each begins: those of its head, then of its marks."""
        coded = pa.concat_arrays(without_marks(distinct)).dictionary_encode()
        at = self._numbers(coded.dictionary)[np.asarray(coded.indices)].reshape(2, -1).T.ravel()
        start, count = self.first[at], self.count[at]
        done = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(start - done[:-1], count) + np.arange(done[-1])], done[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order with END after each row, and ids per row."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        flat, row = split_pieces(pc.ascii_split_whitespace(texts))
        coded = flat.dictionary_encode()
        pool, starts = self._pool(coded.dictionary)
        at = np.asarray(coded.indices)
        start, count = starts[at], np.diff(starts)[at]
        n = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64) + 1
        ends = np.cumsum(n) - 1
        out = np.empty(int(n.sum()), np.int32)
        word = np.ones(len(out), bool)
        word[ends] = False
        done = np.cumsum(count)
        source = np.repeat(start - (done - count), count)
        source += np.arange(len(source))
        out[word] = pool[source]
        out[ends] = END
        return out, n


def worker_ids(file: str) -> WordIds:
    if file not in _WORKER:
        _WORKER[file] = WordIds(file)
    return _WORKER[file]


def encode_texts(docs: DataFrame, file: str, keep: str = "doc_id") -> DataFrame:
    """`keep`, n_tokens, n_chars and ids of every row, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_ids(file)
        for whole in batches:
            for part in slices(whole, limit=SLICE):
                texts = text_of(part)
                ids, n = words.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                key = part.column(part.schema.get_field_index(keep))
                chars = pc.cast(pc.utf8_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([key, pa.array(n), chars, lists], [keep, "n_tokens", "n_chars", "ids"])

    picked = docs.select(F.col(keep).cast("long"), F.col("text").cast("string"))
    return bounded(picked).mapInArrow(run, f"{keep} long, n_tokens long, n_chars long, ids array<int>")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def write_tokens(docs: DataFrame, path: str, file: str) -> None:
    """Range-sort by doc_id (nulls first), encode, and write; each task writes one sorted file."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    writer = encode_texts(ordered, file).write
    for k, v in WRITER.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, n_chars: no token page is read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens", "n_chars")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id and ids, of documents low <= doc_id < high if given (row groups and pages outside are skipped)."""
    df = spark.read.parquet(path).select("doc_id", "ids")
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    return df.where(F.col("doc_id") < high) if high is not None else df


def token_checks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and ids_crc32 of what the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten(), np.dtype("<u4")), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b]) for a, b in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    return bounded(read_tokens(spark, path)).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`: n_tokens of all rows before, in order of doc_id (nulls first, ties by crc, equal ones arbitrary).

    The rows are cut loose first, since range partitioning reads its input twice.  They are range-partitioned, numbered by their partition, and summed inside it; partition totals are few."""
    key = [F.col("doc_id").asc_nulls_first(), F.col("ids_crc32"), F.col("n_tokens")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(materialise(rows).repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("n_tokens").alias("_n"))  # one row for each of `parts`
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_part", ahead.alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    done = placed.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(small(totals), "_part")
    return done.withColumn("start", F.col("_ahead") + F.col("_inside")).drop("_part", "_ahead", "_inside")


def token_table(docs: DataFrame, file: str) -> DataFrame:
    """Write the token files of `docs` to a fresh shared folder and report, from them: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id alone; repeated rows are written as often as they occur; an empty table
    gives an empty report."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_tokens(docs, path, file)
    return with_starts(token_checks(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Phrase collocation mining with stripes.

A stripe belongs to a prefix (of a language) and counts the words that follow it; the empty prefix counts the words themselves, and
its total, all words, is one more entry.  Tasks build stripes of a slice of texts with array operations and cut them into shares by a
hash of (language, prefix, next word), so that a prefix before half of all words is no hot group; Spark brings equal shares together,
where they are merged entry by entry.  One such table
serves everything: an entry is the count of a phrase and the total of the stripe of which the phrase is the prefix, so it also says
how often first and last parts occur; the largest extensions to the right (the stripe of a phrase) and to the left (entries whose
prefix begins one word earlier) say which phrases are subsumed.

Prefixes grow word by word, and a phrase can only reach the least count if both phrases of one word less do.  Most phrases of a level
are rare even so, hence two steps: tasks first count hashes of phrases, packed as sorted runs of a few bytes an entry, and only
phrases whose hash reaches the least count are put into stripes and counted by their words.  A hash may stand for several phrases,
so it loses none.  The hashes that passed go to the tasks as a Bloom filter of bounded size, which only saves work too: what it lets
through by mistake falls to the least count later.

Nulls, odd rows: null and blank texts have no words; a null language is `und`.  Every row counts, repeated ones too.  A word may be
as long as its text.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded, slices, text_of
from placerank.llm.common import materialise, small

LEAST_COUNT, LONGEST, TOP = 100, 5, 2000
#: Bits of the filter for one phrase, and in all (16 MB): beyond 8 million phrases it lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 27
UNKNOWN = "und"

_PIECE_END, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True


def piece_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts in order: codes, the distinct words they stand for, the number of the piece and of
    the text that each is in."""
    ended = pc.binary_join_element_wise(pc.ascii_lower(texts), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, offsets, data = ended.buffers()
    ends = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]]
    border = _PIECE_END[raw]
    inside = ~(border | _BLANK[raw])
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=lengths[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(raw[inside]))
    coded = words.dictionary_encode()
    piece = np.cumsum(border)[starts]
    row = np.searchsorted(ends, starts, side="right") - 1
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, piece, row


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its prefix and of its last word."""
    with np.errstate(over="ignore"):
        mixed = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
        return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes >> np.uint64(5)) & mask, (hashes >> np.uint64(35)) & mask


def _spread(hashes: np.ndarray, kept: int) -> np.ndarray:
    """The lowest `kept` bits of hashes, mixed over all 64."""
    return longer(hashes & np.uint64((1 << kept) - 1), np.uint64(kept))


class Seen:
    """A Bloom filter with two places for each hash, of which the lowest `kept` bits count."""

    def __init__(self, words: np.ndarray, kept: int):
        self.words, self.kept = words, kept

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), bool)
        for at in _slots(_spread(hashes, self.kept), 64 * len(self.words)):
            hit &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit


def _filter(hashes: DataFrame, column: str, kept: int) -> Seen:
    """The filter of a column of hashes, of which the lowest `kept` bits count; at most the filter itself reaches the driver."""
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (BITS_EACH * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_slots(_spread(np.asarray(batch.column(column)).view(np.uint64), kept), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bit"]
            )

    found = hashes.select(column).mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[found.slot.to_numpy(np.int64)] = found.bit.to_numpy(np.int64).view(np.uint64)
    return Seen(words, kept)


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of single words (lang, phrase)."""
    for batch in batches:
        hashes = longer(word_hashes(batch.column("lang").cast(pa.large_string())), word_hashes(batch.column("phrase").cast(pa.large_string())))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])


class Phrases:
    """The words of a slice of texts, and the hashes of the phrases that begin at each."""

    def __init__(self, part: pa.RecordBatch):
        self.codes, self.words, self.piece, row = piece_words(text_of(part))
        langs = part.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, np.asarray(langs.indices).astype(np.int64)[row]
        if len(self.codes):
            self.by_word = word_hashes(self.words)
            self.known = {1: (longer(word_hashes(self.langs.cast(pa.large_string()))[self.lang], self.by_word[self.codes]), np.ones(len(self.codes), bool))}

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the `size` words from each position but the last, and whether one piece has them all."""
        if size not in self.known:
            before, ok = self.hashes(size - 1)
            k = size - 1
            self.known[size] = longer(before[:-1], self.by_word[self.codes[k:]]), ok[:-1] & (self.piece[k:] == self.piece[: len(self.piece) - k])
        return self.known[size]


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Ascending keys as the bytes of their gaps, all first bytes before all second ones, then the counts likewise."""

    def planes(values: np.ndarray) -> tuple[int, bytes]:
        wide = max(1, (int(values.max()).bit_length() + 7) // 8)
        return wide, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()

    wide, gaps = planes(np.diff(keys, prepend=np.uint64(0)))
    return wide, gaps + planes(counts)[1]


def unpack(n: int, wide: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, n)

    def values(rows: np.ndarray) -> np.ndarray:
        return sum((r.astype(np.uint64) << np.uint64(8 * k) for k, r in enumerate(rows)), np.zeros(n, np.uint64))

    return np.cumsum(values(raw[:wide]), dtype=np.uint64), values(raw[wide:])


def _counted(phrases: Phrases, size: int, seen: Seen, kept: int, buckets: int) -> pa.RecordBatch | None:
    """Packed counts of the hashes of all phrases whose first and last size - 1 words may be frequent, by range of hashes."""
    if len(phrases.codes) < size:
        return None
    before, _ = phrases.hashes(size - 1)
    hashes, ok = phrases.hashes(size)
    may = seen(before)
    keys, counts = np.unique(hashes[ok & may[:-1] & may[1:]] & np.uint64((1 << kept) - 1), return_counts=True)
    if not len(keys):
        return None
    step = kept - (buckets.bit_length() - 1)
    owner = (keys >> np.uint64(step)).astype(np.int64)
    rows = []
    borders = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        rows.append((int(owner[a]), b - a, *pack(keys[a:b] - np.uint64(int(owner[a]) << step), counts[a:b])))
    return _row_batch(**{c: pa.array(v) for c, v in zip(("bucket", "n", "wide", "packed"), zip(*rows, strict=True), strict=True)})


_COLUMNS = {
    "share": pa.int32(), "lang": pa.list_(pa.string()), "prefix": pa.list_(pa.string()), "next": pa.list_(pa.string()), "count": pa.list_(pa.int64()),
    "bucket": pa.int32(), "n": pa.int32(), "wide": pa.int32(), "packed": pa.binary(),
}
_PASS = "share int, lang array<string>, prefix array<string>, next array<string>, count array<long>, bucket int, n int, wide int, packed binary"


def _row_batch(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in _COLUMNS.items()], list(_COLUMNS))


def _striped(phrases: Phrases, size: int, whole: Seen | None, shares: int) -> pa.RecordBatch | None:
    """Stripes of prefixes of size - 1 words in shares: language, prefix, next word and count of every entry.

    `whole` says which phrases may be frequent; single words all are counted, and their total has no next word."""
    codes, words, lang = phrases.codes, phrases.words, phrases.lang
    if len(codes) < size:
        return None
    hashes, ok = phrases.hashes(size)
    at = np.flatnonzero(ok)
    if size > 1:
        at = at[whole(hashes[at])]
    if not len(at):
        return None
    heads = codes[at] if size > 1 else np.zeros(len(at), np.int64)
    for k in range(1, size - 1):
        heads = np.unique(heads * len(words) + codes[at + k], return_inverse=True)[1]
    # one number for (language, prefix); `first` is a position where it stands
    _, first, head = np.unique(heads * len(phrases.langs) + lang[at], return_index=True, return_inverse=True)
    pair, where, count = np.unique(head * len(words) + codes[at + size - 1], return_index=True, return_counts=True)
    begin = at[first]
    prefix = pa.array([""] * len(first), pa.large_string())
    for k in range(size - 1):
        prefix = pc.binary_join_element_wise(prefix, words.take(pa.array(codes[begin + k])), pa.scalar(" " if k else "", pa.large_string()))
    share = ((hashes[at[where]] >> np.uint64(23)) & np.uint64(shares - 1)).astype(np.int64)
    owner, follows = pair // len(words), pair % len(words)
    last = pa.array(follows)
    if size == 1:  # the totals come after the entries
        many = len(first)
        own = (word_hashes(phrases.langs)[lang[begin]] & np.uint64(shares - 1)).astype(np.int64)
        share, owner, count = np.append(share, own), np.append(owner, np.arange(many)), np.append(count, np.bincount(head))
        last = pa.array([*follows.tolist(), *[None] * many], pa.int64())
    order = np.argsort(share, kind="stable")
    share = share[order]
    starts = np.flatnonzero(np.diff(share, prepend=-1))
    cut = pa.array(np.append(starts, len(share)), pa.int32())
    take = lambda values: pa.ListArray.from_arrays(cut, values.take(pa.array(order)).cast(pa.string()))
    return _row_batch(
        share=pa.array(share[starts]),
        lang=take(phrases.langs.take(pa.array(lang[begin][owner]))),
        prefix=take(prefix.take(pa.array(owner))),
        next=take(words.take(last)),
        count=pa.ListArray.from_arrays(cut, pa.array(count[order], pa.int64())),
    )


def _merged(rows: DataFrame, size: int, least: int) -> DataFrame:
    """The stripes of all tasks, merged share by share: lang, prefix, next, n (`least` and more, or a total), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "prefix", "next"]
        pending, waiting = [], 0

        def joined() -> pa.Table:
            table = pa.concat_tables(pending).group_by(names).aggregate([("n", "sum")])
            return table.select([*names, "n_sum"]).rename_columns([*names, "n"])

        for batch in batches:
            part = pa.table({c: batch.column(c).flatten() for c in names} | {"n": batch.column("count").flatten()})
            pending.append(part)
            waiting += part.num_rows
            if waiting > 500_000 + 2 * pending[0].num_rows:
                pending, waiting = [joined()], 0
        if pending:
            table = joined()
            table = table.filter(pc.or_(pc.is_null(table["next"]), pc.greater_equal(table["n"], least)))
            yield from table.to_batches(max_chunksize=10_000)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = rows.where("share is not null").select("share", "lang", "prefix", "next", "count").repartition(parts, "share")
    return materialise(bounded(shares).mapInArrow(run, "lang string, prefix string, next string, n long").withColumn("size", F.lit(size)))


def _look(
    stripe_size: int, count_size: int, seen: list[Broadcast | None], kept: int, buckets: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One look at the texts: stripes of phrases of one size and packed counts of another (0: none).  `seen[k]` filters phrases
    of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda k: seen[k].value if 0 < k < len(seen) else None
        for batch in batches:
            for part in slices(batch):
                phrases = Phrases(part)
                if stripe_size and (rows := _striped(phrases, stripe_size, at(stripe_size), buckets)):
                    yield rows
                if count_size and (rows := _counted(phrases, count_size, at(count_size - 1), kept, buckets)):
                    yield rows

    return run


def _frequent(packed: DataFrame, kept: int, buckets: int, least: int) -> DataFrame:
    """Hashes whose packed counts sum up to `least`; a bucket holds one range of hashes, merged as its runs arrive."""
    step = kept - (buckets.bit_length() - 1)

    def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in runs]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([c for _, c in runs]), minlength=len(keys)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, waiting = [], 0
        for batch in batches:
            for bucket, n, wide, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "wide", "packed")), strict=True):
                keys, counts = unpack(n, wide, data)
                runs.append((keys + np.uint64(bucket << step), counts))
                waiting += n
                if waiting > 2_000_000 + 2 * len(runs[0][0]):
                    runs, waiting = [merged(runs)], 0
        if runs:
            keys, counts = merged(runs)
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= least].view(np.int64))], ["hash"])

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.where("bucket is not null").select("bucket", "n", "wide", "packed").repartition(parts, "bucket")
    return materialise(bounded(rows).mapInArrow(run, "hash long"))


def stripes(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """Merged stripes of all prefixes of up to longest - 1 words: lang, prefix, next (null: all words), size (of the phrase), n.

    Entries under `least` are left out, but counted among all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    buckets = 1 << (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    levels = [_merged(bounded(texts).mapInArrow(_look(1, 0, [], 0, buckets), _PASS), 1, least)]
    single = levels[0].where("next is not null").select("lang", phrase_of().alias("phrase"))
    if longest < 2 or single.isEmpty():
        return levels[0]
    every = levels[0].where("next is null").agg(F.sum("n")).first()[0]
    kept = min(62, max(every.bit_length() + 4, buckets.bit_length() + 8))  # bits of a hash: 16 times the phrases there can be
    seen = [None, spark.sparkContext.broadcast(_filter(single.mapInArrow(_word_keys, "hash long"), "hash", 64))]
    rows = bounded(texts).mapInArrow(_look(0, 2, seen, kept, buckets), _PASS)
    for size in range(2, longest + 1):
        hashes = _frequent(rows, kept, buckets, least)
        if hashes.isEmpty():
            break
        seen.append(spark.sparkContext.broadcast(_filter(hashes, "hash", kept)))
        rows = materialise(bounded(texts).mapInArrow(_look(size, size + 1 if size < longest else 0, seen, kept, buckets), _PASS))
        levels.append(_merged(rows, size, least))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def phrase_of():
    """The phrase of an entry."""
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of every language of `docs` (text, lang).

    A phrase of 2 to `longest` words that occurs a >= `least` times scores floor(1000 a n / (l r)) at its weakest cut into
    parts that occur l and r times, n being all words of the language.  Products are decimals of 38 digits.  A phrase inside
    a longer one that occurs as often is left out; if any longer phrase does, so does one of a single word more."""
    table = stripes(docs, least, longest)
    words = table.where("size = 1 and next is null").select("lang", F.col("n").alias("words"))
    totals = small(table.where(F.col("next").isNotNull() & (F.col("size") < longest)).select("lang", phrase_of().alias("part"), F.col("n").alias("occurs")))
    found = table.where("size > 1 and next is not null").select("lang", "prefix", "next", "size", phrase_of().alias("phrase"), F.col("n").alias("a"))
    w = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.concat_ws(" ", F.slice(w, 1, F.col("k")))).withColumn("right", F.concat_ws(" ", F.slice(w, F.col("k") + 1, F.col("size") - F.col("k"))))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(totals.select("lang", F.col("part").alias(side), F.col("occurs").alias(count)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(words) if words.count() <= 10_000 else words, "lang")
    top_side = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * wide("words")).cast("decimal(38,0)")
    cuts = cuts.withColumn("_top", top_side).withColumn("_down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = cuts.withColumn("score", F.expr("_top div _down")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("words").alias("n")
    )
    right = found.where("size > 2").select("lang", F.col("prefix").alias("phrase"), "a")
    left = found.where("size > 2").select("lang", F.concat_ws(" ", F.slice(w, 2, F.col("size") - 1)).alias("phrase"), "a")
    inside = right.union(left).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))

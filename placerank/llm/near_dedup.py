"""Near-duplicates by fast similarity sketches, banding and exact verification.

A sketch has `t` coordinates.  In round i each shingle hashes to a bin and to the value i + u with u in [0, 1); a bin
keeps its minimum.  In rounds t to 2t - 1 bin i - t is hit by every shingle, so every coordinate is filled, and rounds stop
as soon as all are: a large text needs one round, a short one about t log t / size.  Two sketches agree in a coordinate with
the probability of the sets' similarity, and the number of agreements is concentrated as for independent hashes.

Equal sets are one class.  Sketches of classes are cut into bands of rows; classes with an equal band are candidates.  In
each bucket all candidates are first compared with a few central classes in turn; the links found are contracted, and only
classes of a bucket that are still in different components are compared with each other.  So no component is lost against the
banding, and a group of n near copies costs about n comparisons.  With 48 bands of 6 rows a pair at similarity 0.8 shares no band with
probability 5e-7.  Every link is confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded, slices, text_of, word_codes
from placerank.llm.common import materialise
from placerank.llm.graph import components

BANDS, ROWS, SHINGLE, SIMILARITY = 48, 6, 2, 80
#: Rounds in which buckets are compared with one hub each, before what is left is compared in full.
ROUNDS = 2
#: Classes from which on a component counts as large, and bytes of shingle sets that are compared at once.
LARGE, BLOCK_BYTES = 8, 1 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit words (splitmix)."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, concatenated, and row starts.

    A-Z are lower-cased; a text with fewer words than `size` has its whole sequence as its only shingle."""
    import xxhash

    codes, distinct, starts = word_codes(pc.ascii_lower(texts))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
    word = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(starts)
    first = np.repeat(starts[:-1], np.maximum(n - size + 1, np.minimum(n, 1)))
    row = np.repeat(np.arange(len(texts)), np.maximum(n - size + 1, np.minimum(n, 1)))
    count = np.bincount(row, minlength=len(texts))
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    last = starts[row + 1]
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        there = here < last
        out = mixed(out + np.where(there, word[np.minimum(here, max(0, len(word) - 1))], np.uint64(k))) if len(at) else out
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(texts)), out=ends[1:])
    return out, ends


def sketches(sets: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of every non-empty set, t values each; rows of empty sets are left unfilled."""
    rows = len(starts) - 1
    owner = np.repeat(np.arange(rows), np.diff(starts))
    found = np.full(rows * t, FULL, np.uint64)
    values = sets
    for i in range(2 * t):
        if not len(values):
            break
        h = mixed(values + np.uint64(i * int(MIX[1]) & (1 << 64) - 1))
        to = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(found, owner * t + to, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        if i < 4 or i % 4 == 0:
            gaps = (found.reshape(rows, t) == FULL).any(1)[owner]
            values, owner = values[gaps], owner[gaps]
    return found.reshape(rows, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each sketch; equal keys of different bands do not meet."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands))
    for k in range(rows):
        key = mixed(key * MIX[2] + parts[:, :, k])
    return key.view(np.int64)


def sketch_documents(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, node (hash of the whole set; null if empty) and band keys."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, starts = shingle_sets(text_of(part), size)
                n = np.diff(starts)
                node = [xxhash.xxh64_intdigest(sets[a:b]) - (1 << 63) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
                keys = band_keys(sketches(sets, starts, bands * rows), bands, rows)
                full = n > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(node, pa.int64()), lists], ["doc_id", "mark", "n_shingles", "node", "bands"]
                )

    rows_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("mark"))
    return bounded(rows_).mapInArrow(run, "doc_id long, mark long, n_shingles long, node long, bands array<long>")


def class_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node and its full set (packed 64-bit hashes) for the classes (node, doc_id, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, starts = shingle_sets(text_of(part), size)
                packed = [sets[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["node", "members"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_m"), F.col("text").cast("string").alias("text"))
    texts = keyed.join(classes, (F.col("_d").eqNullSafe(F.col("doc_id"))) & (F.col("_m") == F.col("mark"))).select("node", "text")
    return bounded(texts).mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose sets have 100 * intersection >= similarity * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                hit[i] = 100 * shared >= similarity * (len(both) - shared)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(hit))

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", "set_a", "set_b")
    return bounded(joined).mapInArrow(run, "a long, b long, la long, lb long")


def pairs_of(rows: DataFrame, a: str, b: str, tested: DataFrame | None, similarity: int) -> DataFrame:
    """Distinct pairs of nodes `a` and `b` (with sizes a_n, b_n and labels a_label, b_label) that could still be a new link."""
    fits = (F.col(f"{a}_label") != F.col(f"{b}_label")) & (100 * F.least(f"{a}_n", f"{b}_n") >= similarity * F.greatest(f"{a}_n", f"{b}_n"))
    pairs = rows.where(fits).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.least(f"{a}_label", f"{b}_label").alias("la"), F.greatest(f"{a}_label", f"{b}_label").alias("lb")
    )
    pairs = pairs.dropDuplicates(["a", "b"])
    return materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))


def class_links(live: DataFrame, sets: DataFrame, similarity: int, rounds: int) -> DataFrame:
    """Links (a, b) between classes that suffice for the components, from the buckets (band, node, n, score).

    In each round the most central class of a bucket that has not been its hub yet is compared with the members of other
    components; the links are contracted, and buckets of one component are done.  What is mixed after the rounds is
    compared across components in full: all classes that share a bucket with a large component against it and each other."""
    open_ = live.select("band", "node", "n", "score", F.col("node").alias("label"), F.lit(False).alias("was"))
    links, tested = live.sparkSession.createDataFrame([], "a long, b long"), None
    for _ in range(rounds):
        hub = open_.where("not was").groupBy("band").agg(F.max(F.struct("score", "node", "n", "label")).alias("h"))
        hub = hub.select("band", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label"))
        joined = open_.join(hub, "band")
        pairs = pairs_of(joined.select("hub", "hub_n", "hub_label", "node", F.col("n").alias("node_n"), F.col("label").alias("node_label")), "hub", "node", tested, similarity)
        found = materialise(confirm(pairs, sets, similarity))
        links = links.union(found.select("a", "b"))
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        open_ = joined.withColumn("was", F.col("was") | (F.col("node") == F.col("hub"))).select("band", "node", "n", "score", "label", "was")
        if not found.isEmpty():
            merged = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
            open_ = open_.join(merged, "label", "left").select("band", "node", "n", "score", F.coalesce("to", "label").alias("label"), "was")
        open_ = materialise(open_)
        mixed_ = open_.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(~F.col("was")).alias("left")).where("lo <> hi and left")
        open_ = materialise(open_.join(mixed_.select("band"), "band"))
        if open_.isEmpty():
            return links
    # what no hub has joined: in buckets of small components by pairs; in buckets with a large one the others are compared
    # with it and with each other in blocks
    count = open_.select("label", "node").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    open_ = materialise(open_.join(count, "label"))
    large = open_.where(F.col("c") >= LARGE).select("band", F.col("label").alias("of"), F.col("c").alias("of_c")).distinct()
    few = open_.join(large.select("band").distinct(), "band", "left_anti")
    x = few.select("band", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label"))
    y = few.select("band", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"))
    cross = x.join(y, "band").where(F.col("x_label") < F.col("y_label"))
    links = links.union(confirm(pairs_of(cross, "x", "y", tested, similarity), sets, similarity).select("a", "b"))
    behind = (F.col("c") < F.col("of_c")) | ((F.col("c") == F.col("of_c")) & (F.col("label") < F.col("of")))
    query = materialise(open_.join(large, "band").where((F.col("label") != F.col("of")) & behind).select("of", "node").distinct())
    members = open_.where(F.col("c") >= LARGE).select(F.col("label").alias("of"), "node").distinct().union(query)
    return links.union(block_links(query, members, sets, similarity))


def blocks_of(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The sets of (of, node) rows packed per `of` into blocks of about BLOCK_BYTES, dealt by a hash of the node."""
    full = rows.join(sets, "node")
    total = full.groupBy("of").agg(F.sum(F.length("members") + 64).alias("bytes"))
    dealt = full.join(total, "of").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("bytes") / BLOCK_BYTES)))
    return dealt.groupBy("of", "block").agg(F.collect_list(F.struct("node", "members")).alias(name)).drop("block")


def block_links(query: DataFrame, members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of the query nodes of each component `of` with all of its members, block by block.

    A pair of blocks is one row, whatever it holds; intersections are counted over the members' inverted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, m in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([r["node"].as_py() for r in m], np.int64)
                packed = [np.frombuffer(r["members"].as_buffer(), np.uint64) for r in m]
                value, owner = np.concatenate(packed), np.repeat(np.arange(len(ids)), [len(v) for v in packed])
                order = np.argsort(value, kind="stable")
                value, owner = value[order], owner[order]
                size = np.array([len(v) for v in packed])
                a, b = [], []
                for r in q:
                    own = np.frombuffer(r["members"].as_buffer(), np.uint64)
                    lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                    n = hi - lo
                    at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                    shared = np.bincount(owner[at], minlength=len(ids))
                    near = ids[100 * shared >= similarity * (size + len(own) - shared)]
                    a += [r["node"].as_py()] * len(near)
                    b += near.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = blocks_of(query, sets, "q").join(blocks_of(members, sets, "m"), "of").select("q", "m")
    return bounded(met).mapInArrow(run, "a long, b long")


def linked_classes(docs: DataFrame, bands: int, rows: int, size: int, similarity: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and the smallest member (doc_id, mark; null ids last) and component label of every class of equal sets."""
    slim = materialise(sketch_documents(docs, bands, rows, size))
    full = slim.where("node is not null")
    # one row per class; its bands are those of any member, since equal sets have equal sketches
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = full.groupBy("node").agg(F.min(at).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("node", "at.doc_id", "at.mark", "n", "bands"))
    keys = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    live = materialise(keys.join(shared, "band").select("band", "node", "n", "k"))
    central = live.groupBy("node").agg(F.sum("k").alias("score"))  # the text that copies were made from is in large buckets
    live = materialise(live.join(central, "node").select("band", "node", "n", "score"))
    ids = live.select("node").distinct().join(classes.select("node", "doc_id", "mark"), "node")
    sets = materialise(class_sets(docs, ids, size))
    labels = components(class_links(live, sets, similarity, rounds))
    return slim, classes.join(labels, "node", "left").select("node", "doc_id", "mark", F.coalesce("label", "node").alias("label"))


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, similarity: int = SIMILARITY, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept for every row.

    Null and blank texts have an empty set and are linked with nothing.  Repeated rows with one doc_id are one document
    and share its verdict; null doc_ids are linked like others but never name a component unless all of it is null."""
    slim, named = linked_classes(docs, bands, rows, size, similarity, rounds)
    full = slim.where("node is not null")
    # the classes' components name their smallest document
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.select("node", "label").join(smallest, "label").select("node", "component_id"))
    rows_ = full.select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    rows_ = rows_.union(slim.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows_.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """The columns of `docs`, the smallest row of each component by doc_id (null ids last) and text hash.

    Texts are told apart by (doc_id, hash of the text), so rows without id and texts that share an id each have the verdict
    of their own text.  Null and blank texts are linked with nothing: one row stays for each doc_id and text, and every row
    without id."""
    _, named = linked_classes(docs, BANDS, ROWS, size, SIMILARITY, ROUNDS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("at")
    verdict = named.groupBy("label").agg(first).select(F.col("at.doc_id").alias("_kept"), F.col("at.mark").alias("_kept_mark"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"]).alias("_mark"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("_full"),
    )
    full = rows.where("_full").join(verdict, F.col("_doc").eqNullSafe(F.col("_kept")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi")
    blank = rows.where("not _full")
    once = full.union(blank.where("_doc is not null")).dropDuplicates(["_doc", "_mark"])
    return once.select("_row.*").union(blank.where("_doc is null").select("_row.*"))

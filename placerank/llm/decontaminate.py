"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

A benchmark item is the multiset of its `size`-word shingles (fewer words: the whole sequence as one); m is their number.
A window of m shingles of a document can reach similarity s = sum(min)/sum(max) of the multiplicities only if at least s * m
of its shingles belong to items of that length, and it loses nothing if it begins at such a shingle; so windows are cut at
these anchors where they are dense enough.  Every window and item gets a 64-bit SimHash, each occurrence of a shingle
voting once.  The 64 bits are cut into radius + 1 blocks: two fingerprints within the radius agree in a whole block, so a
join on (length, block, value) misses none of them.  What is within the radius is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import materialise, small

SIZE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Rows up to which the table of benchmark shingles is broadcast (a hash and lengths: tens of bytes each).
SHINGLES = 1_000_000


def plain_words(text: Column) -> Column:
    """Words in lower case without ASCII punctuation; null and blank texts have none.

    One scan takes the marks out, one cuts at ASCII white space; `translate` looks up every character of a text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Punct}+", "")
    return F.array_remove(F.split(plain, r"[ \t\n\x0B\f\r]+"), "")


def shingles(tokens: Column, size: int) -> Column:
    """Hashes of the `size`-word shingles in order; none if there are fewer words.

    The words are hashed where they stand; no array is cut out for each shingle."""
    last = F.size(tokens) - size
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)], F.lit(size)))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit majority of the bits of all occurrences."""
    def bit(b: Column) -> Column:
        votes = F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")) == 1))
        return F.when(2 * votes > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """(number, value) of each of radius + 1 blocks of the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    ])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger multiplicities of two arrays of shingles."""
    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def benchmark_items(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, k (words per shingle), m, hashes and fingerprint of every item with a word."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text").cast("string")).alias("tokens"))
    rows = rows.where(F.size("tokens") > 0).withColumn("k", F.least(F.size("tokens"), F.lit(size)))
    made = F.lit(None).cast("array<bigint>")
    for k in range(1, size + 1):
        made = F.when(F.col("k") == k, shingles(F.col("tokens"), k)).otherwise(made)
    rows = rows.select("item_id", "k", made.alias("hashes"))
    return rows.select("item_id", "k", F.size("hashes").alias("m"), "hashes", simhash(F.col("hashes")).alias("item_print"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity (best of its windows), n_windows and first_word of every contaminated pair.

    Null and blank texts on either side match nothing; repeated rows of one doc_id are one document; an empty table on
    either side gives an empty result."""
    out = all_matches(docs, benchmark, size, similarity, radius).select("doc_id", "item_id", "similarity", "first_word").distinct()
    return out.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n_windows"), F.min("first_word").alias("first_word")
    )


def all_matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Windows that match an item: doc_id, mark (hash of the text), item_id, similarity, first_word; repeated rows repeat them."""
    items = materialise(benchmark_items(benchmark, size))
    kinds = sorted(r.k for r in items.select("k").distinct().collect())  # at most `size` numbers
    out = None
    for k in kinds:
        found = matches(docs, items.where(F.col("k") == k), k, similarity, radius)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, mark long, item_id long, similarity double, first_word long")
    return out


def matches(docs: DataFrame, items: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    """Windows of `size`-word shingles that match an item: doc_id, mark, item_id, similarity, first_word."""
    lengths = materialise(items.select(F.explode("hashes").alias("hash"), "m").groupBy("hash").agg(F.collect_set("m").alias("lengths")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    # words are a column of their own: inside the lambda of shingles() the split would run for every shingle
    tokens = rows.select("doc_id", "mark", plain_words(F.col("text")).alias("tokens"))
    spread = tokens.select("doc_id", "mark", F.posexplode(shingles(F.col("tokens"), size)).alias("at", "hash"))
    hits = spread.join(small(lengths, SHINGLES), "hash").select("doc_id", "mark", "at", F.explode("lengths").alias("m"))
    anchors = hits.groupBy("doc_id", "mark", "m").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    need = F.ceil(F.lit(similarity) * F.col("m") - 1e-9).cast("int")
    dense = F.filter("ats", lambda a, i: F.get("ats", i + need - 1) < a + F.col("m"))
    anchors = anchors.select("doc_id", "mark", "m", dense.alias("starts")).where(F.size("starts") > 0)
    anchors = materialise(anchors.select(F.col("doc_id").alias("d"), F.col("mark").alias("k"), "m", "starts"))
    # repeated rows have equal text: any of them gives the windows
    again = rows.join(small(anchors), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k")))
    again = again.select("doc_id", "mark", "m", "starts", plain_words(F.col("text")).alias("tokens"))
    again = again.select("doc_id", "mark", "m", "starts", shingles(F.col("tokens"), size).alias("hashes"))
    cut = again.select("doc_id", "mark", "m", "hashes", F.explode("starts").alias("at"))
    cut = cut.select("doc_id", "mark", "m", "at", F.slice("hashes", F.col("at") + 1, F.col("m")).alias("window"))
    cut = materialise(cut.withColumn("window_print", simhash(F.col("window"))))
    left = cut.withColumn("b", F.explode(blocks(F.col("window_print"), radius))).select("doc_id", "mark", "m", "at", "window_print", "b.block", "b.value", "window")
    right = items.withColumn("b", F.explode(blocks(F.col("item_print"), radius))).select("item_id", "m", "item_print", "b.block", "b.value", "hashes")
    near = left.join(small(right), ["m", "block", "value"]).where(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= radius)
    # of the blocks in which both agree, the first stands for the pair
    first = F.array_position(F.transform(F.arrays_zip(F.transform(blocks(F.col("window_print"), radius), lambda x: x["value"]).alias("p"), F.transform(blocks(F.col("item_print"), radius), lambda x: x["value"]).alias("q")), lambda z: z["p"] == z["q"]), True) - 1
    near = near.where(F.col("block") == first).withColumn("similarity", weighted_similarity(F.col("window"), F.col("hashes")))
    return near.where(F.col("similarity") >= similarity).select("doc_id", "mark", "item_id", "similarity", F.col("at").cast("long").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of `docs`, without rows whose text holds a benchmark item; rows without id and texts that share an id
    each have the verdict of their own text."""
    bad = small(materialise(all_matches(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_bad_mark")).distinct()))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"]).alias("_mark"))
    return rows.join(bad, F.col("_doc").eqNullSafe(F.col("_bad")) & (F.col("_mark") == F.col("_bad_mark")), "left_anti").select("_row.*")

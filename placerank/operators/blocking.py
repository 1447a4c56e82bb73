"""Candidate pairs for fuzzy string matching without comparing everything with everything.

A token-set score can be high in two ways, and each has its own index.

* The shared words outweigh what is left of one side.  Prefix filtering on words (Chaudhuri et al., ICDE 2006): the few rarest
  words that may all be left out are offered, and one of them must be in the other string.
* The two remainders are few edits apart.  Pigeonhole on segments (Li, Deng, Wang and Feng, PVLDB 2011): the words of a string are
  cut into segments; k edits leave all segments but k whole, each inside a word of the other string.  So any k + 1 segments will
  do as keys, and every string takes those whose keys are rarest, long segments or short ones.  Segments meet the words they
  occur in first (a table as large as the vocabulary), words meet strings after that.

Where keys meet, candidates are at once held against a second bound: all the shared words, or the characters both texts have in any
order (kept as bits, so this is a few machine words a pair).  What is left goes to the scorer.  The bounds lose no pair that reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.functions.similarity import best_needles, letter_counts
from placerank.session import materialise, store

# An indel ratio of 88 allows an edit distance of 0.12 * (|a| + |b|).
_EDITS = 0.12
# The score for which these bounds hold.
_LEAST = 88.0
# Shared words must outweigh the remainder: at most 22 % of the characters lie outside.
_WORD_TAIL = 0.22
# Characters of a segment, from which every string chooses one; a whole shorter word is a segment too.
_GRAINS = (1, 2, 3, 4)
# Longer segments are looked up by their first characters.
_LONGEST_KEY = 6
# A zone with at most so many texts on one side is compared whole.
_WHOLE_ZONE = 32


def trigrams(text: Column) -> Column:
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def _rarest(postings: DataFrame, common: DataFrame, share: Column) -> DataFrame:
    """The rarest features of each string; ``share`` decides from the feature's position and the
    number of characters in rarer features whether it is still offered."""
    per_text = Window.partitionBy("side", "kind", "text").orderBy("df", "feature")
    before = per_text.rowsBetween(Window.unboundedPreceding, -1)
    ranked = postings.join(common, ["kind", "feature"], "left").withColumn(
        "df", F.coalesce("df", F.lit(0))
    )
    ranked = ranked.withColumns(
        {
            "_pos": F.row_number().over(per_text),
            "_before": F.coalesce(F.sum(F.length("feature") + 1).over(before), F.lit(0)),
        }
    )
    return ranked.where(share).select("side", "kind", "text", "feature")


def _postings(strings: DataFrame, **features: Column) -> DataFrame:
    """(side, kind, text, feature) for every feature of every string."""

    def tag(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("feature"))

    tagged = F.flatten(F.array(*[F.transform(f, tag(k)) for k, f in features.items()]))
    return strings.select("side", "text", F.explode(tagged).alias("f")).select(
        "side", "f.kind", "text", "f.feature"
    )


def _document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("df"))


def _meeting_places(side: Column, zone: Column) -> Column:
    """Where texts meet when a side has no zone: a left text with a zone meets the zoneless right texts, one without meets
    every right text.  Texts of one zone meet in the zone."""
    left = F.when(zone.isNotNull(), F.array(F.lit("right|"))).otherwise(F.array(F.lit("left|")))
    right = F.when(zone.isNotNull(), F.array(F.lit("left|"))).otherwise(F.array(F.lit("right|"), F.lit("left|")))
    return F.when(side == "l", left).otherwise(right)


def segments(text: Column, grain: int) -> Column:
    """The distinct words of a text cut into pieces of `grain` characters or, at the end of a word, some more."""

    def cut(word: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor(F.length(word) / grain)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, F.substring(word, i * grain + 1, F.lit(grain))).otherwise(F.substring(word, i * grain + 1, F.length(word)))
        )

    return F.flatten(F.transform(words(text), cut))


def _inner_keys(word: Column) -> Column:
    """Every piece of a word that a segment may be looked up by."""
    at = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(
        F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(_LONGEST_KEY), F.length(word) - i + 1)), lambda n: F.substring(word, i, n))))
    )


def _rare_segments(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(side, text, key): k + 1 segments of every text, of the grain and from the words whose keys fewest strings hold.

    A text is looked up as the longer of a pair, so k = 0.24 of its size, the length of its distinct words joined.
    `vocabulary`: word, df."""
    spread = vocabulary.select("df", F.explode(_inner_keys(F.col("word"))).alias("key")).groupBy("key").agg(F.sum("df").alias("key_df"))
    cut = F.array(*[F.struct(F.lit(g).alias("grain"), F.transform(segments(F.col("word"), g), lambda s: F.substring(s, 1, _LONGEST_KEY)).alias("keys")) for g in _GRAINS])
    cuts = vocabulary.select("word", F.explode(cut).alias("c")).select("word", "c.grain", "c.keys")
    costs = cuts.select("word", "grain", F.explode("keys").alias("key")).join(spread, "key").groupBy("word", "grain").agg(F.sum("key_df").alias("cost"))
    cuts = cuts.join(costs, ["word", "grain"]).withColumn("n", F.size("keys"))
    per_word = texts.select("side", "text", "size", F.explode(words(F.col("text"))).alias("word")).join(cuts, "word")
    by_text = Window.partitionBy("side", "text", "size", "grain").orderBy(F.col("cost") / F.col("n"), "word").rowsBetween(Window.unboundedPreceding, -1)
    edits = F.floor(F.lit(2 * _EDITS) * F.col("size") + F.lit(1e-9))
    taken = per_word.withColumn("_before", F.coalesce(F.sum("n").over(by_text), F.lit(0))).where(F.col("_before") <= edits)
    chosen = taken.groupBy("side", "text", "size", "grain").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"), F.collect_list("keys").alias("keys"))
    best = F.min_by(F.col("keys"), F.struct("cost", "grain"))
    plans = chosen.where(F.col("n") > edits).groupBy("side", "text").agg(best.alias("keys"))
    return plans.select("side", "text", F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))


def _joined(parts: Column) -> Column:
    """Length of the words joined by blanks."""
    return F.aggregate(parts, F.lit(0), lambda n, w: n + F.length(w) + 1) - 1


def _words_outweigh(left: Column, right: Column) -> Column:
    """The shared words alone reach the score, or are all of one side."""
    shared = F.array_intersect(words(left), words(right))
    s = _joined(shared).cast("double")
    reaches = lambda side: F.lit(200.0) * s >= F.lit(_LEAST - 1e-6) * (s + _joined(words(side)))
    return (F.size(shared) > 0) & (reaches(left) | reaches(right))


def _letters(text: Column) -> Column:
    """How often 62 classes of characters occur: bit c of `l0` to `l3` says more than 0 to 3 times, `over` counts the rest."""
    zero, none = F.lit(0).cast("long"), F.lit(0)
    start = F.struct(zero.alias("l0"), zero.alias("l1"), zero.alias("l2"), zero.alias("l3"), none.alias("over"))

    def add(seen: Column, char: Column) -> Column:
        bit = F.pow(F.lit(2.0), F.pmod(F.ascii(char), F.lit(62))).cast("long")
        free, levels = F.lit(True), []
        for k in range(4):
            level = seen[f"l{k}"]
            levels.append(F.when(free, level.bitwiseOR(bit)).otherwise(level).alias(f"l{k}"))
            free = free & (level.bitwiseAND(bit) != 0)
        return F.struct(*levels, (seen["over"] + free.cast("int")).alias("over"))

    return F.aggregate(F.split(text, ""), start, add)


def _common_letters(a: str, b: str) -> Column:
    """At least as many characters as two texts (columns of :func:`_letters`) share, in any order."""
    levels = [F.bit_count(F.col(a)[f"l{k}"].bitwiseAND(F.col(b)[f"l{k}"])) for k in range(4)]
    return levels[0] + levels[1] + levels[2] + levels[3] + F.least(F.col(a)["over"], F.col(b)["over"])


def _parts(df: DataFrame) -> int:
    """Partitions for rows that are few bytes but many meetings: adaptive execution would put them all into one task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Candidates:
    """pairs: distinct (left_text, right_text) that may reach the score, whatever their zones; inside: (left_text, right_text,
    zone) for texts of one zone, which holds every such pair of ``pairs`` and others beside them."""

    pairs: DataFrame
    inside: DataFrame


def similar_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (left_text, right_text) that may reach a token-set ratio of 88.

    ``left`` and ``right``: text (blanks separate words) and optionally zone; only pairs of one zone,
    or with a zone missing, are wanted.  See the module text for the two indexes."""
    return candidates(left, right).pairs


def candidates(left: DataFrame, right: DataFrame) -> Candidates:
    """:func:`similar_texts` with the zones in which pairs meet.

    A zone with at most ``_WHOLE_ZONE`` texts on one side is compared whole, at most so many pairs for every text.  Only the
    texts of crowded zones, and once for all zones the texts that meet zoneless ones, are taken to the indexes."""
    t = F.col("text")
    sides = []
    for name, df in (("l", left), ("r", right)):
        zone = F.col("zone") if "zone" in df.columns else F.lit(None).cast("string")
        sides.append(df.select("text", zone.alias("zone")).distinct().withColumn("side", F.lit(name)))
    zones = store(sides[0].union(sides[1]), "zones")
    letters = zones.select("side", "text").distinct().withColumn("_t", F.array_join(words(t), " "))
    letters = materialise(letters.select("side", "text", F.length("_t").alias("size"), _letters(F.col("_t")).alias("letters")))
    texts = letters.select("side", "text", "size")

    sizes = zones.where("zone is not null").groupBy("zone").agg(F.count_if(F.col("side") == "l").alias("_l"), F.count_if(F.col("side") == "r").alias("_r"))
    sizes = store(sizes.where("_l > 0 and _r > 0").select("zone", (F.least("_l", "_r") > _WHOLE_ZONE).alias("_crowded")), "zone_sizes")
    in_zone = lambda side, column: zones.where(F.col("side") == side).select("zone", t.alias(column))
    whole = in_zone("l", "left_text").join(sizes.where("not _crowded").select("zone"), "zone").join(in_zone("r", "right_text"), "zone")
    whole = store(whole.select("left_text", "right_text", "zone"), "whole_zones")

    places = zones.join(sizes.where("_crowded").select("zone"), "zone").select("side", "text", F.concat(F.lit("="), "zone").alias("place"))
    places = places.union(zones.select("side", "text", F.explode(_meeting_places(F.col("side"), F.col("zone")))).distinct())

    postings = materialise(_postings(texts, word=words(t)))
    common = _document_frequency(postings)
    vocabulary = common.select(F.col("feature").alias("word"), "df")
    offered = _rarest(postings, common, F.col("_before") <= _WORD_TAIL * F.length("text")).withColumn("kind", F.lit("word"))
    keys = vocabulary.select("word", F.explode(_inner_keys(F.col("word"))).alias("key"))
    held = _rare_segments(texts, vocabulary).join(keys, "key").select("side", F.lit("segment").alias("kind"), "text", F.col("word").alias("feature")).distinct()

    def keyed(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.join(letters, ["side", "text"]).join(places, ["side", "text"]).select(
            F.col("side").alias("side" + suffix), F.col("kind").alias("kind" + suffix), F.col("text").alias("text" + suffix), F.col("size").alias("size" + suffix), F.col("letters").alias("letters" + suffix), "place", "feature"
        )

    parts, at = _parts(left), ["place", "feature"]
    offers, holders = keyed(offered.unionByName(held), "1").repartition(parts, *at), keyed(postings, "2").drop("kind2").repartition(parts, *at)
    met = offers.join(holders, at).where("side1 <> side2")
    met = met.where((F.col("kind1") == "word") | _near("size1", "size2", "letters1", "letters2"))
    from_left = F.col("side1") == "l"
    # materialised, or the check of words would move below the distinct, and a caller's filter on the score below it too, and
    # run on every repeated meeting of the same pair
    met = materialise(met.select(
        "kind1", F.when(from_left, F.col("text1")).otherwise(F.col("text2")).alias("left_text"), F.when(from_left, F.col("text2")).otherwise(F.col("text1")).alias("right_text"),
        F.when(F.col("place").startswith("="), F.substring("place", 2, 2**31 - 1)).alias("zone"),
    ).repartition(parts, "left_text", "right_text").distinct())
    outweigh = _words_outweigh(F.col("left_text"), F.col("right_text"))
    near = met.where((F.col("kind1") == "segment") | outweigh).select("left_text", "right_text")
    close = whole.select("left_text", "right_text").distinct()
    for side in ("left", "right"):
        mine = letters.where(F.col("side") == side[0]).select(F.col("text").alias(f"{side}_text"), F.col("size").alias(f"size_{side}"), F.col("letters").alias(f"letters_{side}"))
        close = close.join(mine, f"{side}_text")
    sizes_near = _near("size_left", "size_right", "letters_left", "letters_right") | _near("size_right", "size_left", "letters_left", "letters_right")
    pairs = store(near.union(close.where(sizes_near | outweigh).select("left_text", "right_text")).distinct(), "pairs")
    return Candidates(pairs, whole.union(met.where("zone is not null").select("left_text", "right_text", "zone").distinct()))


def _near(longer: str, shorter: str, a: str, b: str) -> Column:
    """Lengths and letters of two texts allow a pair of remainders few edits apart."""
    size1, size2 = F.col(longer), F.col(shorter)
    edits = F.floor(F.lit(_EDITS) * (size1 + size2) + F.lit(1e-9))
    return size1.between(size2, size2 + edits) & (size1 + size2 - 2 * _common_letters(a, b) <= edits)


def _broken_in_window(text: Column, least: float) -> Column:
    """Trigrams of a needle that may be missing in a window scoring ``least``: the two lengths allow
    2 * (1 - least / 100) edits per character of the needle, and a plain deletion may break 3."""
    return F.floor(F.lit(round(6 * (1 - least / 100), 9)) * F.length(text))


def texts_near(needles: DataFrame, haystacks: DataFrame, exact: bool = False, least: float = _LEAST) -> DataFrame:
    """Distinct (needle, haystack) where a window of the haystack may match the needle at ``least``
    or more; with ``exact`` where the haystack may contain it unchanged.

    Meant for 88 and more: below, the edits may break every trigram of a needle, see :func:`best_windows`."""
    t = F.col("text")
    if not exact and least < _LEAST:
        raise ValueError(f"use best_windows below {_LEAST}")
    hay = _postings(haystacks.distinct().withColumn("side", F.lit("h")), gram=trigrams(t))
    pins = _postings(needles.distinct().withColumn("side", F.lit("n")), gram=trigrams(t))
    keep = F.lit(1) if exact else _broken_in_window(t, least) + 1
    offered = _rarest(pins, _document_frequency(hay), F.col("_pos") <= keep)
    full = hay.select("kind", F.col("text").alias("haystack"), "feature")
    parts = _parts(needles)
    at = ["kind", "feature"]
    met = offered.withColumnRenamed("text", "needle").repartition(parts, *at).join(full.repartition(parts, *at), at)
    pairs = materialise(met.select("needle", "haystack").repartition(parts, "needle", "haystack").distinct())  # see similar_texts
    return pairs.where(_enough_shared(F.col("needle"), F.col("haystack"), exact, least))


def best_windows(needles: DataFrame, haystacks: DataFrame, least: float, n: int, whole: bool = False, block: int = 400) -> DataFrame:
    """(needle, haystack, score): for each haystack every needle whose partial ratio (``whole``: ratio) is ``least`` or more and
    not under the n-th best of its block of needles, so the n best of all and their ties are among them.

    The haystacks are the queries, the needles what is searched.  Both are packed into blocks of about ``block`` texts; a pair of
    blocks is one row, and a task searches it with upper bounds (:func:`best_needles`).  No table of pairs is built, and the work
    is dealt out by pairs of blocks, whatever the sizes."""

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        texts = materialise(df.where("text is not null").select("text").distinct())
        parts = max(1, -(-texts.count() // block))
        return texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(parts)).alias(name)).agg(F.collect_list("text").alias(name + "_texts")), parts

    small, parts = blocks(needles, "nb")
    large, _ = blocks(haystacks, "hb")
    met = large.withColumn("nb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(small, "nb")
    met = met.repartition("hb", "nb").select("nb_texts", "hb_texts")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, texts in zip(frame["nb_texts"], frame["hb_texts"], strict=True):
                names = list(names)
                counts = letter_counts(names)
                rows = [(name, text, score) for text in texts for name, score in best_needles(names, text, counts, least, n, whole)]
                yield pd.DataFrame(rows, columns=["needle", "haystack", "score"]).astype({"score": "float64"})

    return materialise(met.mapInPandas(search, "needle string, haystack string, score double"))


def _enough_shared(needle: Column, haystack: Column, exact: bool, least: float) -> Column:
    """The needle keeps all its trigrams but those the allowed edits may break."""
    if exact:
        return F.contains(haystack, needle)
    grams = F.size(trigrams(needle))
    both = F.size(F.array_intersect(trigrams(needle), trigrams(haystack)))
    return F.contains(haystack, needle) | (both >= grams - _broken_in_window(needle, least))

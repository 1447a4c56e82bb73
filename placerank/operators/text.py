"""Text features of venues: keywords, aspects, noise, social words, rating trends.

A text is scored where it stands; only small per-text sums meet in the per-venue aggregate, so a
venue with very many texts costs no more than its share of the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.base import (
    count_phrases,
    count_substrings,
    iso_date,
    java_quote,
    phrase_counts,
    truthy,
    word_pattern,
)
from placerank.functions.lexicons import (
    ASPECTS,
    LOUD_WORDS,
    NEGATORS,
    NOISE_LOUD,
    NOISE_QUIET,
    QUIET_WORDS,
    SOCIAL_WORDS,
)
from placerank.params import Category

SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n"


def venue_texts(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """(venue_id, kind, text) for every snippet and title, lower-cased."""
    parts = [
        reviews.select("venue_id", F.lit("review").alias("kind"), F.col("snippet").alias("text")),
        evidence.select("venue_id", F.lit("snippet").alias("kind"), F.col("snippet").alias("text")),
        evidence.select("venue_id", F.lit("title").alias("kind"), F.col("title").alias("text")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.where(truthy(F.col("text")).isNotNull()).withColumn("text", F.lower("text"))


def keyword_totals(texts: DataFrame, keywords: list[str], by: str = "venue_id") -> DataFrame:
    """(by, keyword, hits): whole-word occurrences, zero counts left out."""
    keywords = sorted({k.lower() for k in keywords})
    return (
        texts.select(by, F.explode(phrase_counts(F.col("text"), keywords)).alias("keyword", "n"))
        .groupBy(by, "keyword")
        .agg(F.sum("n").alias("hits"))
    )


def keyword_maps(totals: DataFrame, by: str = "venue_id") -> DataFrame:
    """(by, keyword_counts MAP); the keyword list bounds the map."""
    pairs = F.array_sort(F.collect_list(F.struct("keyword", "hits")))
    return totals.groupBy(by).agg(F.map_from_entries(pairs).alias("keyword_counts"))


def category_keyword_hits(counts: Column, keywords: Column) -> Column:
    """Sum of stored counts over a category's keywords."""
    mine = F.map_filter(counts, lambda k, _: F.array_contains(keywords, k))
    return F.aggregate(F.map_values(mine), F.lit(0).cast("long"), lambda a, v: a + v)


def category_hits(totals: DataFrame, categories: list[Category]) -> DataFrame:
    """(venue_id, keyword_hits MAP category -> hits)."""
    spark = totals.sparkSession
    rows = [(c.key, k.lower()) for c in categories for k in c.merged_keywords()]
    dim = spark.createDataFrame(rows, "category_key string, keyword string")
    per = totals.join(F.broadcast(dim), "keyword")  # configuration
    per = per.groupBy("venue_id", "category_key").agg(F.sum("hits").alias("hits"))
    pairs = F.array_sort(F.collect_list(F.struct("category_key", "hits")))
    return per.groupBy("venue_id").agg(F.map_from_entries(pairs).alias("keyword_hits"))


def polarity_counts(
    text: Column, lexicon: dict[str, dict[str, list[str]]], negators: list[str]
) -> Column:
    """STRUCT(<aspect>_pos, <aspect>_neg, ...) of one text.

    Counted sentence by sentence: a negated sentence with praise and no complaint counts as
    complaint."""
    sentences = F.split(text, SENTENCE_END)
    negated = word_pattern(negators).replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")
    names = [(aspect, side) for aspect in lexicon for side in ("pos", "neg")]

    def raw(sentence: Column) -> Column:
        return F.struct(
            sentence.rlike(negated).alias("negated"),
            *[count_phrases(sentence, lexicon[a][side]).alias(f"{a}_{side}") for a, side in names],
        )

    def settle(c: Column) -> Column:
        fields = []
        for aspect in lexicon:
            pos, neg = c[f"{aspect}_pos"], c[f"{aspect}_neg"]
            flip = c["negated"] & (pos > 0) & (neg == 0)
            fields.append(F.when(flip, 0).otherwise(pos).alias(f"{aspect}_pos"))
            fields.append(F.when(flip, pos).otherwise(neg).alias(f"{aspect}_neg"))
        return F.struct(*fields)

    zero = F.struct(*[F.lit(0).alias(f"{a}_{side}") for a, side in names])
    return F.aggregate(
        F.transform(F.transform(sentences, raw), settle),
        zero,
        lambda acc, c: F.struct(
            *[(acc[f"{a}_{side}"] + c[f"{a}_{side}"]).alias(f"{a}_{side}") for a, side in names]
        ),
    )


def laplace(pos: Column, neg: Column) -> Column:
    """Smoothed share of praise, 0.5 when balanced; null when nothing was said."""
    return F.when(pos + neg > 0, F.round((pos + F.lit(0.5)) / (pos + neg + F.lit(1.0)), 3))


def aspect_scores(
    texts: DataFrame,
    by: str = "venue_id",
    lexicon: dict | None = None,
    negators: list[str] | None = None,
) -> DataFrame:
    """(by, aspects MAP aspect -> score); aspects nobody mentions are absent."""
    lexicon = lexicon or ASPECTS
    counted = texts.select(by, polarity_counts(F.col("text"), lexicon, negators or NEGATORS).alias("c"))
    sums = counted.groupBy(by).agg(
        *[F.sum(f"c.{a}_{side}").alias(f"{a}_{side}") for a in lexicon for side in ("pos", "neg")]
    )
    scores = F.map_from_arrays(
        F.array(*[F.lit(a) for a in lexicon]),
        F.array(*[laplace(F.col(f"{a}_pos"), F.col(f"{a}_neg")) for a in lexicon]),
    )
    return sums.select(by, F.map_filter(scores, lambda _, v: v.isNotNull()).alias("aspects"))


def noise_level(quiet: Column, loud: Column) -> Column:
    """quiet, loud or moderate; one side must outweigh the other by half again."""
    return (
        F.when(quiet + loud == 0, F.lit(None).cast("string"))
        .when(quiet > loud * 1.5, "quiet")
        .when(loud > quiet * 1.5, "loud")
        .otherwise("moderate")
    )


def noise_counts(
    texts: DataFrame, by: str = "venue_id", quiet: list[str] | None = None, loud: list[str] | None = None
) -> DataFrame:
    """(by, quiet_words, loud_words) as whole words."""
    return texts.groupBy(by).agg(
        F.sum(count_phrases(F.col("text"), quiet or QUIET_WORDS)).alias("quiet_words"),
        F.sum(count_phrases(F.col("text"), loud or LOUD_WORDS)).alias("loud_words"),
    )


def noise_substrings(
    texts: DataFrame, by: str = "venue_id", quiet: list[str] | None = None, loud: list[str] | None = None
) -> DataFrame:
    """(by, quiet_hits, loud_hits) as substrings of snippets; another lexicon than the level's."""
    return texts.groupBy(by).agg(
        F.sum(count_substrings(F.col("text"), quiet or NOISE_QUIET)).alias("quiet_hits"),
        F.sum(count_substrings(F.col("text"), loud or NOISE_LOUD)).alias("loud_hits"),
    )


def secondhand_mentions(texts: DataFrame, by: str = "venue_id", words: list[str] | None = None) -> DataFrame:
    """(by, social_secondhand): how often texts speak of social platforms."""
    pattern = "(?iU)" + "|".join(java_quote(w) for w in words or SOCIAL_WORDS)
    return texts.groupBy(by).agg(F.sum(F.regexp_count("text", F.lit(pattern))).alias("social_secondhand"))


def rating_trend(
    history: DataFrame, snippets: DataFrame, overall: DataFrame, today: str, by: str = "venue_id"
) -> DataFrame:
    """(by, rating_trend): improving, stable, declining or unknown.

    ``history``: by, date, rating (own records); ``snippets``: by, rating, published_at;
    ``overall``: by, overall (one row per venue, the result's rows).  Own history of at least 30 days
    decides; otherwise the last year's reviews against the overall rating."""
    own = history.where("rating is not null").groupBy(by).agg(
        F.min_by("rating", F.struct("date", "rating")).alias("_first"),
        F.max_by("rating", F.struct("date", "rating")).alias("_last"),
        F.date_diff(F.max("date"), F.min("date")).alias("_span"),
    )
    age = F.date_diff(F.lit(today).cast("date"), iso_date(F.col("published_at")))
    recent = snippets.where((age <= 365) & F.col("rating").isNotNull()).groupBy(by).agg(
        F.avg("rating").alias("_recent"), F.count(F.lit(1)).alias("_n")
    )

    def label(delta: Column, step: float) -> Column:
        return F.when(delta >= step, "improving").when(delta <= -step, "declining").otherwise("stable")

    rows = overall.join(own, by, "left").join(recent, by, "left")
    return rows.select(
        by,
        F.when(F.col("_span") >= 30, label(F.col("_last") - F.col("_first"), 0.1))
        .when(F.col("overall").isNotNull() & (F.col("_n") >= 3), label(F.col("_recent") - F.col("overall"), 0.3))
        .otherwise("unknown")
        .alias("rating_trend"),
    )


def new_history_rows(ratings: DataFrame, stored: DataFrame, run_id: str, today: str) -> DataFrame:
    """Rating history rows of a run, without those already stored (one per venue, run and source)."""
    rows = ratings.where("rating is not null").select(
        "venue_id", F.lit(run_id).alias("run_id"), F.lit(today).alias("date"),
        F.col("source_key").alias("source"), "rating", "review_count",
    ).dropDuplicates(["venue_id", "run_id", "source"])
    return rows.join(stored, ["venue_id", "run_id", "source"], "left_anti")

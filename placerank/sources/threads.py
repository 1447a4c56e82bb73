"""Discussion threads: flattening and the names people mention in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.base import strings
from placerank.functions.lexicons import AREA_NAMES, GENERIC_STARTS
from placerank.functions.text import clean_snippet, strip_chars
from placerank.operators.ordered import first_rows, top_k
from placerank.sources.walk import all_levels

REMOVED = ["[deleted]", "[removed]"]

# Patterns that decide which words of a comment count as a name
BOLD = r"\*\*([^*\n]{3,60})\*\*"
LISTED = r"(?mU)^\s*(?:[-*•]|\d{1,2}[.)])\s+([A-Z][^\n:—–-]{2,60}?)(?:\s*[:—–-]|\s*\(|$)"
AFTER_VERB = r"(?U)\b(?:at|from|try|tried|recommend(?:ed)?)\s+([A-Z][\w'&]+(?:\s+[A-Z][\w'&]+){0,4})"


def flatten_threads(comments: DataFrame, limit: int = 100, by: str = "thread_id") -> DataFrame:
    """Bodies in reading order (a comment before its replies), removed ones skipped, first ``limit``.

    ``comments``: by, path (array of positions from the root), body.  Paths compare element by
    element, so their order is the depth-first order at any depth."""
    body = F.trim("body")
    live = comments.where((body != "") & ~F.col("body").isin(*REMOVED))
    kept = top_k(live, [by], [F.col("path").asc()], limit, "position")
    return kept.select(by, "position", "body")


def _children(path: str) -> Column:
    return F.expr(f"try_variant_get(c, '{path}', 'array<variant>')")


def comment_tree(threads: DataFrame) -> DataFrame:
    """API threads (thread_id, selftext, children: JSON text of the list of comments) -> rows (thread_id, path, body), any depth.

    The thread's own text comes first.  Children that are missing, empty or no JSON have no comments."""
    own = threads.select("thread_id", F.array(F.lit(-1)).alias("path"), F.col("selftext").alias("body"))

    def below(level: DataFrame, replies: str = "$.data.replies.data.children") -> DataFrame:
        rows = level.select("thread_id", "path", F.posexplode(_children(replies)).alias("i", "c"))
        return rows.select("thread_id", F.concat("path", F.array("i")).alias("path"), "c")

    top = threads.select("thread_id", F.array().cast("array<int>").alias("path"), F.try_parse_json("children").alias("c"))
    comments = all_levels(below(top, "$"), below)
    return own.union(comments.select("thread_id", "path", F.expr("try_variant_get(c, '$.data.body', 'string')").alias("body")))


def names_in(body: Column, areas: list[str] | None = None) -> Column:
    """ARRAY<STRUCT<name, confidence>> of names a comment mentions, strongest form per name."""

    def found(pattern: str, confidence: float) -> Column:
        hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        return F.transform(hits, lambda h: F.struct(F.trim(h).alias("name"), F.lit(confidence).alias("confidence")))

    every = F.concat(found(BOLD, 0.6), found(LISTED, 0.5), found(AFTER_VERB, 0.35))
    # strongest first, so keeping the first of equal names keeps the best confidence
    names = F.array_distinct(F.transform(every, lambda e: e["name"]))
    best = F.transform(names, lambda n: F.filter(every, lambda e: e["name"] == n)[0])
    generic = strings(GENERIC_STARTS)

    def usable(e: Column) -> Column:
        name = e["name"]
        bad = F.array_contains(generic, F.substring_index(name, " ", 1)) | F.lower(name).isin(
            "the", "a", *(areas or AREA_NAMES)
        )
        return (F.length(name) >= 3) & ~bad

    return F.transform(
        F.filter(best, usable),
        lambda e: F.struct(strip_chars(e["name"], " .,!?").alias("name"), e["confidence"].alias("confidence")),
    )


def extract_names(bodies: DataFrame, by: str = "thread_id", areas: list[str] | None = None) -> DataFrame:
    """(by, name, confidence, snippet, position): first mention of each name per thread."""
    rows = bodies.select(by, "position", "body", F.posexplode(names_in(F.col("body"), areas)).alias("nth", "n"))
    rows = rows.select(
        by, F.lower("n.name").alias("name_key"), "position", "nth", F.col("n.name").alias("name"),
        F.col("n.confidence").alias("confidence"), clean_snippet(F.col("body"), 200).alias("snippet"),
    )
    return first_rows(rows.where("name <> ''"), [by, "name_key"], ["position", "nth"])

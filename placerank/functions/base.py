"""Small Column helpers shared by the other function modules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with null instead of the empty string when nothing is captured."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``: repeated mentions would repeat the work."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truthy(value: Column, kind: str = "string") -> Column:
    """0, 0.0 and the empty string count as missing, as they do in the merge rules."""
    return F.when(value != (F.lit("") if kind == "string" else F.lit(0)), value)


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(table: Mapping, key: Column) -> Column:
    """Constant table lookup; null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def word_pattern(phrases: Iterable[str]) -> str:
    """Any of the phrases as whole words, longest spelling first, Unicode word characters."""
    options = sorted(set(phrases), key=lambda p: (-len(p), p))
    return r"(?U)(?<!\w)(?:" + "|".join(java_quote(p) for p in options) + r")(?!\w)"


def java_quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", text)


def _words(phrase: str) -> set[str]:
    return set(re.findall(r"\w+", phrase)) or {phrase}


def phrase_groups(phrases: Iterable[str]) -> list[list[str]]:
    """Split phrases into groups whose members share no word, so that one scan of the text with an
    alternation counts every member of a group exactly."""
    groups: list[tuple[set[str], list[str]]] = []
    for phrase in dict.fromkeys(phrases):
        words = _words(phrase)
        for taken, members in groups:
            if not taken & words:
                taken |= words
                members.append(phrase)
                break
        else:
            groups.append((set(words), [phrase]))
    return [members for _, members in groups]


def count_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Total whole-word occurrences of all phrases in an already lower-cased text."""
    counts = [F.regexp_count(text, F.lit(word_pattern(g))) for g in phrase_groups(phrases)]
    return reduce(lambda a, b: a + b, counts, F.lit(0))


def phrase_counts(text: Column, phrases: Iterable[str]) -> Column:
    """MAP phrase -> whole-word occurrences, absent when zero.

    One scan per phrase group finds the hits; counting then touches the hits only."""
    phrases = list(dict.fromkeys(phrases))
    scans = [F.regexp_extract_all(text, F.lit(word_pattern(g)), F.lit(0)) for g in phrase_groups(phrases)]
    hits = F.coalesce(F.concat(*scans), F.array().cast("array<string>"))
    found = F.array_intersect(strings(phrases), hits)
    return F.map_from_arrays(
        found, F.transform(found, lambda p: F.size(F.filter(hits, lambda h: h == p)))
    )


def count_substrings(text: Column, words: Iterable[str]) -> Column:
    """Non-overlapping substring occurrences of every word, word boundaries ignored."""
    parts = [
        (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in words
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0)).cast("int")


def iso_date(text: Column) -> Column:
    """Date from the first ten characters of an ISO string; null when unreadable."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(F.array_compact(values))

"""Name keys and brand / outlet splitting."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import let, strings
from placerank.functions.lexicons import ARTICLES, LEGAL_WORDS, NOISE_WORDS

CJK_RUN = r"([一-鿿]+)"
OUTLET = r"(?sU)^(.*?)(?:\s+(?:@|at|-|–|—|\||/)\s+(.*)|\s*[(（]([^)）]+)[)）]\s*)$"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Translation rule derived from Unicode: (from, to, expansions).

    ``from[i]`` becomes ``to[i]``; characters past the end of ``to`` (combining marks) vanish.
    Only characters that fold to something a name key keeps are listed.  Ligatures fold to more
    than one letter and are returned as replacements."""
    src, dst, marks, wide = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if flat == ch or not any(c.isascii() and c.isalnum() or "一" <= c <= "鿿" for c in flat):
            continue
        if len(flat) == 1:
            src.append(ch)
            dst.append(flat)
        elif 0xFB00 <= code <= 0xFB06:
            wide.append((ch, flat))
    return "".join(src + marks), "".join(dst), wide


def ascii_fold(text: Column) -> Column:
    """Accents removed, compatibility letters replaced by their plain form."""
    src, dst, wide = _fold_table()
    for ch, flat in wide:
        text = F.replace(text, F.lit(ch), F.lit(flat))
    return F.translate(text, src, dst)


def _drop(words: Column, unwanted: list[str]) -> Column:
    stop = strings(unwanted)
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def name_key(name: Column, keep_noise: bool = False) -> Column:
    """Key of a name for exact matching: folded, lower-case, without legal and generic words.

    Chinese characters go to the end as their own tokens.  A name made of generic words only keeps
    them (without articles)."""
    return let(F.lower(ascii_fold(name)), lambda folded: _key_of(folded, keep_noise))


def _key_of(folded: Column, keep_noise: bool) -> Column:
    chinese = F.array_join(F.regexp_extract_all(folded, F.lit(CJK_RUN), F.lit(1)), " ")
    latin = F.regexp_replace(folded, r"[^a-z0-9]+", " ")
    every = F.filter(F.split(latin, " "), lambda w: w != "")

    def choose(words: Column) -> Column:
        if keep_noise:
            return F.when(F.size(words) > 0, words)
        plain = _drop(words, ARTICLES)
        return let(
            _drop(words, NOISE_WORDS),
            lambda kept: F.when(F.size(kept) > 0, kept)
            .when(F.size(plain) > 0, plain)
            .when(F.size(words) > 0, words),
        )

    chosen = F.coalesce(let(_drop(every, LEGAL_WORDS), choose), every)
    return F.trim(F.concat_ws(" ", F.array_join(chosen, " "), chinese))


def brand_outlet(name: Column) -> Column:
    """STRUCT(brand, outlet): "X @ Y", "X - Y" or "X (Y)"; outlet is null for plain names."""
    brand = F.trim(F.regexp_extract(name, OUTLET, 1))
    outlet = F.trim(
        F.concat(F.regexp_extract(name, OUTLET, 2), F.regexp_extract(name, OUTLET, 3))
    )
    ok = (
        (brand != "")
        & (outlet != "")
        & ~outlet.rlike("^[一-鿿]+$")
        & (F.size(F.split(outlet, r"(?U)\s+")) <= 4)
    )
    return F.struct(
        F.when(ok, brand).otherwise(F.trim(name)).alias("brand"), F.when(ok, outlet).alias("outlet")
    )


def handle_key(text: Column) -> Column:
    """Lower-case letters, digits and Chinese characters only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]", "")

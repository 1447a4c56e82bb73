"""Text fields: postal codes, phones, snippets, headings, dates, links (Columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import first_group, java_quote, strings
from placerank.functions.lexicons import MONTHS, SKIP_HEADINGS

# Patterns that decide which texts count as a postal code, phone, address, hours or heading
POSTAL = r"(?iU)(?<!\d)(?:Singapore\s*|S\(?)?(\d{6})\)?(?!\d)"
PHONE = r"(?U)(?<!\d)(?:\+65[\s-]?)?([689]\d{3})[\s-]?(\d{4})(?!\d)"
ADDRESS = (
    r"(?iU)(?:Address\s*[:：]\s*)?((?:\d{1,4}[A-Z]?\s+)?[#\w][\w\s,'.\-#/()]{4,120}?Singapore\s*\d{6})"
)
HOURS = r"(?iU)(?:Opening\s+Hours?|Hours|Open)\s*[:：]\s*(.+)"
HOURS_STOP = r"(?isU)\s*(?:\||Tel\b|Phone\b|Contact\b|Website\b|Address\b|Google Maps).*$"
PRICE_SYMBOLS = r"(?U)(\${1,4})(?![\d\w])"

LEADING_NUMBER = r"(?U)^\s*(?:#?\d{1,3}[.):\-–—]?\s*)"
TRAILING_TAGLINE = r"(?iU)\s*[|–—-]\s*(?:best|top|the|a|an|for|our|where)\b.*$"
NEWS_PREFIX = r"(?iU)^(?:new|just opened|now open|opening)(?:\s+[a-z]+){0,2}\s*:\s*"
NEWS_SUFFIX = (
    r"(?iU)\s+(?:is\s+)?(?:opening|opens|opened|now open|reopens|launches)"
    r"(?:(?:\s+[a-z]+){0,2}?\s+(?:at|in|on|this|its|a|an|the|with|soon|today)(?:\s.*)?)?$"
)
STATUS_SUFFIX = r"(?iU)\s*[\[(]\s*(?:closed|permanently closed|new)\s*[\])]\s*$"
CJK = r"[一-鿿]"


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    cls = "[" + "".join("\\" + c if c in r"\-[]^" else c for c in chars) + "]+"
    return F.regexp_replace(text, f"^{cls}|{cls}$", "")


def postal_code(text: Column) -> Column:
    """First six-digit run that touches no other digit."""
    return first_group(text, POSTAL, 1)


def phone_number(text: Column) -> Column:
    """First local number as ``+65 dddd dddd``."""
    head = first_group(text, PHONE, 1)
    return F.when(head.isNotNull(), F.concat_ws(" ", F.lit("+65"), head, F.regexp_extract(text, PHONE, 2)))


def clean_snippet(text: Column, limit: int = 300) -> Column:
    """Collapsed whitespace, at most ``limit`` characters with an ellipsis; blank becomes null."""
    flat = collapse_spaces(text)
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(flat) > limit, cut).when(flat != "", flat)


def is_date_only(name: Column) -> Column:
    """Month headings ("July 2026", "12 Feb", "2026") are not places."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([a-z]+|\d+)"), F.lit(1))
    months = strings(MONTHS)
    is_month = lambda w: F.array_contains(months, w)
    dates_only = F.forall(words, lambda w: w.rlike(r"^\d+$") | is_month(w))
    year = F.array_join(words, "").rlike(r"^(?:19|20)\d\d$")
    return (F.size(words) > 0) & dates_only & (F.exists(words, is_month) | year)


def strip_news_wording(name: Column) -> Column:
    """ "New cafe: X" and "X is opening at ..." name X; unchanged when nothing would remain."""
    short = F.regexp_replace(F.regexp_replace(F.trim(name), NEWS_PREFIX, ""), NEWS_SUFFIX, "")
    return F.coalesce(F.nullif(F.trim(short), F.lit("")), name)


def clean_heading(text: Column) -> Column:
    """List number, news wording, tagline and status notes removed from a listicle heading."""
    out = F.regexp_replace(collapse_spaces(text), LEADING_NUMBER, "")
    out = strip_news_wording(out)
    for pattern in (TRAILING_TAGLINE, STATUS_SUFFIX):
        out = F.regexp_replace(out, pattern, "")
    return strip_chars(out, " -–—:|")


def is_skip_heading(text: Column) -> Column:
    return strip_chars(F.lower(text), " :").isin(*SKIP_HEADINGS)


def split_chinese_name(name: Column) -> Column:
    """STRUCT(name, name_zh): "(中文)" anywhere, else a later run of two or more characters."""
    paren = rf"(?sU)^(.*?)[(（]\s*({CJK}[一-鿿\s]*)\s*[)）](.*)$"
    trailing = rf"(?s)^(.*?)({CJK}{{2,}})"
    in_paren = first_group(name, paren, 2)
    run = first_group(name, trailing, 2)
    outside = F.concat(
        F.trim(F.regexp_extract(name, paren, 1)), F.trim(F.regexp_extract(name, paren, 3))
    )
    head = F.regexp_extract(name, trailing, 1)
    by_run = run.isNotNull() & (F.trim(head) != "")
    return F.struct(
        F.when(in_paren.isNotNull(), outside)
        .when(by_run, strip_chars(head, " -–|"))
        .otherwise(name)
        .alias("name"),
        F.when(in_paren.isNotNull(), F.trim(in_paren)).when(by_run, run).alias("name_zh"),
    )


def number(text: Column) -> Column:
    """First number of a text, thousands separators removed."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast(
        "double"
    )


def whole_number(text: Column) -> Column:
    digits = F.regexp_extract(text, r"(\d[\d,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("int")


def normalise_date(text: Column) -> Column:
    """ISO dates with or without time and zone, "14 March 2026", "March 14, 2026" -> ISO string."""
    value = F.trim(text)
    lead = first_group(value, r"^(\d{4}-\d{2}-\d{2})", 1)
    long_forms = [
        F.try_to_date(F.when(value.rlike(shape), value), fmt)
        for shape, fmt in (
            (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
            (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
        )
    ]
    return F.coalesce(*[d.cast("string") for d in long_forms], lead)


def result_date(text: Column) -> Column:
    """First ISO or "Mar 4, 2026" date inside a search result."""
    iso = first_group(text, r"(\d{4}-\d{2}-\d{2})", 1)
    short = first_group(text, r"([A-Z][a-z]{2} \d{1,2}, \d{4})", 1)
    first = first_group(text, r"(\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2} \d{1,2}, \d{4})", 1)
    return F.when(first == iso, F.try_to_date(iso, "yyyy-MM-dd")).otherwise(
        F.try_to_date(short, "MMM d, yyyy")
    ).cast("string")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def request_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", method, url, F.coalesce(body, F.lit(""))), 256)


# --- links -------------------------------------------------------------------------------------
def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_host(url: Column) -> Column:
    return first_group(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on ``base`` (scheme, host, root and relative paths)."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    relative = F.regexp_replace(href, r"^(?:\./)+", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, r"^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, F.lit("/"), relative))
    )


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(java_quote(w) for w in words))

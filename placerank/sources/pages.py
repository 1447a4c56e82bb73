"""Landed web pages -> listicle entries, result cards, JSON-LD listings, links and metadata.

Only tree splitting runs in Python (one pass per Arrow batch); every field is a Column afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placerank.functions.awards import distinction
from placerank.functions.base import first_group, java_quote, let, strings, truthy
from placerank.functions.lexicons import (
    FOOD_QUERY_WORDS,
    FOOD_SLUG,
    GENERIC_QUERY_WORDS,
    LISTICLE_WORDS,
    NEWNESS_QUERY,
    NEWNESS_SLUG,
    OVERSEAS_SLUG,
)
from placerank.functions.text import (
    ADDRESS,
    HOURS,
    HOURS_STOP,
    PRICE_SYMBOLS,
    clean_heading,
    collapse_spaces,
    content_hash,
    is_skip_heading,
    normalise_date,
    number,
    phone_number,
    postal_code,
    resolve_url,
    split_chinese_name,
    strip_chars,
    url_host,
    url_path,
    whole_number,
    without_fragment,
)
from placerank.operators.ordered import top_k
from placerank.sources.walk import all_levels

# Business types read from JSON-LD
BUSINESS_TYPES = ["Restaurant", "FoodEstablishment", "LocalBusiness", "CafeOrCoffeeShop", "BarOrPub"]


# --- listicles -----------------------------------------------------------------------------------
def _split_sections(tags: tuple[str, ...]):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from placerank.sources.html_tree import parse, sections

        for batch in batches:
            rows = [
                (page, n, heading, text, links)
                for page, html in zip(batch["page_id"], batch["html"], strict=True)
                for n, (heading, text, links) in enumerate(sections(parse(html), tags))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "heading_no", "heading", "text", "links"])

    return split


def extract_listicles(
    pages: DataFrame, heading_tags: tuple[str, ...] = ("h2", "h3"), min_chars: int = 20
) -> DataFrame:
    """One row per venue heading of an article with the details its text gives.

    "Name: address | Tel" headings are split; boilerplate and very long headings are skipped."""
    kind = pages.schema["page_id"].dataType.simpleString()
    raw = pages.select("page_id", "html").mapInPandas(
        _split_sections(heading_tags),
        f"page_id {kind}, heading_no int, heading string, text string, links array<string>",
    )
    info = F.contains("heading", F.lit(":")) & postal_code(F.col("heading")).isNotNull()
    head = F.when(info, F.trim(F.substring_index("heading", ":", 1))).otherwise(F.col("heading"))
    tail = F.when(info, F.trim(F.regexp_extract("heading", r"(?s)^[^:]*:(.*)$", 1)))
    rows = raw.select(
        "page_id", "heading_no", head.alias("heading"), collapse_spaces(F.concat_ws(" ", tail, "text")).alias("text"), "links"
    ).where(~is_skip_heading(F.col("heading")) & (F.length("heading") <= 140) & (F.length("text") >= min_chars))
    address = first_group(F.col("text"), ADDRESS, 1)
    hours = F.regexp_replace(first_group(F.col("text"), HOURS, 1), HOURS_STOP, "")
    return (
        rows.withColumns({"_name": split_chinese_name(clean_heading(F.col("heading"))), "address": F.trim(address)})
        .where(truthy(F.col("_name.name")).isNotNull())
        .select(
            "page_id", "heading_no", "_name.name", "_name.name_zh", "text", "links", "address",
            postal_code(F.coalesce("address", "text")).alias("postal_code"),
            phone_number(F.col("text")).alias("phone"),
            truthy(strip_chars(F.substring(hours, 1, 120), " |")).alias("hours"),
            first_group(F.col("text"), PRICE_SYMBOLS, 1).alias("price_text"),
        )
    )


def is_listing() -> Column:
    """An entry that gives a postal code, phone, hours or a map link is a venue."""
    mapped = F.exists("links", lambda x: F.contains(x, F.lit("maps")) | F.contains(x, F.lit("goo.gl")))
    return F.col("postal_code").isNotNull() | F.col("phone").isNotNull() | F.col("hours").isNotNull() | F.coalesce(mapped, F.lit(False))


# --- result cards ----------------------------------------------------------------------------------
CARD_FIELDS = ["name", "address", "rating", "review_count", "price", "cuisine", "award"]


def _split_cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from placerank.sources.html_tree import parse, select, select_one

    columns = ["page_id", "source_key", "url", "card_no", "href", "stars", "text", *CARD_FIELDS]
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            sel = r.selectors
            for n, card in enumerate(select(parse(r.html), sel["card"])):
                link = select_one(card, sel.get("link") or "a[href]")
                parts = [select_one(card, sel.get(f)) for f in CARD_FIELDS]
                rows.append((
                    r.page_id, r.source_key, r.url, n, link.attrs.get("href") if link else None,
                    len(select(card, sel["star"])) if sel.get("star") else 0, card.text(),
                    *[p.text() if p else None for p in parts],
                ))
        yield pd.DataFrame(rows, columns=columns)


def extract_cards(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """Cards of search result pages; ``selectors``: source_key, selectors MAP field -> selector."""
    kind = pages.schema["page_id"].dataType.simpleString()
    fields = ", ".join(f"{f} string" for f in CARD_FIELDS)
    joined = pages.join(F.broadcast(selectors), "source_key")  # configuration: one row per source
    raw = joined.select("page_id", "source_key", "url", "html", "selectors").mapInPandas(
        _split_cards, f"page_id {kind}, source_key string, url string, card_no int, href string, stars int, text string, {fields}"
    )
    rows = raw.where(truthy(F.col("name")).isNotNull())
    pieces = F.transform(F.split("cuisine", r"[,/·•|]"), lambda c: F.trim(c))
    return rows.select(
        "page_id", "source_key", "card_no", clean_heading(F.col("name")).alias("name"),
        resolve_url(F.col("url"), F.col("href")).alias("url"), "address",
        number(F.col("rating")).alias("rating"), whole_number(F.col("review_count")).alias("review_count"),
        F.col("price").alias("price_text"),
        F.coalesce(F.filter(pieces, lambda c: c != ""), F.array().cast("array<string>")).alias("cuisine"),
        "text", "award", "stars",
    )


def guide_listings(cards: DataFrame) -> DataFrame:
    """Guide cards with their award; counted star icons stand in for a missing label."""
    label = F.lower(F.coalesce("award", F.lit("")))
    silent = (F.col("stars") > 0) & ~F.contains(label, F.lit("star")) & ~F.contains(label, F.lit("bib"))
    text = F.when(silent, F.concat(F.col("stars").cast("string"), F.lit(" stars"))).otherwise(
        F.coalesce(truthy(F.col("award")), "text")
    )
    return cards.withColumn("michelin", distinction(text))


# --- JSON-LD -----------------------------------------------------------------------------------------
LD_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _field(path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(b, '$.{path}', '{kind}')")


def _as_list(path: str) -> Column:
    return F.coalesce(F.expr(f"try_variant_get(b, '{path}', 'array<variant>')"), F.expr("cast(array() as array<variant>)"))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Business entries of ld+json blocks, from graphs, lists and item lists nested to any depth.

    ``at`` is the way to an entry: block, element of its list or graph, then the position in every item list."""
    scripts = F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))
    docs = pages.select("page_id", "url", F.posexplode(scripts).alias("block_no", "s")).select(
        "page_id", "url", "block_no", F.expr("try_parse_json(s)").alias("b")
    ).where("b is not null")
    is_list = F.expr("schema_of_variant(b)").startswith("ARRAY")
    blocks = docs.select(
        "page_id", "url", "block_no",
        F.posexplode(F.when(is_list, _as_list("$")).otherwise(F.concat(_as_list("$.@graph"), F.array("b")))).alias("i", "b"),
    ).select("page_id", "url", F.array("block_no", "i").alias("at"), "b")
    kinds = F.coalesce(_field("@type", "array<string>"), F.array(_field("@type")))
    business = F.coalesce(F.arrays_overlap(kinds, strings(BUSINESS_TYPES)), F.lit(False))
    named = F.coalesce(F.trim(_field("name")) != "", F.lit(False))
    is_object = "try_variant_get(b, '{}', 'map<string,variant>') is not null"

    def items(level: DataFrame) -> DataFrame:
        inner = level.where(~business | named).select(  # a business without a name hides what it lists
            "page_id", "url", "at", F.posexplode(_as_list("$.itemListElement")).alias("k", "b")
        )
        inner = inner.where(F.expr(is_object.format("$"))).select(
            "page_id", "url", F.concat("at", F.array("k")).alias("at"),
            F.when(F.expr(is_object.format("$.item")), F.expr("try_variant_get(b, '$.item', 'variant')")).otherwise(F.col("b")).alias("b"),
        )
        return inner

    rows = all_levels(blocks, items).where(business & named)
    parts = F.concat_ws(
        ", ", *[truthy(_field(f"address.{p}")) for p in ("streetAddress", "addressLocality", "postalCode")]
    )
    in_object = F.expr("try_variant_get(b, '$.address', 'map<string,variant>')").isNotNull()
    link = truthy(_field("url"))
    return rows.select(
        "page_id", "at", F.trim(_field("name")).alias("name"),
        F.when(link.isNotNull(), resolve_url(F.col("url"), link)).alias("url"),
        F.when(in_object, parts).otherwise(_field("address")).alias("address"),
        number(_field("aggregateRating.ratingValue")).alias("rating"),
        whole_number(F.coalesce(_field("aggregateRating.reviewCount"), _field("aggregateRating.ratingCount"))).alias("review_count"),
        _field("priceRange").alias("price_text"),
        F.coalesce(_field("servesCuisine", "array<string>"), F.array_compact(F.array(_field("servesCuisine")))).alias("cuisine"),
        F.coalesce(_field("description"), F.lit("")).alias("text"),
    )


def listings(jsonld: DataFrame, cards: DataFrame) -> DataFrame:
    """JSON-LD entries where a page has any, its cards otherwise."""
    cols = ["page_id", "name", "url", "address", "rating", "review_count", "price_text", "cuisine", "text"]
    rest = cards.join(jsonld.select("page_id").distinct(), "page_id", "left_anti")
    return jsonld.select(*cols).union(rest.select(*cols))


# --- metadata ----------------------------------------------------------------------------------------
@F.pandas_udf(StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """All HTML5 character references, named and numeric; texts without one are passed on."""
    return text.map(lambda t: unescape(t) if t and "&" in t else t)


def plain_text(html: Column) -> Column:
    """Visible text of an HTML fragment: tags become blanks, references characters, blanks collapse."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return collapse_spaces(decode_references(F.regexp_replace(text, r"(?s)<[^>]*>", " ")))


def meta_content(html: Column, attr: str, value: str) -> Column:
    """Content of a meta tag, attributes in either order."""
    name = rf"{attr}\s*=\s*[\"']{java_quote(value)}[\"']"
    content = r"content\s*=\s*[\"']([^\"']*)[\"']"
    return F.coalesce(
        first_group(html, rf"(?is)<meta\s[^>]*{name}[^>]*{content}", 1),
        first_group(html, rf"(?is)<meta\s[^>]*{content}[^>]*{name}", 1),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, published_at, content_hash)."""
    html = F.col("html")
    title = F.coalesce(
        truthy(F.trim(meta_content(html, "property", "og:title"))),
        truthy(plain_text(first_group(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))),
        truthy(plain_text(first_group(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))),
    )
    script = first_group(html, LD_SCRIPT, 1)
    in_script = [first_group(script, rf"\"{k}\"\s*:\s*\"([^\"]+)\"", 1) for k in ("datePublished", "dateCreated", "dateModified")]
    in_meta = [
        meta_content(html, a, v)
        for a, v in (
            ("property", "article:published_time"), ("name", "article:published_time"),
            ("property", "og:updated_time"), ("name", "date"), ("itemprop", "datePublished"),
        )
    ]
    time_tag = first_group(html, r"(?is)<time\s[^>]*datetime\s*=\s*[\"']([^\"']*)[\"']", 1)
    published = normalise_date(F.coalesce(*in_script, *in_meta, time_tag))
    return pages.select("page_id", title.alias("title"), published.alias("published_at"), content_hash(plain_text(html)).alias("content_hash"))


# --- links -------------------------------------------------------------------------------------------
def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, position): unique absolute links in document order, fragments dropped."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("position", "href"))
    link = without_fragment(resolve_url(F.col("url"), F.replace("href", F.lit("&amp;"), F.lit("&"))))
    return rows.select("page_id", "url", link.alias("link"), "position").groupBy("page_id", "url", "link").agg(
        F.min("position").alias("position")
    )


def discover_links(
    pages: DataFrame, pattern: str, relevant: Callable[[Column], Column] | None = None, limit: int = 5
) -> DataFrame:
    """Article links of a search page: same site, matching path, relevant; listicles first, top k."""
    rows = page_links(pages)
    slash = lambda c: F.regexp_replace(c, "/+$", "")
    ok = (
        (url_host(F.col("link")) == url_host(F.col("url")))
        & (slash(F.col("link")) != slash(F.col("url")))
        & url_path(F.col("link")).rlike(pattern)
    )
    if relevant is not None:
        ok = ok & relevant(F.col("link"))
    score = sum((F.contains(F.lower("link"), F.lit(w)).cast("int") for w in LISTICLE_WORDS), F.lit(0))
    rows = rows.where(ok).withColumn("score", score)
    return top_k(rows, ["page_id"], [F.col("score").desc(), F.col("position").asc()], limit)


def _stem(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def _content_words(text: Column) -> Column:
    """Distinct stemmed words without the generic ones."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), _stem)
    generic = sorted({w[:-1] if len(w) > 3 and w.endswith("s") else w for w in GENERIC_QUERY_WORDS})
    return F.array_except(found, strings(generic))


def relevant_article(url: Column, query: Column) -> Column:
    """The slug names food at home, shares the query's distinctive words (two of them where there are
    two), and looks like an openings article when the query asks for new places."""
    slug = F.lower(url_path(url))
    home = slug.rlike(FOOD_SLUG) & ~slug.rlike(OVERSEAS_SLUG)
    timely = ~query.rlike(NEWNESS_QUERY) | slug.rlike(NEWNESS_SLUG)

    def judged(words: Column) -> Column:
        special = F.array_except(words, strings(FOOD_QUERY_WORDS))
        wanted = F.when(F.size(special) > 0, special).otherwise(words)
        return let(
            F.struct(wanted.alias("w"), _content_words(slug).alias("s")),
            lambda x: F.size(
                F.filter(x["w"], lambda w: F.array_contains(x["s"], w) | ((F.length(w) > 4) & F.contains(slug, w)))
            )
            >= F.least(F.lit(2), F.size(x["w"])),
        ) & (F.size(words) > 0)

    return home & timely & let(_content_words(query), judged)

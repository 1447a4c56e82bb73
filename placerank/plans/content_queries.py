"""Registered queries over texts, pages, threads, places, and over strings derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.functions import awards, geo, hours, names, price
from placerank.functions import text as texts
from placerank.functions.lexicons import POSTAL_SECTORS
from placerank.functions.similarity import token_set_ratio_udf
from placerank.operators import enrich, resolve, scoring, social, text, validate
from placerank.operators.blocking import similar_texts
from placerank.operators.merge import prune_evidence, refresh_venues
from placerank.operators.ordered import top_k
from placerank.plans import serve
from placerank.plans.ranking_queries import BAYES, DUCK_BEST, DUCK_RATINGS, ratings
from placerank.plans.duck_match import FUZZY_PAIRS, NAME_KEY, resolution
from placerank.plans.standins import LOWERED, PLACES, STATIONS, VENUES, duck, venues, view
from placerank.sources import pages, payloads, threads

T, V, G, ST = duck(LOWERED), duck(VENUES), duck(PLACES), duck(STATIONS)
# lexicons made of words the corpus has
KEYWORDS = ["the", "of", "and", "to", "is", "that", "of the"]
LEXICON = {"food": {"pos": ["the", "of"], "neg": ["and"]}, "service": {"pos": ["is", "in"], "neg": ["to", "that"]}}
NEGATORS = ["no", "never", "too", "for"]
QUIET, LOUD = ["the", "in"], ["of", "is", "it"]
TOKENS = r"[x FOR x IN string_split_regex(text, '[^\p{L}\p{N}_]+') IF x <> '']"


def _hits(words: list[str], tokens: str = "toks") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len([x FOR x IN {tokens} IF x IN ({listed})])"


# --- texts -----------------------------------------------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOWERED)


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keyword_totals(documents(spark, sf_dir), KEYWORDS, "source")


DUCK_KEYWORDS = f"""WITH t AS (SELECT source, {TOKENS} AS toks, regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS doubled FROM ({T})),
k AS ({" UNION ALL ".join(f"SELECT source, '{w}' AS keyword, sum({_hits([w])}) AS hits FROM t GROUP BY 1" for w in KEYWORDS if " " not in w)}
UNION ALL SELECT source, 'of the', sum(len(regexp_extract_all(doubled, '(?:^|[^\\p{{L}}\\p{{N}}_])of  the(?:[^\\p{{L}}\\p{{N}}_]|$)'))) FROM t GROUP BY 1)
SELECT * FROM k WHERE hits > 0"""


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts as maps, summed over a category's keywords, on the logarithmic scale."""
    maps = text.keyword_maps(text.keyword_totals(documents(spark, sf_dir), KEYWORDS, "doc_id"), "doc_id")
    hits = text.category_keyword_hits(F.col("keyword_counts"), F.array(F.lit("the"), F.lit("of")))
    return maps.select("doc_id", hits.alias("hits"), F.round(scoring.keyword_match(hits), 9).alias("keyword_match"))


def aspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.aspect_scores(documents(spark, sf_dir), "doc_id", LEXICON, NEGATORS)
    return rows.select("doc_id", F.explode("aspects").alias("aspect", "score"))


def _duck_aspect(aspect: str) -> str:
    pos, neg = _hits(LEXICON[aspect]["pos"]), _hits(LEXICON[aspect]["neg"])
    return f"""SELECT doc_id, '{aspect}' AS aspect, round((sum(p) + 0.5::DOUBLE) / (sum(p) + sum(n) + 1.0::DOUBLE), 3) AS score FROM (
      SELECT doc_id, CASE WHEN f THEN 0 ELSE p0 END AS p, CASE WHEN f THEN p0 ELSE n0 END AS n FROM (
        SELECT doc_id, {pos} AS p0, {neg} AS n0, {_hits(NEGATORS)} > 0 AND {pos} > 0 AND {neg} = 0 AS f FROM s)) GROUP BY 1 HAVING sum(p) + sum(n) > 0"""


DUCK_ASPECTS = f"""WITH s AS (SELECT doc_id, {TOKENS} AS toks FROM (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\x01\\n]')) AS text FROM ({T})))
{_duck_aspect("food")} UNION ALL {_duck_aspect("service")}"""


def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.noise_counts(documents(spark, sf_dir), "doc_id", QUIET, LOUD)
    return counts.select("doc_id", "quiet_words", "loud_words", text.noise_level(F.col("quiet_words"), F.col("loud_words")).alias("noise_level"))


DUCK_NOISE = f"""SELECT doc_id, q AS quiet_words, l AS loud_words, CASE WHEN q + l = 0 THEN NULL WHEN q > l * 1.5 THEN 'quiet' WHEN l > q * 1.5 THEN 'loud' ELSE 'moderate' END AS noise_level
FROM (SELECT doc_id, {_hits(QUIET)} AS q, {_hits(LOUD)} AS l FROM (SELECT doc_id, {TOKENS} AS toks FROM ({T})))"""


def noise_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.noise_substrings(documents(spark, sf_dir), "doc_id", QUIET, LOUD)
    value = scoring.noise_component(F.col("quiet_hits"), F.col("loud_hits"))
    return counts.select("doc_id", "quiet_hits", "loud_hits", F.round(value, 9).alias("quiet"))


def _substr_hits(words: list[str]) -> str:
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)


def secondhand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.secondhand_mentions(documents(spark, sf_dir), "source", ["tion", "the", "is that"])


def clean_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    return d.select("doc_id", texts.clean_snippet(F.col("text")).alias("snippet"))


def postal_and_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    return d.select("doc_id", texts.postal_code(F.col("text")).alias("postal_code"), texts.phone_number(F.col("text")).alias("phone"))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT doc_id, text, lang, source FROM {documents}")
    return d.where(serve.text_filter("Tion the EN", [F.col("text"), F.col("lang")])).select("doc_id", "lang")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    return d.select("doc_id", texts.content_hash(F.col("text")).alias("content_hash"))


# --- pages -----------------------------------------------------------------------------------------
PLAIN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(X,
  '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g'))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT page_id, url, html FROM {pages}")


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_metadata(_pages(spark, sf_dir)).select("page_id", "title", "content_hash")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-site links of every page, listicle-looking ones first, five per page."""
    rows = pages.discover_links(_pages(spark, sf_dir), r"^/[A-Za-z]{2,}")
    return rows.select("page_id", "rank", "link", "score")


DUCK_LINKS = r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href,
   generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), 1) AS n FROM pages),
l AS (SELECT page_id, url, string_split(origin || replace(href, '&amp;', '&'), '#')[1] AS link, n FROM h WHERE starts_with(href, '/')),
u AS (SELECT page_id, url, link, min(n) AS n FROM l GROUP BY 1, 2, 3),
s AS (SELECT *, (contains(lower(link), 'best'))::INT + contains(lower(link), 'top')::INT + contains(lower(link), 'guide')::INT + contains(lower(link), 'places')::INT + contains(lower(link), 'cafes')::INT + contains(lower(link), 'restaurants')::INT AS score
  FROM u WHERE rtrim(link, '/') <> rtrim(url, '/') AND regexp_matches(regexp_replace(link, '^[a-zA-Z]+://[^/?#]*', ''), '^/[A-Za-z]{2,}'))
SELECT page_id, rank, link, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n) AS rank FROM s) WHERE rank <= 5"""


def _part_pages(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    """A landed page per part, its HTML written from the part's own columns."""
    v = venues(spark, sf_dir)
    return v.select(
        F.col("part_no").alias("page_id"), F.lit("src0").alias("source_key"),
        F.concat(F.lit("https://host"), F.col("part_no") % 7, F.lit(".test/list/page")).alias("url"), body.alias("html"),
    )


def listicle_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit("<html><body><article><h1>Top</h1><h2>"), F.col("part_no") % 20 + 1, F.lit(". "), F.initcap("name"),
        F.lit(" – best in town</h2><p>Good value for its size of "), "size", F.lit(" seats.</p><p>Address: "), F.col("size"),
        F.lit(" Long Road, Singapore "), "postal_code", F.lit("</p><p>Tel: 6"), F.lpad(F.col("part_no") % 1000, 3, "0"),
        F.lit(" 4321</p><h2>Conclusion</h2><p>That was the whole list for today.</p></article></body></html>"),
    )
    rows = pages.extract_listicles(_part_pages(spark, sf_dir, body)).where(pages.is_listing())
    return rows.select("page_id", F.lower("name").alias("name"), "postal_code", "phone", "address")


def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: F.concat(
        F.lit('<div class="card x"><h3><a href="/r/'), F.col("part_no") + n, F.lit('">'), F.initcap("name"), F.lit(f" {n}</a></h3><b class='score'>"),
        F.round(F.col("size") / 10, 1), F.lit(" stars</b><i>(1,"), F.lpad("size", 3, "0"), F.lit(" reviews)</i><em>Thai · Bar</em></div>"),
    )
    body = F.concat(F.lit("<main>"), one(1), one(2), F.lit("<div class='card'>nothing</div></main>"))
    selectors = {"card": "div.card", "name": "h3", "rating": ".score", "review_count": "i", "cuisine": "em"}
    dim = spark.createDataFrame([("src0", selectors)], "source_key string, selectors map<string,string>")
    rows = pages.extract_cards(_part_pages(spark, sf_dir, body), dim)
    return rows.select("page_id", F.lower("name").alias("name"), "url", "rating", "review_count", F.array_join("cuisine", ",").alias("cuisine"))


def jsonld_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.to_json(
        F.struct(
            F.lit("ItemList").alias("@type"),
            F.array(
                F.struct(
                    F.struct(
                        F.lit("Restaurant").alias("@type"), F.col("name").alias("name"), F.concat(F.lit("/v/"), "part_no").alias("url"),
                        F.struct(F.concat(F.col("size").cast("string"), F.lit(" Road")).alias("streetAddress"), F.col("postal_code").alias("postalCode")).alias("address"),
                        F.struct((F.col("size") / 10).alias("ratingValue"), F.col("size").alias("reviewCount")).alias("aggregateRating"),
                        F.lit("Thai").alias("servesCuisine"),
                    ).alias("item")
                )
            ).alias("itemListElement"),
        )
    )
    body = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    rows = pages.extract_jsonld(_part_pages(spark, sf_dir, body))
    return rows.select("page_id", "name", "url", "address", "rating", "review_count", F.array_join("cuisine", ",").alias("cuisine"))


def jsonld_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a business inside up to eight item lists, every third block in a graph; each seventh list has an owner
    without a name, which hides it."""
    leaf = F.to_json(F.struct(F.lit("BarOrPub").alias("@type"), "name"))
    nested = F.aggregate(
        F.sequence(F.lit(1), (F.col("part_no") % 9).cast("int")), leaf,
        lambda inner, _: F.concat(F.lit('{"@type":"ItemList","itemListElement":[{"position":1},{"item":'), inner, F.lit("}]}")),
    )
    nested = F.when(F.col("part_no") % 9 == 0, leaf).otherwise(nested)
    owned = F.concat(F.lit('{"@type":"Restaurant","name":" ","itemListElement":['), nested, F.lit("]}"))
    block = F.when(F.col("part_no") % 7 == 0, owned).otherwise(nested)
    block = F.when(F.col("part_no") % 3 == 0, F.concat(F.lit('{"@graph":['), block, F.lit("]}"))).otherwise(block)
    body = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    rows = pages.extract_jsonld(_part_pages(spark, sf_dir, body))
    return rows.select("page_id", "name", (F.size("at") - 2).alias("depth"))


def guide_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.lower("michelin"), F.lit(""))
    body = F.concat(F.lit("<article class='restaurant-card'><h3>"), "name", F.lit("</h3><span class='award'>"), label, F.lit("</span></article>"))
    dim = spark.createDataFrame([("src0", {"card": "article.restaurant-card", "name": "h3", "award": ".distinction, .award"})], "source_key string, selectors map<string,string>")
    rows = pages.guide_listings(pages.extract_cards(_part_pages(spark, sf_dir, body), dim))
    return rows.select("page_id", "michelin")


def article_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of blog articles re-checked against the queries that found them."""
    v = venues(spark, sf_dir)
    slug = (
        F.when(F.col("part_no") % 4 == 0, "/best-thai-food-singapore").when(F.col("part_no") % 4 == 1, "/thai-dim-sum-brunch")
        .when(F.col("part_no") % 4 == 2, "/bali-thai-food-guide").otherwise("/cruise-deals")
    )
    evidence = v.select(
        "venue_id", F.when(F.col("part_no") % 5 == 0, "api").otherwise("blog").alias("source_key"),
        F.concat(F.lit("https://b.test"), slug, F.lit("-"), "part_no").alias("url"),
        F.array(F.lit("best thai food"), F.lit("weekend dim sum brunch")).alias("queries"), F.array(F.lit("old")).alias("category_keys"),
    )
    queries = spark.createDataFrame([("best thai food", "thai"), ("weekend dim sum brunch", "dimsum")], "query string, category_key string")
    kinds = spark.createDataFrame([("blog", "blog"), ("api", "api")], "source_key string, kind string")
    rows = prune_evidence(evidence, v, queries, kinds, pages.relevant_article)
    return rows.select("venue_id", F.array_join("queries", ",").alias("queries"), F.array_join("category_keys", ",").alias("category_keys"), "dropped")


DUCK_PRUNED = f"""SELECT venue_id, CASE WHEN part_no % 5 = 0 THEN 'best thai food,weekend dim sum brunch' WHEN part_no % 4 = 0 THEN 'best thai food' WHEN part_no % 4 = 1 THEN 'best thai food,weekend dim sum brunch' ELSE '' END AS queries,
 CASE WHEN part_no % 5 = 0 THEN 'old' WHEN part_no % 4 = 0 THEN 'thai' WHEN part_no % 4 = 1 THEN 'dimsum,thai' ELSE 'old' END AS category_keys,
 part_no % 5 <> 0 AND part_no % 4 IN (2, 3) AS dropped FROM ({V})"""


# --- threads ---------------------------------------------------------------------------------------
def flatten_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "SELECT conv_id, turn, text FROM {conversations}")
    rows = c.select("conv_id", F.array("turn").alias("path"), F.col("text").alias("body"))
    flat = threads.flatten_threads(rows, 4, "conv_id")
    return flat.select("conv_id", "position", F.length("body").alias("chars"))


def comment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a thread in which every turn answers the one before and has a short second answer beside it."""
    c = view(spark, sf_dir, "SELECT conv_id, turn, coalesce(text, '') AS text FROM {conversations}")
    # the test table's conversations are short; a thread is one document as the API returns it
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.to_json(F.struct(t["text"].alias("body"))))
    children = F.aggregate(
        F.reverse(turns), F.lit("[]"),
        lambda below, t: F.concat(
            F.lit('[{"data":'), F.substring(t, F.lit(1), F.length(t) - 1), F.lit(',"replies":{"data":{"children":'), below,
            F.lit('}}}},{"data":{"body":"beside","replies":""}}]'),
        ),
    )
    raw = c.groupBy("conv_id").agg(children.alias("children")).select(F.col("conv_id").alias("thread_id"), F.lit("own").alias("selftext"), "children")
    tree = threads.comment_tree(raw)
    flat = threads.flatten_threads(tree)
    return flat.select(F.col("thread_id").alias("conv_id"), "position", F.length("body").alias("chars"))


DUCK_TREE = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS i, coalesce(text, '') AS text FROM conversations),
b AS (SELECT DISTINCT conv_id, 0 AS part, 0 AS i, 'own' AS body FROM t UNION ALL SELECT conv_id, 1, i, text FROM t UNION ALL SELECT conv_id, 2, -i, 'beside' FROM t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS position, length(trim(body)) AS chars FROM b WHERE trim(body) NOT IN ('', '[deleted]', '[removed]'))
SELECT * FROM o WHERE position <= 100"""


def extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold, listed and spoken names in comments written from the parts."""
    brand = F.concat(F.lit("House B"), F.col("size"))
    body = F.concat(
        F.lit("**"), F.initcap("name"), F.lit("** is fine\n- Old "), F.initcap("type_label"), F.lit(": ok\nWe ate at "), brand,
        F.lit(" and tried "), F.lit("Bukit Timah"), F.lit(" but from Singapore"),
    )
    rows = venues(spark, sf_dir).select(F.col("part_no").alias("thread_id"), F.lit(1).alias("position"), body.alias("body"))
    return threads.extract_names(rows).select("thread_id", F.lower("name").alias("name"), "confidence")


# --- derived strings ---------------------------------------------------------------------------------
def normalise_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.col("part_no") * 7 % 190 + 1).cast("int")
    a = amount.cast("string")
    kind = F.col("part_no") % 6
    label = (
        F.when(kind == 0, F.concat(F.lit("S$"), a)).when(kind == 1, F.concat(a, F.lit("-"), (amount + 20).cast("string"), F.lit(" SGD")))
        .when(kind == 2, F.concat(F.lit("about $"), a, F.lit(" nett"))).when(kind == 3, F.concat(F.lit("RM"), a, F.lit(" per pax")))
        .when(kind == 4, F.concat(a, F.lit(" per pax"))).otherwise(F.repeat(F.lit("$"), amount % 4 + 1))
    )
    return venues(spark, sf_dir).select("venue_id", label.alias("price_text")).select("venue_id", "price_text", price.price_level(F.col("price_text")).alias("price_level"))


DUCK_PRICE = f"""SELECT venue_id, CASE k WHEN 0 THEN 'S$' || a WHEN 1 THEN a || '-' || (a + 20) || ' SGD' WHEN 2 THEN 'about $' || a || ' nett' WHEN 3 THEN 'RM' || a || ' per pax' WHEN 4 THEN a || ' per pax' ELSE repeat('$', a % 4 + 1) END AS price_text,
  CASE WHEN k = 3 THEN NULL WHEN k = 5 THEN a % 4 + 1 ELSE 1 + (x >= 25)::INT + (x >= 60)::INT + (x >= 120)::INT END AS price_level
FROM (SELECT *, CASE WHEN k = 1 THEN a + 10 ELSE a END AS x FROM (SELECT venue_id, CAST(part_no * 7 % 190 + 1 AS INT) AS a, CAST(part_no % 6 AS INT) AS k FROM ({V})))"""


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "SELECT p_partkey AS part_no, p_name, p_size FROM {part}")
    styled = F.concat(F.lit("The "), F.initcap(F.replace("p_name", F.lit("e"), F.lit("é"))), F.lit(" Restaurant Pte Ltd @ Outlet "), "p_size")
    named = p.select("part_no", styled.alias("n"))
    split = named.select("part_no", names.name_key(F.col("n")).alias("name_key"), names.brand_outlet(F.col("n")).alias("b"), names.handle_key(F.col("n")).alias("handle_key"))
    return split.select("part_no", "name_key", "b.outlet")


def cuisine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part_no") % 4
    labels = (
        F.when(kind == 0, F.array(F.lit("Zi Char place"), F.lit("seafood_restaurant"), F.lit("restaurant")))
        .when(kind == 1, F.array(F.lit("coffee shop"), F.lit("Tapas & wine bar"))).when(kind == 2, F.array(F.lit("restaurant"), "type_label"))
        .otherwise(F.array("type_label"))
    )
    v = venues(spark, sf_dir).select("venue_id", price.cuisines(labels).alias("c"))
    return v.select("venue_id", F.array_join("c", ",").alias("cuisines"), price.primary_cuisine(F.col("c")).alias("primary"))


def cuisine_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part_no") % 5
    blob = (
        F.when(kind == 0, F.concat("name", F.lit(" sushi and chilli crab"))).when(kind == 1, F.concat("name", F.lit(" french toast cafe")))
        .when(kind == 2, F.concat("name", F.lit(" Thai laksa and pastries"))).when(kind == 3, F.concat("name", F.lit(" Bistro PIZZA"))).otherwise(F.col("name"))
    )
    return venues(spark, sf_dir).select("venue_id", F.array_join(price.cuisine_tabs(blob), ",").alias("cuisines"))


def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.col("part_no") % 4 + 8, F.col("part_no") % 9 + 1
    line = F.concat(
        F.lit("Mon-Fri "), start, F.lit("am-"), end, F.lit(".30pm, 6-"), F.col("part_no") % 3 + 9, F.lit("pm; Sat 11 - 2pm; Closed on Sun")
    )
    v = venues(spark, sf_dir).select("venue_id", hours.opening_hours(F.lit(None).cast("array<string>"), line).alias("h"))
    v = v.select("venue_id", "h", hours.hours_flags(F.col("h")).alias("f"))
    show = lambda d: F.array_join(F.transform(F.try_element_at("h", F.lit(d)), lambda r: F.concat(r["open"], F.lit("-"), r["close"])), ",")
    return v.select("venue_id", show("wed").alias("wed"), show("sat").alias("sat"), show("sun").alias("sun"), "f.open_weekends", "f.late_night", "f.ph_closed")


DUCK_HOURS = f"""SELECT venue_id, lpad(CAST(part_no % 4 + 8 AS STRING), 2, '0') || ':00-' || (part_no % 9 + 13) || ':30,18:00-' || (part_no % 3 + 21) || ':00' AS wed, '11:00-14:00' AS sat, '' AS sun,
 true AS open_weekends, part_no % 3 = 2 AS late_night, CAST(NULL AS BOOLEAN) AS ph_closed FROM ({V})"""


def award_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part_no") % 7
    said = (
        F.when(kind == 0, F.concat("name", F.lit(" is a Bib Gourmand place"))).when(kind == 1, F.concat(F.lit("The two Michelin stars of "), "name", F.lit(" are deserved")))
        .when(kind == 2, F.concat("name", F.lit(" is led by the head chef of Michelin-starred Alpha in town")))
        .when(kind == 3, F.concat(F.lit("Fans of one Michelin-starred Beta. "), "name", F.lit(" is a three-Michelin-starred room")))
        .when(kind == 4, F.concat("name", F.lit(" by a Michelin-starred chef"))).when(kind == 5, F.concat("name", F.lit(" is Michelin-starred."))).otherwise(F.concat("name", F.lit(" is a Michelin-starred place")))
    )
    award = awards.award_from_text(said)
    v = venues(spark, sf_dir).select("venue_id", award.alias("award"))
    return v.select("venue_id", "award", awards.star_count(F.coalesce("award", F.lit(""))).alias("stars"), awards.award_level(F.col("award")).alias("level"), awards.award_label(F.col("award")).alias("label"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = venues(spark, sf_dir)
    best = ratings(spark, sf_dir).where("source_key = 'src0'").select("venue_id", F.round("rating", 2).alias("rating"), "review_count")
    counts = ratings(spark, sf_dir).groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    rows = v.join(best, "venue_id", "left").join(counts, "venue_id", "left")
    told = awards.verdict(
        F.col("business_status"), F.col("rating"), F.col("review_count"), F.col("hygiene_grade"), F.col("michelin"), F.col("rating_trend"),
        F.when(F.col("part_no") % 37 == 0, (F.col("part_no") % 20 + 1).cast("int")), F.coalesce("n", F.lit(0)),
    )
    rows = rows.select("venue_id", told.alias("t"))
    return rows.select("venue_id", "t.worth", F.regexp_replace("t.reason", "★ .* from", "★ from").alias("reason"))


DUCK_VERDICT = f"""SELECT v.venue_id, r[1] = 'y' AS worth, r[2:] AS reason FROM (
 SELECT v.venue_id, CASE WHEN business_status LIKE 'CLOSED%' THEN 'nclosed' WHEN review_count >= 20 AND rating < 4.0 THEN 'nonly ★ from ' || review_count || ' reviews'
  WHEN hygiene_grade IN ('C', 'D') THEN 'nhygiene grade ' || hygiene_grade WHEN michelin = 'Bib Gourmand' THEN 'yBib Gourmand' WHEN michelin LIKE '%Star%' THEN 'yMichelin ' || michelin
  WHEN rating_trend = 'declining' THEN 'nrating is falling' WHEN review_count >= 20 AND rating >= 4.2 THEN 'y★ from ' || review_count || ' reviews'
  WHEN part_no % 37 = 0 AND part_no % 20 + 1 <= 10 THEN 'y#' || (part_no % 20 + 1) || ' on its list' WHEN coalesce(n, 0) >= 2 THEN 'yrecommended by ' || n || ' sources' ELSE 'ntoo little proof yet' END AS r
 FROM ({V}) v LEFT JOIN (SELECT venue_id, round(rating, 2) AS rating, review_count FROM ({DUCK_RATINGS}) WHERE source_key = 'src0') b ON b.venue_id = v.venue_id
 LEFT JOIN (SELECT venue_id, count(*) AS n FROM ({DUCK_RATINGS}) GROUP BY 1) c ON c.venue_id = v.venue_id) v"""


def clean_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part_no") % 4
    heading = (
        F.when(kind == 0, F.concat(F.col("part_no") % 30, F.lit(". "), "name", F.lit(" – best in town")))
        .when(kind == 1, F.concat(F.lit("New restaurant: "), "name")).when(kind == 2, F.concat("name", F.lit(" is opening at Long Mall")))
        .otherwise(F.concat(F.lit("  #"), F.col("part_no") % 30, F.lit(") "), "name", F.lit(" [Closed]")))
    )
    v = venues(spark, sf_dir)
    return v.select("venue_id", texts.clean_heading(heading).alias("heading"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with names and addresses from the parts: which pass, and what is derived."""
    v = venues(spark, sf_dir)
    kind = F.col("part_no") % 10
    rows = v.select(
        "part_no",
        F.when(kind == 0, "  ").when(kind == 1, "July 2001").when(kind == 2, F.lit("12 Feb")).otherwise(F.concat(F.lit(" "), F.replace("name", F.lit(" "), F.lit("  ")))).alias("name"),
        F.concat(F.lit("1 Road, Singapore "), "postal_code", F.lit(" tel 91234567")).alias("address"), F.lit(None).cast("string").alias("postal_code"),
        F.lit(None).cast("string").alias("phone"), F.lit("a  b").alias("snippet"), (F.col("size") / 20).alias("confidence"),
    )
    good, bad = validate.validate_sightings(rows)
    return good.select("part_no", "name", "postal_code", "phone", "confidence", F.lit("ok").alias("outcome")).union(
        bad.select("part_no", F.lit(None), F.lit(None), F.lit(None), F.lit(None), "reject_reason")
    )


DUCK_VALID = f"""SELECT part_no, CASE WHEN part_no % 10 > 2 THEN name END AS name, CASE WHEN part_no % 10 > 2 THEN postal_code END AS postal_code, CASE WHEN part_no % 10 > 2 THEN '+65 9123 4567' END AS phone,
 CASE WHEN part_no % 10 > 2 THEN least(1.0, size / 20::DOUBLE) END AS confidence, CASE WHEN part_no % 10 = 0 THEN 'empty name' WHEN part_no % 10 <= 2 THEN 'not a venue name' ELSE 'ok' END AS outcome FROM ({V})"""


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored venues re-derived: news wording out of names, levels and awards read again."""
    v = venues(spark, sf_dir)
    stored = v.select(
        "venue_id", F.concat("name", F.lit(" is opening at Long Mall")).alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("outlet"),
        F.lit(1).alias("price_level"), F.concat(F.lit("S$"), F.col("size") * 4).alias("price_text"), F.when(F.col("part_no") % 3 == 0, "g").alias("google_place_id"), "michelin",
    )
    evidence = v.select(
        "venue_id", F.when(F.col("part_no") % 2 == 0, "michelin").otherwise("blog").alias("source_key"), F.lit("u").alias("url"), F.lit(1.0).alias("confidence"),
        F.when(F.col("part_no") % 5 == 0, "A Bib Gourmand stall indeed").otherwise("Nice").alias("snippet"),
    )
    return refresh_venues(stored, evidence).select("venue_id", "name", "price_level", "michelin")


DUCK_REFRESH = f"""SELECT venue_id, name, CASE WHEN part_no % 3 = 0 THEN 1 ELSE 1 + (size * 4 >= 25)::INT + (size * 4 >= 60)::INT + (size * 4 >= 120)::INT END AS price_level,
 CASE WHEN part_no % 2 = 0 THEN michelin WHEN part_no % 5 = 0 THEN 'Bib Gourmand' END AS michelin FROM ({V})"""


# --- payloads ----------------------------------------------------------------------------------------
def register_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "SELECT s_suppkey AS _id, upper(s_name) || ' O''NEIL' AS licensee_name, '' AS premises_address, CAST(s_suppkey * 997 % 100000 AS STRING) AS postal_code, CASE s_suppkey % 3 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' ELSE '' END AS grade FROM {supplier}")
    rows = payloads.catalogue_to_sightings(s)
    return rows.select("source_ref", "name", "postal_code", "hygiene_grade", "confidence")


def places_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested place payloads written from parts as JSON text, parsed with the payload schema."""
    v = venues(spark, sf_dir)
    place = F.struct(
        F.col("venue_id").alias("id"), F.struct(F.when(F.col("part_no") % 9 > 0, F.col("name")).alias("text")).alias("displayName"),
        F.array(F.struct(F.col("postal_code").alias("longText"), F.array(F.lit("postal_code")).alias("types"))).alias("addressComponents"),
        F.concat(F.lit("PRICE_LEVEL_"), F.when(F.col("size") % 2 == 0, "MODERATE").otherwise("EXPENSIVE")).alias("priceLevel"),
        F.array(F.lit("thai_restaurant"), F.lit("store"), F.lit("cafe")).alias("types"), (F.col("part_no") % 2 == 0).alias("reservable"),
        F.concat(F.lit("https://maps.test/"), "part_no").alias("googleMapsUri"),
        F.array(F.struct((F.col("size") % 5 + 1).cast("double").alias("rating"), F.struct(F.lit(" so  VIRAL on tiktok ").alias("text")).alias("text"))).alias("reviews"),
    )
    raw = v.select(F.to_json(F.struct(F.array(place).alias("places"))).alias("body"))
    parsed = raw.select(F.from_json("body", payloads.PLACES).alias("r")).select("r.*")
    rows = payloads.places_to_sightings(parsed)
    both = rows.unionByName(payloads.reservable_view(rows), allowMissingColumns=True)
    return both.select(
        "source_key", "source_ref", "name", "postal_code", "price_level", F.array_join("cuisine", ",").alias("cuisine"), "booking_url",
        F.get("extra.reviews", F.lit(0))["social_words"].alias("social_words"), F.get("extra.reviews", F.lit(0))["snippet"].alias("review"),
    )


DUCK_PLACES = f"""WITH p AS (SELECT *, 'https://maps.test/' || part_no AS uri, CASE WHEN size % 2 = 0 THEN 2 ELSE 3 END AS l FROM ({V}) WHERE part_no % 9 > 0)
SELECT 'google_places' AS source_key, venue_id AS source_ref, name, postal_code, l AS price_level, 'thai_restaurant,cafe' AS cuisine, CASE WHEN part_no % 2 = 0 THEN uri END AS booking_url, 2 AS social_words, 'so VIRAL on tiktok' AS review FROM p
UNION ALL SELECT 'google_reserve', venue_id, name, postal_code, l, 'thai_restaurant,cafe', uri, NULL, NULL FROM p WHERE part_no % 2 = 0"""


def search_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search index results written from events."""
    e = view(spark, sf_dir, "SELECT event_id, user_id, ts, event_type FROM {events}")
    result = F.struct(
        F.col("event_type").alias("title"), F.concat(F.lit("https://www.instagram.com/user."), "user_id", F.lit("/?x="), "event_id").alias("link"),
        F.concat(F.lit("seen "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" there")).alias("snippet"), F.lit(None).cast("string").alias("date"),
    )
    other = F.struct(F.lit("x").alias("title"), F.lit("https://z.test").alias("link"), F.lit("").alias("snippet"), F.lit("").alias("date"))
    rows = e.select(F.col("event_id").cast("string").alias("query"), F.lit("instagram.com").alias("site"), F.array(result, other).alias("organic_results"))
    return payloads.search_result_mentions(rows).select("query", "url", "creator_handle", "post_date", "caption")


# --- places ------------------------------------------------------------------------------------------
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = view(spark, sf_dir, STATIONS).withColumn("lines", F.array(F.lit("L1")))
    rows = enrich.nearest_station(view(spark, sf_dir, PLACES), stations)
    return rows.select("venue_id", "station", F.round("metres", 3).alias("metres"))


def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbour against a table that grows: suppliers as stations, by grid cells."""
    s = view(spark, sf_dir, "SELECT s_name AS name, 1.2E0 + (s_suppkey * 7 % 997) / CAST(4000 AS DOUBLE) AS lat, 1.036E2 + (s_suppkey * 331 % 991) / CAST(2000 AS DOUBLE) AS lng FROM {supplier}")
    rows = enrich.nearest_by_grid(view(spark, sf_dir, PLACES), s.withColumn("lines", F.array().cast("array<string>")))
    return rows.select("venue_id", F.round("metres", 3).alias("metres"))


_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))"


def postal_geocode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates by postal code where missing, district and region by sector."""
    p = view(spark, sf_dir, PLACES)
    missing = p.select(
        "venue_id", "postal_code", *[F.when(F.col("balance") > 4000, F.col(c)).alias(c) for c in ("lat", "lng")]
    )
    answers = p.where("nation_no % 2 = 0").select(
        F.col("postal_code").alias("query_postal"), F.col("postal_code").alias("result_postal"), F.col("lat").alias("lat"), F.col("lng").alias("lng"), F.col("venue_id").alias("position")
    )
    rows = enrich.geocode(missing, answers)
    region = geo.sector_region(F.col("postal_code"))
    return rows.select("venue_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "geocoded", region["region"].alias("region"))


_REGIONS: dict[str, list[str]] = {}
for _, _r, _s in POSTAL_SECTORS:
    _REGIONS.setdefault(_r, []).extend(_s.split())
DUCK_GEO = f"""SELECT p.venue_id, round(CASE WHEN balance > 4000 THEN p.lat ELSE a.lat END, 6) AS lat, round(CASE WHEN balance > 4000 THEN p.lng ELSE a.lng END, 6) AS lng,
 CASE WHEN balance <= 4000 THEN a.lat IS NOT NULL END AS geocoded, CASE {" ".join(f"WHEN substr(p.postal_code, 1, 2) IN ({', '.join(repr(x) for x in s)}) THEN '{r}'" for r, s in _REGIONS.items())} END AS region
FROM ({G}) p LEFT JOIN (SELECT postal_code, arg_min(lat, venue_id) AS lat, arg_min(lng, venue_id) AS lng FROM ({G}) WHERE nation_no % 2 = 0 GROUP BY 1) a ON a.postal_code = p.postal_code"""


def near_me(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.near_me(view(spark, sf_dir, PLACES), 1.3, 103.85, 5.0)
    return rows.select("venue_id", F.round("distance_km", 6).alias("distance_km"))


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = venues(spark, sf_dir)
    return v.select(
        "venue_id", "name", "region", "price_level", "open_weekends", F.coalesce(F.try_element_at("flags", F.lit("halal")), F.lit(False)).alias("halal"), "lat", "lng",
        awards.award_label(F.col("michelin")).alias("michelin"), (F.col("part_no") % 3 > 0).alias("worth"), (F.col("part_no") % 29 == 0).alias("new"), "cuisine",
        F.when(F.col("part_no") % 2 == 0, (F.col("part_no") % 40 + 1).cast("int")).alias("best_rank"), (F.col("part_no") % 4).cast("int").alias("lists"),
        F.array(F.element_at(F.split("name", " "), 2), F.element_at(F.split("name", " "), 1)).alias("cuisines"),
    )


def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a search with facets."""
    rows = serve.search_venues(_site(spark, sf_dir), "brand ECONOMY", limit=20, offset=5, worth=True, max_price=3, weekend=True)
    return rows.select("venue_id", "name", "best_rank")


def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serve.search_venues(_site(spark, sf_dir), "", near=(1.3, 103.85, 8.0), limit=30, halal=True, awarded=True)
    return rows.select("venue_id", F.round("distance_km", 6).alias("distance_km"))


DUCK_SITE = f"SELECT *, CASE WHEN part_no % 2 = 0 THEN part_no % 40 + 1 END AS best_rank, part_no % 4 AS lists, part_no % 3 > 0 AS worth FROM ({V})"


def all_places_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names differ only in letters, so the collation orders them as bytes do."""
    return serve.all_places(_site(spark, sf_dir).withColumn("name", F.col("venue_id"))).select("venue_id", "position")


DUCK_ALL = f"SELECT venue_id, row_number() OVER (ORDER BY worth DESC, coalesce(best_rank, 999), lists DESC, venue_id) AS position, name FROM ({DUCK_SITE})"


def cuisine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = serve.all_places(_site(spark, sf_dir).withColumn("name", F.col("venue_id")))
    return serve.cuisine_lists(places)


def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.site_totals(_site(spark, sf_dir))


def occasion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.plans.standins import PARAMS

    v = venues(spark, sf_dir)
    ranked = v.select(F.lit("occasion").alias("category_key"), "venue_id", (F.col("part_no") + 1).cast("int").alias("rank"), F.lit(None).cast("string").alias("excluded_reason"), F.lit(False).alias("hidden"))
    rows = serve.occasion_list(ranked, v, "occasion", PARAMS)
    return rows.select("venue_id", "stars", "rank", "award", "bill_for_4")


# --- matching ----------------------------------------------------------------------------------------
def exact_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the parts are known venues, all are looked up with partly missing keys."""
    v = venues(spark, sf_dir)
    key = names.name_key(F.col("name"))
    keyed = v.select("venue_id", "part_no", key.alias("name_key"), "postal_code")
    nothing = F.lit(None).cast("string")
    index = keyed.where("part_no % 2 = 0").select(
        F.col("venue_id").alias("entity"), F.when(F.col("part_no") % 6 == 0, F.col("venue_id")).alias("place_id"), "name_key",
        F.when(F.col("part_no") % 10 > 0, F.col("postal_code")).alias("postal"), F.concat(F.lit("+65 "), F.col("part_no") % 500).alias("phone"), nothing.alias("booking"),
        F.lit(0).alias("since"), F.col("part_no").alias("entity_ord"),
    )
    rows = keyed.select(
        F.col("venue_id").alias("node"), F.when(F.col("part_no") % 3 == 0, F.col("venue_id")).alias("place_id"), "name_key",
        F.when(F.col("part_no") % 4 > 0, F.col("postal_code")).alias("postal"), F.when(F.col("part_no") % 7 == 0, F.concat(F.lit("+65 "), F.col("part_no") % 500)).alias("phone"), nothing.alias("booking"),
        F.lit(1).alias("ord"),
    )
    return resolve.match_exact(rows, index).select("node", "entity", "method")


DUCK_KEY = NAME_KEY
DUCK_TIERS = f"""WITH k AS (SELECT venue_id, part_no, postal_code, {DUCK_KEY} AS name_key FROM ({V})),
i AS (SELECT venue_id AS entity, part_no AS o, CASE WHEN part_no % 6 = 0 THEN venue_id END AS place_id, name_key, CASE WHEN part_no % 10 > 0 THEN postal_code END AS postal, '+65 ' || (part_no % 500) AS phone FROM k WHERE part_no % 2 = 0),
r AS (SELECT venue_id AS node, CASE WHEN part_no % 3 = 0 THEN venue_id END AS place_id, name_key, CASE WHEN part_no % 4 > 0 THEN postal_code END AS postal, CASE WHEN part_no % 7 = 0 THEN '+65 ' || (part_no % 500) END AS phone FROM k),
c AS (SELECT node, entity, o, 1 AS tier, 'place_id' AS method FROM r JOIN i USING (place_id)
 UNION ALL SELECT node, entity, o, 2, 'name_postal' FROM r JOIN i USING (name_key, postal)
 UNION ALL SELECT node, entity, o, 3, 'phone' FROM r JOIN i USING (phone)
 UNION ALL SELECT node, entity, o, 5, 'name_exact' FROM r JOIN i USING (name_key) WHERE r.postal IS NULL OR i.postal IS NULL)
SELECT node, arg_min(entity, {{'a': tier, 'b': o}}) AS entity, arg_min(method, {{'a': tier, 'b': o}}) AS method FROM c GROUP BY 1"""


RESOLVABLE = """SELECT l.l_partkey AS part_no, l.l_linenumber AS line_no, l.l_orderkey AS order_no,
      CASE WHEN l.l_partkey % 5 = 0 AND l.l_linenumber = 3 THEN substr(p.p_name, 2) WHEN l.l_partkey % 7 = 0 AND l.l_linenumber = 6 THEN replace(p.p_name, ' ', '') ELSE p.p_name END || ' ' || p.p_brand AS name,
      'src' || CAST(l.l_suppkey % 8 AS STRING) AS source_key, round(1 - 5 * l.l_discount, 2) AS c,
      CASE WHEN l.l_linenumber % 3 > 0 THEN lpad(CAST(l.l_partkey * 37 % 1000000 AS STRING), 6, '0') END AS p,
      CASE WHEN l.l_suppkey % 5 = 0 THEN '+65 9' || lpad(CAST(l.l_partkey AS STRING), 7, '0') END AS t,
      CASE WHEN l.l_linenumber = 4 THEN 'https://book.test/' || CAST(l.l_partkey AS STRING) END AS b
      FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey"""


def _resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of order lines: the part's name, some of them misspelt, with a postal code on two lines of three, a phone from
    some suppliers and a booking link on some lines."""
    from placerank.schemas import SIGHTING

    rows = view(spark, sf_dir, RESOLVABLE)
    seq = F.col("order_no") * 1000000000 + F.col("line_no") * 100000000 + F.col("part_no")
    known = {"name": F.col("name"), "source_key": F.col("source_key"), "confidence": F.col("c"), "postal_code": F.col("p"), "phone": F.col("t"), "booking_url": F.col("b"), "seq": seq, "run_id": F.lit("r1")}
    shape = spark.createDataFrame([], SIGHTING).schema
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tiers on every order line: stable ids in creation order, size of every venue; `match_stats` runs all tiers."""
    done = resolve.resolve(_resolvable(spark, sf_dir), fuzzy=False)
    return done.assignments.groupBy("venue_id").agg(F.count(F.lit(1)).alias("sightings"), F.min("kept_name").alias("name"))


_NUMBERED = "SELECT name, c, p, t, b, order_no * 1000000000 + line_no * 100000000 + part_no AS seq FROM (" + duck(RESOLVABLE) + ")"
DUCK_RESOLVE = f"WITH {resolution(_NUMBERED, fuzzy=False)} SELECT venue_id, count(*) AS sightings, min(kept_name) AS name FROM done GROUP BY 1"
DUCK_STATS = f"WITH {resolution(_NUMBERED)} SELECT method, count(*) AS sightings FROM done GROUP BY 1"


def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of a whole run, fuzzy tier included."""
    done = resolve.resolve(_resolvable(spark, sf_dir))
    return resolve.match_stats(done.assignments)


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts matched with misspelt versions of themselves."""
    p = view(spark, sf_dir, "SELECT DISTINCT p_name || ' ' || lower(replace(p_brand, '#', ' ')) AS text FROM {part}")
    typo = p.select(F.regexp_replace("text", "^(.)(.)(.*)$", "$2$1$3s").alias("text"))
    pairs = similar_texts(p, typo).withColumn("score", token_set_ratio_udf("left_text", "right_text"))
    return pairs.where("score >= 88").select("left_text", "right_text", F.round("score", 3).alias("score"))


def handle_caption_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and venues written from parts: by handle, by caption, or unmatched."""
    v = view(spark, sf_dir, "SELECT 'v' || lpad(CAST(p_partkey AS STRING), 8, '0') AS venue_id, p_name || ' ' || p_brand AS name FROM {part}")
    v = v.withColumns({"name_zh": F.lit(None).cast("string"), "brand": F.lit(None).cast("string")})
    keys = social.matcher_keys(v, v.select("venue_id", F.col("name").alias("alias")))
    m = view(spark, sf_dir, "SELECT p_partkey AS s_suppkey, p_name || ' ' || p_brand AS n FROM {part}")
    mentions = m.select(
        F.lit("serp").alias("source"), F.concat(F.lit("u"), "s_suppkey").alias("url"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Dinner at "), F.initcap("n"), F.lit(" tonight, so nice"))).alias("caption"),
        F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.replace(F.lower("n"), F.lit(" "), F.lit("_")), F.lit("_sg"))).alias("creator_handle"),
        F.lit(None).cast("string").alias("venue_id"), F.lit(None).cast("string").alias("matched_by"), F.lit(None).cast("double").alias("match_score"),
    )
    manual = m.where("s_suppkey % 10 = 2").select(F.concat(F.lit("u"), "s_suppkey").alias("url"), F.lit("v00000001").alias("venue_id"))
    rows = social.match_mentions(mentions, keys, manual)
    return rows.select("url", "venue_id", "matched_by", "match_score")


DUCK_MATCH = f"""WITH v AS (SELECT 'v' || lpad(CAST(p_partkey AS STRING), 8, '0') AS venue_id, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') AS h, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS k FROM part),
m AS (SELECT p_partkey AS n, p_name || ' ' || p_brand AS name FROM part),
c AS (SELECT n, min(venue_id) AS venue_id FROM m JOIN v ON contains('dinner at ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' tonight so nice', k) WHERE n % 3 = 0 GROUP BY 1),
h AS (SELECT n, arg_min(venue_id, {{'a': -s, 'b': venue_id}}) AS venue_id, max(s) AS s FROM (SELECT n, venue_id, CASE WHEN contains(x, h) THEN 95.0 END AS s FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || 'sg' AS x FROM m WHERE n % 3 = 1) JOIN v ON contains(x, h)) GROUP BY 1)
SELECT 'u' || n AS url, CASE WHEN n % 10 = 2 THEN 'v00000001' ELSE coalesce(h.venue_id, c.venue_id) END AS venue_id, CASE WHEN n % 10 = 2 THEN 'manual' WHEN h.n IS NOT NULL THEN 'handle' WHEN c.n IS NOT NULL THEN 'caption' ELSE 'unmatched' END AS matched_by,
 CASE WHEN n % 10 = 2 THEN 100.0 WHEN h.n IS NOT NULL THEN h.s WHEN c.n IS NOT NULL THEN 100.0 END AS match_score
FROM m LEFT JOIN h USING (n) LEFT JOIN c USING (n)"""


def top_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best three venue guesses for captions that only come close to a name."""
    v = view(spark, sf_dir, "SELECT 'v' || lpad(CAST(p_partkey AS STRING), 8, '0') AS venue_id, p_name || ' ' || p_brand AS name FROM {part}")
    v = v.withColumns({"name_zh": F.lit(None).cast("string"), "brand": F.lit(None).cast("string")})
    keys = social.matcher_keys(v, v.select("venue_id", F.col("name").alias("alias")))
    m = view(spark, sf_dir, "SELECT 's' || CAST(p_partkey AS STRING) AS key, p_name || ' brand' AS caption, CAST(NULL AS STRING) AS creator_handle FROM {part}")
    return social.match_guesses(m, keys).select("key", "venue_id", "score", "rank")


def top_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rated venues per source, by shrunk rating."""
    rows = ratings(spark, sf_dir)
    from placerank.plans.standins import PARAMS

    rows = rows.withColumn("value", F.round(scoring.bayesian(F.col("rating"), F.col("review_count"), PARAMS), 9))
    return top_k(rows, ["source_key"], [F.col("value").desc(), F.col("venue_id").asc()], 10).select("source_key", "rank", "venue_id", "value")


QUERIES = {
    "keyword_counts": (keyword_counts, DUCK_KEYWORDS),
    "keyword_match": (keyword_match, f"""SELECT doc_id, h AS hits, round(CASE WHEN h > 0 THEN ln(1 + h) / ln(21) ELSE 0 END, 9) AS keyword_match FROM (SELECT doc_id, {_hits(["the", "of"])} AS h, {_hits([k for k in KEYWORDS if " " not in k])} AS n
        FROM (SELECT doc_id, {TOKENS} AS toks FROM ({T}))) WHERE n > 0"""),
    "aspect_scores": (aspect_scores, DUCK_ASPECTS),
    "noise_level": (noise_level, DUCK_NOISE),
    "noise_component": (noise_component, f"SELECT doc_id, q AS quiet_hits, l AS loud_hits, CASE WHEN q + l > 0 THEN round(q / (q + l), 9) END AS quiet FROM (SELECT doc_id, {_substr_hits(QUIET)} AS q, {_substr_hits(LOUD)} AS l FROM ({T}))"),
    "secondhand_mentions": (secondhand_mentions, f"SELECT source, sum(len(regexp_extract_all(text, '(?i)tion|the|is that'))) AS social_secondhand FROM ({T}) GROUP BY 1"),
    "clean_snippet": (clean_snippet, r"""SELECT doc_id, CASE WHEN length(t) > 300 THEN rtrim(substr(t, 1, 299)) || '…' WHEN t <> '' THEN t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"""),
    "postal_and_phone": (postal_and_phone, r"""SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1), '') AS postal_code,
        nullif('+65 ' || regexp_extract(text, '(?:^|[^0-9])(?:\+65[\s-]?)?([689][0-9]{3})[\s-]?([0-9]{4})(?:[^0-9]|$)', 1) || ' ' || regexp_extract(text, '(?:^|[^0-9])(?:\+65[\s-]?)?([689][0-9]{3})[\s-]?([0-9]{4})(?:[^0-9]|$)', 2), '+65  ') AS phone FROM documents"""),
    "text_search": (text_search, "SELECT doc_id, lang FROM documents WHERE contains(lower(text || ' ' || lang), 'tion') AND contains(lower(text || ' ' || lang), 'the') AND contains(lower(text || ' ' || lang), 'en')"),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
    "page_metadata": (page_metadata, f"""SELECT page_id, coalesce(nullif({PLAIN.replace("X", "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif({PLAIN.replace("X", "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')) AS title,
        sha256({PLAIN.replace("X", "html")}) AS content_hash FROM pages"""),
    "page_links": (page_links, DUCK_LINKS),
    "listicle_entries": (listicle_entries, f"""SELECT part_no AS page_id, lower(regexp_replace(name, ' \\(closed\\)$', '')) AS name, postal_code, '+65 6' || lpad(CAST(part_no % 1000 AS STRING), 3, '0') || ' 4321' AS phone, size || ' Long Road, Singapore ' || postal_code AS address FROM ({V})"""),
    "result_cards": (result_cards, f"""SELECT part_no AS page_id, lower(name) || ' ' || n AS name, 'https://host' || (part_no % 7) || '.test/r/' || (part_no + n) AS url, round(size / 10::DOUBLE, 1) AS rating, 1000 + size AS review_count, 'Thai,Bar' AS cuisine
        FROM ({V}), (VALUES (1), (2)) x(n)"""),
    "jsonld_nested": (jsonld_nested, f"SELECT part_no AS page_id, name, part_no % 9 AS depth FROM ({V}) WHERE part_no % 7 <> 0"),
    "comment_tree": (comment_tree, DUCK_TREE),
    "jsonld_listings": (jsonld_listings, f"""SELECT part_no AS page_id, name, 'https://host' || (part_no % 7) || '.test/v/' || part_no AS url, size || ' Road, ' || postal_code AS address, size / 10::DOUBLE AS rating, size AS review_count, 'Thai' AS cuisine FROM ({V})"""),
    "guide_awards": (guide_awards, f"SELECT part_no AS page_id, CASE WHEN michelin IN ('Bib Gourmand', '1 Star', '2 Stars', '3 Stars') THEN michelin ELSE 'Selected' END AS michelin FROM ({V})"),
    "prune_evidence": (article_relevance, DUCK_PRUNED),
    "flatten_threads": (flatten_threads, """SELECT conv_id, position, chars FROM (SELECT conv_id, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE trim(text) <> '') WHERE position <= 4"""),
    "extract_names": (extract_names, f"""SELECT part_no AS thread_id, unnest([lower(name), 'old ' || type_label, 'house b' || size]) AS name, unnest([0.6, 0.5, 0.35]) AS confidence FROM ({V})"""),
    "normalise_price": (normalise_price, DUCK_PRICE),
    "name_key": (name_keys, "SELECT p_partkey AS part_no, lower(p_name) || ' ' || p_size AS name_key, 'Outlet ' || p_size AS outlet FROM part"),
    "normalise_cuisines": (cuisine_labels, f"""SELECT venue_id, CASE part_no % 4 WHEN 0 THEN 'Zi Char,Seafood' WHEN 1 THEN 'Hawker,Bar' WHEN 2 THEN 'Restaurant' ELSE '' END AS cuisines,
        CASE part_no % 4 WHEN 0 THEN 'Zi Char' WHEN 1 THEN 'Hawker' WHEN 2 THEN 'Restaurant' END AS "primary" FROM ({V})"""),
    "cuisine_tags": (cuisine_tags, f"SELECT venue_id, CASE part_no % 5 WHEN 0 THEN 'Japanese,Seafood' WHEN 2 THEN 'Thai,Local & hawker,Desserts' WHEN 3 THEN 'Italian,French' ELSE '' END AS cuisines FROM ({V})"),
    "opening_hours": (opening_hours, DUCK_HOURS),
    "award_from_text": (award_from_text, f"""SELECT venue_id, a AS award, CASE a WHEN 'Star' THEN 1 WHEN '2 Stars' THEN 2 WHEN '3 Stars' THEN 3 ELSE 0 END AS stars, CASE a WHEN 'Bib Gourmand' THEN 0.5 WHEN 'Star' THEN 0.7 WHEN '2 Stars' THEN 0.85 WHEN '3 Stars' THEN 1.0 END AS level,
        CASE WHEN a = 'Bib Gourmand' THEN a WHEN a IS NOT NULL THEN 'Michelin ' || a END AS label FROM (SELECT venue_id, CASE part_no % 7 WHEN 0 THEN 'Bib Gourmand' WHEN 1 THEN '2 Stars' WHEN 3 THEN '3 Stars' WHEN 6 THEN 'Star' END AS a FROM ({V}))"""),
    "verdict": (verdicts, DUCK_VERDICT),
    "clean_heading": (clean_heading, f"SELECT venue_id, CASE WHEN part_no % 4 = 3 THEN name ELSE regexp_replace(name, ' \\(closed\\)$', '') END AS heading FROM ({V})"),
    "validate_sightings": (validated, DUCK_VALID),
    "refresh_venues": (refreshed, DUCK_REFRESH),
    "register_catalogue": (register_catalogue, """SELECT CAST(s_suppkey AS STRING) AS source_ref, 'Supplier#' || regexp_extract(s_name, '([0-9]+)', 1) || ' O''Neil' AS name, lpad(CAST(s_suppkey * 997 % 100000 AS STRING), 6, '0') AS postal_code,
        CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS hygiene_grade, 0.0 AS confidence FROM supplier"""),
    "places_payload": (places_payload, DUCK_PLACES),
    "search_mentions": (search_mentions, """SELECT CAST(event_id AS STRING) AS query, 'https://www.instagram.com/user.' || user_id || '/' AS url, 'user.' || user_id AS creator_handle, CAST(CAST(ts AS DATE) AS STRING) AS post_date,
        event_type || ' seen ' || CAST(CAST(ts AS DATE) AS STRING) || ' there' AS caption FROM events"""),
    "nearest_station": (nearest_station, f"SELECT p.venue_id, arg_min(s.name, {{'a': {_HAV}, 'b': s.name}}) AS station, round(min({_HAV}), 3) AS metres FROM ({G}) p, ({ST}) s GROUP BY 1"),
    "nearest_by_grid": (nearest_supplier, f"""SELECT p.venue_id, round(min({_HAV}), 3) AS metres FROM ({G}) p,
        (SELECT 1.2E0 + (s_suppkey * 7 % 997) / CAST(4000 AS DOUBLE) AS lat, 1.036E2 + (s_suppkey * 331 % 991) / CAST(2000 AS DOUBLE) AS lng FROM supplier) s GROUP BY 1"""),
    "postal_geocode_fill": (postal_geocode_fill, DUCK_GEO),
    "near_me": (near_me, f"""SELECT venue_id, round(d / 1000, 6) AS distance_km FROM (SELECT p.venue_id, {_HAV} AS d FROM ({G}) p, (SELECT 1.3::DOUBLE AS lat, 103.85::DOUBLE AS lng) s) WHERE d <= 5000"""),
    "faceted_search": (faceted_search, f"""SELECT venue_id, name, best_rank FROM ({DUCK_SITE}) WHERE worth AND coalesce(price_level, 0) <= 3 AND coalesce(open_weekends, true) AND contains(lower(name || ' ' || coalesce(region, '') || ' ' || type_label), 'brand')
        AND contains(lower(name || ' ' || type_label), 'economy') ORDER BY coalesce(best_rank, 999), venue_id LIMIT 20 OFFSET 5"""),
    "search_near": (search_near, f"""SELECT venue_id, round(d / 1000, 6) AS distance_km FROM (SELECT p.venue_id, {_HAV} AS d FROM ({V}) p, (SELECT 1.3::DOUBLE AS lat, 103.85::DOUBLE AS lng) s WHERE halal AND michelin IS NOT NULL AND michelin <> 'Selected') WHERE d <= 8000 ORDER BY d, venue_id LIMIT 30"""),
    "all_places_order": (all_places_order, f"SELECT venue_id, position FROM ({DUCK_ALL})"),
    "cuisine_lists": (cuisine_lists, f"""SELECT venue_id, cuisine, row_number() OVER (PARTITION BY cuisine ORDER BY position) AS rank FROM (SELECT venue_id, position, unnest([string_split(name, ' ')[2], string_split(name, ' ')[1]]) AS cuisine FROM ({DUCK_ALL}))"""),
    "site_totals": (site_totals, f"SELECT count(*) AS places, count(*) FILTER (worth) AS worth, count(*) FILTER (part_no % 29 = 0) AS new, count(*) FILTER (michelin <> 'Selected') AS awarded FROM ({DUCK_SITE})"),
    "occasion_list": (occasion_list, f"""SELECT venue_id, s AS stars, part_no + 1 AS rank, CASE WHEN michelin = 'Bib Gourmand' THEN michelin WHEN michelin LIKE '%Star%' THEN 'Michelin ' || michelin END AS award, CASE price_level WHEN 1 THEN 60.0 WHEN 2 THEN 140.0 WHEN 3 THEN 320.0 WHEN 4 THEN 640.0 END AS bill_for_4
        FROM (SELECT *, CASE michelin WHEN '3 Stars' THEN 3 WHEN '2 Stars' THEN 2 WHEN '1 Star' THEN 1 WHEN 'Star' THEN 1 ELSE 0 END AS s FROM ({V})) ORDER BY s DESC, part_no LIMIT 20"""),
    "exact_match_tiers": (exact_match_tiers, DUCK_TIERS),
    "resolve_entities": (resolve_entities, DUCK_RESOLVE),
    "match_stats": (match_stats, DUCK_STATS),
    "fuzzy_pairs": (fuzzy_pairs, FUZZY_PAIRS),
    "handle_caption_match": (handle_caption_match, DUCK_MATCH),
    "match_guesses": (top_guess, None),
    "top_rated": (top_rated, f"""SELECT source_key, rank, venue_id, value FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY value DESC, venue_id) AS rank FROM (SELECT *, round({BAYES}, 9) AS value FROM ({DUCK_RATINGS}))) WHERE rank <= 10"""),
}

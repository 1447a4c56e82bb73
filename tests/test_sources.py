import json

from pyspark.sql import functions as F

from placerank.sources import pages, payloads, threads

ARTICLE = """<html><head><meta property="og:title" content="Best zi char"><title>t</title>
<script type="application/ld+json">{"@type":"Article","datePublished":"2026-03-14T08:00:00+08:00"}</script></head>
<body><article><h1>Head</h1><p>intro</p>
<h2>1. Keng Eng Kee (琼荣记) – best in town</h2><p>Great food. <a href="https://maps.example/x">map</a></p>
<p>Address: 124 Bukit Merah Lane 1, Singapore 150124</p><p>Opening Hours: Mon-Sun 11am-10pm | Tel: 6272 1038</p><p>Price $$ ok</p>
<h2>Conclusion</h2><p>That is the end of the list, folks.</p>
<h3>Two Chefs: 116 Commonwealth Crescent, Singapore 140116 | Tel 6472 5361</h3><p>Butter pork ribs are nice.</p>
<h2>Short</h2><p>x</p></article></body></html>"""


def page_df(spark, html, url="https://blog.test/search?q=zi+char", source="blog"):
    return spark.createDataFrame([(1, url, html, source)], "page_id long, url string, html string, source_key string")


def test_listicle(spark):
    rows = pages.extract_listicles(page_df(spark, ARTICLE)).orderBy("heading_no").collect()
    assert [r.name for r in rows] == ["Keng Eng Kee", "Two Chefs"]
    kek, two = rows
    assert kek.name_zh == "琼荣记" and kek.postal_code == "150124" and kek.phone == "+65 6272 1038"
    assert kek.hours == "Mon-Sun 11am-10pm" and kek.price_text == "$$" and kek.links == ["https://maps.example/x"]
    assert kek.address.endswith("124 Bukit Merah Lane 1, Singapore 150124")
    assert two.postal_code == "140116" and two.phone == "+65 6472 5361"
    assert pages.extract_listicles(page_df(spark, ARTICLE)).where(pages.is_listing()).count() == 2


def test_metadata(spark):
    m = pages.page_metadata(page_df(spark, ARTICLE)).first()
    assert m.title == "Best zi char" and m.published_at == "2026-03-14" and len(m.content_hash) == 64


CARDS = """<div class="card js"><h3 class="t"><a href="/r/kek">1. KEK</a></h3><span class="addr">124 Lane</span>
<b class="score">4.5 stars</b><i class="n">(1,204 reviews)</i><u class="price">$$</u><em class="c">Chinese · Seafood</em>
<img alt="star"><img alt="Star"></div><div class="card"><p>no name</p></div>"""


def test_cards_and_guide(spark):
    sel = {"card": "div.card", "name": "h3.t", "link": "h3 a[href]", "address": ".addr", "rating": ".score",
           "review_count": ".n", "price": ".missing, .price", "cuisine": "em.c", "star": "img[alt*='tar']"}
    dim = spark.createDataFrame([("blog", sel)], "source_key string, selectors map<string,string>")
    rows = pages.guide_listings(pages.extract_cards(page_df(spark, CARDS), dim)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.name, r.url, r.address, r.rating, r.review_count, r.price_text) == (
        "KEK", "https://blog.test/r/kek", "124 Lane", 4.5, 1204, "$$",
    )
    assert r.cuisine == ["Chinese", "Seafood"] and r.michelin == "2 Stars"


def test_jsonld(spark):
    data = {"@type": "ItemList", "itemListElement": [
        {"item": {"@type": "Restaurant", "name": " A ", "url": "/a", "address": {"streetAddress": "1 Road", "postalCode": "123456"},
                  "aggregateRating": {"ratingValue": "4.4", "reviewCount": 1200}, "servesCuisine": "Thai", "priceRange": "$$"}},
        {"@type": ["LocalBusiness"], "name": "B", "address": "2 Road", "servesCuisine": ["X", "Y"]},
        {"item": {"@type": "Person", "name": "C"}}]}
    graph = {"@graph": [{"@type": "CafeOrCoffeeShop", "name": "D"}]}
    html = "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in (data, graph)) + '<script type="application/ld+json">{bad</script>'
    rows = {r.name: r for r in pages.extract_jsonld(page_df(spark, html)).collect()}
    assert set(rows) == {"A", "B", "D"}
    a = rows["A"]
    assert (a.url, a.address, a.rating, a.review_count, a.price_text, a.cuisine) == (
        "https://blog.test/a", "1 Road, 123456", 4.4, 1200, "$$", ["Thai"],
    )
    assert rows["B"].address == "2 Road" and rows["B"].cuisine == ["X", "Y"]


def test_jsonld_of_any_depth(spark):
    def listed(inner, depth):
        for _ in range(depth):
            inner = {"@type": "ItemList", "itemListElement": [{"item": inner}, "no object", {"item": "no object", "@type": "BarOrPub", "name": ""}]}
        return inner

    hidden = {"@type": "Restaurant", "name": " ", "itemListElement": [{"@type": "Restaurant", "name": "never seen"}]}
    shown = {"@type": "Restaurant", "name": "outer", "itemListElement": [{"@type": "Restaurant", "name": "inner"}]}
    docs = [listed({"@type": "Restaurant", "name": f"deep{d}"}, d) for d in (1, 5, 40)] + [hidden, shown, {"@graph": [shown, listed(hidden, 3)]}, "text", 7, []]
    html = "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in docs)
    got = sorted((r.name, len(r.at) - 2) for r in pages.extract_jsonld(page_df(spark, html)).collect())
    assert got == [("deep1", 1), ("deep40", 40), ("deep5", 5), ("inner", 1), ("inner", 1), ("outer", 0), ("outer", 0)]
    assert pages.extract_jsonld(page_df(spark, "<p>none</p>")).count() == 0


def test_links_and_relevance(spark, column_of):
    html = '<a href="/best-zi-char-singapore/">1</a><a href="zi-char-guide-family#x">2</a><a href="https://other.test/zi-char-food-best">3</a><a href="/best-zi-char-singapore/#c">again</a><a href="/top-cruises">4</a>'
    rows = pages.discover_links(
        page_df(spark, html, "https://blog.test/"), r"^/[a-z0-9-]{8,}/?$",
        lambda link: pages.relevant_article(link, F.lit("best zi char Singapore")),
    ).orderBy("rank").collect()
    assert [r.link for r in rows] == ["https://blog.test/best-zi-char-singapore/", "https://blog.test/zi-char-guide-family"]
    cases = [
        ("https://b.test/best-dim-sum-brunch", "weekend dim sum brunch", True),
        ("https://b.test/best-brunch-spots", "weekend dim sum brunch", False),
        ("https://b.test/best-cafes-bali", "instagrammable cafe Singapore", False),
        ("https://b.test/best-cafes", "instagrammable cafe Singapore", True),
        ("https://b.test/best-restaurants", "new restaurants Singapore", False),
        ("https://b.test/new-restaurants-october", "new restaurants Singapore", True),
        ("https://b.test/cafe-x", "新加坡 咖啡馆", False),
    ]
    got = column_of([(u, q) for u, q, _ in cases], lambda F: pages.relevant_article(F.col("u"), F.col("q")), "u string, q string")
    assert got == [w for _, _, w in cases]


def test_places(spark):
    place = {"id": "p1", "displayName": {"text": "KEK"}, "formattedAddress": "x", "addressComponents": [{"longText": "150124", "types": ["postal_code"]}],
             "location": {"latitude": 1.0, "longitude": 2.0}, "priceLevel": "PRICE_LEVEL_MODERATE", "reservable": True, "googleMapsUri": "m",
             "types": ["chinese_restaurant", "point_of_interest", "bar"], "businessStatus": "OPERATIONAL",
             "priceRange": {"startPrice": {"units": "20"}}, "reviews": [{"rating": 5, "publishTime": "2026-01-01T00:00:00Z", "text": {"text": " viral   on TikTok "}, "authorAttribution": {"displayName": "Secret"}}]}
    raw = spark.createDataFrame([(json.dumps({"places": [place, {"id": "p2"}]}),)], "v string")
    df = raw.select(F.from_json("v", payloads.PLACES).alias("r")).select("r.*")
    out = payloads.places_to_sightings(df)
    r = out.first()
    assert out.count() == 1 and r.postal_code == "150124" and r.price_level == 2 and r.price_text == "20-? SGD"
    assert r.cuisine == ["chinese_restaurant", "bar"] and r.booking_url == "m"
    assert r.extra.reviews[0].asDict() == {"rating": 5.0, "published_at": "2026-01-01T00:00:00Z", "snippet": "viral on TikTok", "social_words": 2}
    res = payloads.reservable_view(out).first()
    assert res.source_key == "google_reserve" and res.booking_url == "m" and res.snippet is None


def test_catalogue(spark):
    df = spark.createDataFrame([(1, "JOE'S DINER", "x", "60056", " a "), (2, "Mixed Case", "", None, "")], "_id int, licensee_name string, premises_address string, postal_code string, grade string")
    rows = payloads.catalogue_to_sightings(df).orderBy("source_ref").collect()
    assert [(r.name, r.postal_code, r.hygiene_grade, r.address) for r in rows] == [("Joe'S Diner", "060056", "A", "x"), ("Mixed Case", None, None, None)]


def test_threads(spark):
    kids = [{"data": {"body": "first", "replies": {"data": {"children": [{"data": {"body": "reply"}}, {"data": {"body": "[deleted]"}}]}}}},
            {"data": {"body": "second"}}]
    raw = spark.createDataFrame([("t", "self", json.dumps(kids))], "thread_id string, selftext string, c string")
    tree = threads.comment_tree(raw.withColumnRenamed("c", "children"))
    flat = threads.flatten_threads(tree, 3).orderBy("position").collect()
    assert [r.body for r in flat] == ["self", "first", "reply"]
    body = "I love **Keng Eng Kee**!\n- Two Chefs: great\n1. Bukit Timah\nWe ate at Keng Eng Kee and tried Ah Hua's Place. Try Best Food"
    rows = threads.extract_names(spark.createDataFrame([("t", 1, body)], "thread_id string, position int, body string")).collect()
    assert {(r.name, r.confidence) for r in rows} == {("Keng Eng Kee", 0.6), ("Two Chefs", 0.5), ("Ah Hua's Place", 0.35)}


def test_social_exports(spark):
    photo = {"saved_saved_media": [{"title": "cafe_x", "string_map_data": {"Saved on": {"href": "https://www.instagram.com/p/1/?u=2", "timestamp": 1767225600}}}],
             "likes_media_likes": [{"title": "", "string_list_data": [{"href": "https://www.instagram.com/reel/2/", "timestamp": 1767225600}, {"href": "https://x.test"}]}]}
    df = spark.createDataFrame([(json.dumps(photo),)], "v string").select(F.from_json("v", payloads.PHOTO_EXPORT).alias("r")).select("r.*")
    rows = payloads.photo_export_mentions(df).orderBy("url").collect()
    assert [(r.url, r.creator_handle, r.post_date, r.query) for r in rows] == [
        ("https://www.instagram.com/p/1/", "cafe_x", "2026-01-01", "saved"), ("https://www.instagram.com/reel/2/", None, "2026-01-01", "liked"),
    ]
    video = {"Activity": {"Favorite Videos": {"FavoriteVideoList": [{"Date": "2026-01-02 10:00", "Link": "https://tiktok.com/v/1?x"}]}, "Like List": {"ItemFavoriteList": [{"date": "2026-01-03", "link": "https://tiktok.com/v/2"}]}}}
    df = spark.createDataFrame([(json.dumps(video),)], "v string").select(F.from_json("v", payloads.VIDEO_EXPORT).alias("r")).select("r.*")
    assert [(r.url, r.post_date, r.query) for r in payloads.video_export_mentions(df).orderBy("url").collect()] == [
        ("https://tiktok.com/v/1", "2026-01-02", "favourites"), ("https://tiktok.com/v/2", "2026-01-03", "liked"),
    ]
    serp = {"organic_results": [{"title": "T", "link": "https://www.instagram.com/cafe.x/?h", "snippet": "Mar 4, 2026 yum"}, {"title": "U", "link": "https://www.instagram.com/p/9", "snippet": "", "date": "2026-02-01"}, {"link": "https://z.test"}]}
    df = spark.createDataFrame([("q", "instagram.com", json.dumps(serp))], "query string, site string, v string").select("query", "site", F.from_json("v", payloads.SEARCH_RESULT).alias("r")).select("query", "site", "r.*")
    assert [(r.url, r.creator_handle, r.post_date, r.caption) for r in payloads.search_result_mentions(df).collect()] == [
        ("https://www.instagram.com/cafe.x/", "cafe.x", "2026-03-04", "T Mar 4, 2026 yum"), ("https://www.instagram.com/p/9", None, "2026-02-01", "U"),
    ]


def test_page_titles_decode_every_reference(spark):
    from placerank.sources.pages import page_metadata

    rows = [
        (1, "<h1>Caf&eacute; Ol&#233; &#8211; best &amp;lt; &copy</h1>"), (2, "<title>A&nbsp;&#x42; &unknown;</title>"), (3, None), (4, "<h1>plain</h1>"),
    ]
    got = {r.page_id: r.title for r in page_metadata(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: "Café Olé – best &lt; ©", 2: "A B &unknown;", 3: None, 4: "plain"}


def test_comment_trees_of_any_depth(spark):
    import random

    rng, raw, want = random.Random(3), [], {}

    def comment(depth):
        kids = [comment(depth - 1) for _ in range(rng.randrange(1, 3))] if depth else []
        replies = {"data": {"children": kids}} if kids else ""
        return {"data": {"body": rng.choice(["[deleted]", " ", f"c{rng.random()}", f"c{rng.random()}"]), "replies": replies}}

    def walk(items):
        for c in items:
            yield c["data"]["body"]
            yield from walk(c["data"]["replies"]["data"]["children"] if c["data"]["replies"] else [])

    for t in range(4):
        kids = [comment(10 if t == 0 else t) for _ in range(2)]
        raw.append((f"t{t}", f"self{t}", json.dumps(kids)))
        want[f"t{t}"] = [b for b in [f"self{t}", *walk(kids)] if b not in (" ", "[deleted]")]
    raw += [("odd", None, "{bad"), ("none", None, None), ("empty", "", "[]")]
    tree = threads.comment_tree(spark.createDataFrame(raw, "thread_id string, selftext string, children string"))
    got = {}
    for r in threads.flatten_threads(tree, 10**6).orderBy("thread_id", "position").collect():
        got.setdefault(r.thread_id, []).append(r.body)
    assert got == want


def test_cards_of_pages_with_one_id_keep_their_own_page(spark):
    rows = [("p", "s", f"https://h{i}.test/list", f"<div class='card'><h3><a href='/r'>Luna {i}</a></h3></div>") for i in range(2)]
    landed = spark.createDataFrame(rows, "page_id string, source_key string, url string, html string")
    dim = spark.createDataFrame([("s", {"card": "div.card", "name": "h3"})], "source_key string, selectors map<string,string>")
    got = sorted((r.name, r.url) for r in pages.extract_cards(landed, dim).collect())
    assert got == [("Luna 0", "https://h0.test/r"), ("Luna 1", "https://h1.test/r")]


def test_rows_of_parts_are_dealt_to_all_tasks(spark, sf_dir):
    from placerank.plans.standins import venues

    v = venues(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert v.rdd.getNumPartitions() == tasks


def test_nearest_in_crowded_cells_and_places_at_one_spot(spark):
    from placerank.operators.enrich import CROWD, _uncrowded, nearest_by_grid

    stations = [(f"s{i:04d}", 1.3 + (i % 40) * 1e-4, 103.8 + (i // 40) * 1e-4, ["L"]) for i in range(1600)] + [("far", -40.0, 170.0, ["F"])]
    s = spark.createDataFrame(stations, "name string, lat double, lng double, lines array<string>")
    width = _uncrowded(s, 0.01)
    assert width < 0.01 and s.groupBy((s.lat / width).cast("long"), (s.lng / width).cast("long")).count().where(f"count > {2 * CROWD}").isEmpty()
    places = [(f"p{i}", 1.30203, 103.80198) for i in range(300)] + [("q", -41.0, 171.0)]
    p = spark.createDataFrame(places, "venue_id string, lat double, lng double")
    got = {r.venue_id: r.station for r in nearest_by_grid(p, s).collect()}
    assert got == {f"p{i}": "s0820" for i in range(300)} | {"q": "far"}


def test_scores_are_made_in_all_tasks(spark, sf_dir):
    from placerank.plans.ranking_queries import scores

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert scores(spark, sf_dir).rdd.getNumPartitions() >= tasks

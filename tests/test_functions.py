import pytest

from placerank.functions import awards, geo, hours, names, price, similarity, text


def test_name_key(column_of):
    got = column_of(
        ["Keng Eng Kee Seafood (琼荣记)", "KEK Seafood", "The Coffee Bar Pte Ltd", "Café Monochrome", "ﬁsh Ｈouse", "Café X"],
        lambda F: names.name_key(F.col("x")),
    )
    assert got == ["keng eng kee 琼荣记", "kek", "coffee bar", "monochrome", "fish", "x"]


def test_brand_outlet(column_of):
    got = column_of(
        ["Din Tai Fung @ Paragon", "Keng Eng Kee (琼荣记)", "Toast Box (Jurong Point)", "Plain Name", "A - one two three four five"],
        lambda F: names.brand_outlet(F.col("x")),
    )
    assert [tuple(r) for r in got] == [
        ("Din Tai Fung", "Paragon"),
        ("Keng Eng Kee (琼荣记)", None),
        ("Toast Box", "Jurong Point"),
        ("Plain Name", None),
        ("A - one two three four five", None),
    ]


def test_price_level(column_of):
    cases = {
        "$$": 2,
        "20-40 SGD": 2,
        "~$120 per pax": 4,
        "$8": 1,
        "4-course lunch S$108; dinner from S$168": 3,
        "RM20 – RM40 per pax": None,
        "30 per pax": 2,
        "Open 7 days, 2 outlets": None,
        "S$18-S$28": 1,
    }
    assert column_of(list(cases), lambda F: price.price_level(F.col("x"))) == list(cases.values())


def test_cuisines(spark):
    df = spark.createDataFrame(
        [
            (0, ["chinese_restaurant", "seafood_restaurant", "restaurant"]),
            (1, ["Zi Char", "Cafes & Coffee, Brunch"]),
            (2, ["coffee shop"]),
            (3, ["restaurant"]),
            (4, ["unknown thing"]),
        ],
        "i int, x array<string>",
    )
    got = [r.y for r in df.select("i", price.cuisines(df.x).alias("y")).orderBy("i").collect()]
    assert got == [["Chinese", "Seafood"], ["Zi Char", "Cafe"], ["Hawker"], ["Restaurant"], []]


def as_lists(hours_map):
    return {k: [[r["open"], r["close"]] for r in v] for k, v in hours_map.items()}


def test_hours_text(column_of):
    got = column_of(
        ["Mon-Fri 11.30am-2.30pm, 5-10pm; Sat-Sun 11am-10.30pm; Closed on PH", "11am - 11pm", "Fri-Mon 6-9", "see website"],
        lambda F: hours.hours_from_text(F.col("x")),
    )
    first = as_lists(got[0])
    assert first["mon"] == [["11:30", "14:30"], ["17:00", "22:00"]]
    assert first["sun"] == [["11:00", "22:30"]] and first["ph"] == []
    assert set(as_lists(got[1])) == {"mon", "tue", "wed", "thu", "fri", "sat", "sun"}
    assert set(as_lists(got[2])) == {"fri", "sat", "sun", "mon"}
    assert as_lists(got[2])["sat"] == [["18:00", "09:00"]]
    assert got[3] == {}


def test_hours_lines_and_flags(spark):
    df = spark.createDataFrame(
        [
            (["Monday: 11:30 AM – 2:30 PM, 5:00 – 10:30 PM", "Tuesday: Closed", "Sunday: Open 24 hours"],),
            (["Saturday: 6:00 PM – 1:00 AM"],),
        ],
        "x array<string>",
    )
    h = hours.hours_from_lines(df.x)
    rows = df.select(h.alias("h"), hours.hours_flags(h).alias("f")).collect()
    assert as_lists(rows[0].h) == {
        "mon": [["11:30", "14:30"], ["17:00", "22:30"]],
        "tue": [],
        "sun": [["00:00", "24:00"]],
    }
    assert rows[0].f.open_weekends is True and rows[0].f.late_night is True and rows[0].f.ph_closed is None
    assert rows[1].f.late_night is True and rows[1].f.open_weekends is True


def test_region(column_of):
    got = column_of(["160056", "520123", "999999", "12"], lambda F: geo.sector_region(F.col("x")))
    assert [r["region"] for r in got] == ["Central", "East", None, None]
    assert got[0]["district"].startswith("D03") and got[1]["district"].startswith("D18")


def test_postal_phone_snippet(column_of):
    assert column_of(
        ["1 Road, Singapore 150124", "S(160056)", "id 1234567", None], lambda F: text.postal_code(F.col("x"))
    ) == ["150124", "160056", None, None]
    assert column_of(
        ["call 6272 1038", "+65-91234567", "12345678"], lambda F: text.phone_number(F.col("x"))
    ) == ["+65 6272 1038", "+65 9123 4567", None]
    got = column_of(["  a \n b ", "x" * 400, "  "], lambda F: text.clean_snippet(F.col("x")))
    assert got[0] == "a b" and len(got[1]) == 300 and got[1].endswith("…") and got[2] is None


def test_headings(column_of):
    got = column_of(
        [
            "1. Keng Eng Kee – best zi char in town",
            "New restaurant: Yanhuo",
            "Molly Tea is opening at Hillion Mall on 9 October",
            "12) Kafe [Closed]",
            "Noci opens second outlet at Bugis",
        ],
        lambda F: text.clean_heading(F.col("x")),
    )
    assert got == ["Keng Eng Kee", "Yanhuo", "Molly Tea", "Kafe", "Noci"]
    assert column_of(
        ["July 2026", "12 Feb", "2026", "May Garden", "99"], lambda F: text.is_date_only(F.col("x"))
    ) == [True, True, True, False, False]
    got = column_of(
        ["Keng Eng Kee (琼荣记)", "Old Hut 老屋", "老屋", "Plain"], lambda F: text.split_chinese_name(F.col("x"))
    )
    assert [tuple(r) for r in got] == [
        ("Keng Eng Kee", "琼荣记"), ("Old Hut", "老屋"), ("老屋", None), ("Plain", None),
    ]


def test_dates_and_links(column_of):
    assert column_of(
        ["2026-03-14T08:00:00+08:00", "14 March 2026", "March 14, 2026", "2026-03-14", "soon"],
        lambda F: text.normalise_date(F.col("x")),
    ) == ["2026-03-14"] * 4 + [None]
    got = column_of(
        ["/a/b", "c", "https://x.test/y", "//cdn.test/z", "#frag", "?q=1"],
        lambda F: text.resolve_url(F.lit("https://h.test/dir/page?x=1"), F.col("x")),
    )
    assert got == [
        "https://h.test/a/b", "https://h.test/dir/c", "https://x.test/y", "https://cdn.test/z",
        "https://h.test/dir/page?x=1#frag", "https://h.test/dir/page?q=1",
    ]


def test_award_from_text(column_of):
    cases = {
        "This Bib Gourmand stall is great": "Bib Gourmand",
        "A one-Michelin-starred dining room in town": "1 Star",
        "Holds three Michelin stars since 2019": "3 Stars",
        "The Michelin-starred restaurant serves noodles": "Star",
        "Opened by the head chef of Michelin-starred Sommer in town": None,
        "chef Mauro of the three Michelin-starred Mirazur": None,
        "run by a Michelin-starred chef": None,
        "It is Michelin-starred.": None,
        "three stars out of five": None,
        "Fans of one Michelin-starred Alpha. We love this two Michelin-starred room": "2 Stars",
        "nothing": None,
    }
    assert column_of(list(cases), lambda F: awards.award_from_text(F.col("x"))) == list(cases.values())


@pytest.mark.parametrize(
    "fn, a, b, want",
    [
        (similarity.token_set_ratio, "keng eng kee", "keng eng kee 琼荣记", 100.0),
        (similarity.ratio, "abcd", "abce", 75.0),
        (similarity.ratio, "kopitiam", "kopitiams", 1600 / 17),
        (similarity.token_set_ratio, "ah hua zi char", "ah hua zichar", 2200 / 27),
        (similarity.partial_ratio, "luna rooftop", "dinner at luna rooftop tonight", 100.0),
        (similarity.token_set_ratio, "kopitiam", "laksa stall", 6 * 100 / 19),
    ],
)
def test_similarity_values(fn, a, b, want):
    assert fn(a, b) == pytest.approx(want, abs=0.01)


def test_lcs_matches_table():
    import random

    rnd = random.Random(7)
    for _ in range(200):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 14)))
        b = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 14)))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs_length(a, b) == table[-1][-1]

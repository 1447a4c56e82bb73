"""Opening hours as MAP day -> ARRAY<STRUCT<open, close>> (empty array = closed, absent = unknown)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import let, lookup, strings

# Day order and spellings.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
DAY_NUMBER = {
    "monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "tues": 1, "wednesday": 2, "wed": 2,
    "thursday": 3, "thu": 3, "thur": 3, "thurs": 3, "friday": 4, "fri": 4, "saturday": 5, "sat": 5,
    "sunday": 6, "sun": 6,
}
_DAY = (
    "mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday"
    "|saturday|sunday"
)
DAY_SPAN = (
    rf"(?iU)\b({_DAY}|daily|everyday|every day|weekends|weekend|weekdays|weekday"
    rf"|ph|public holidays?)\b(?:\s*(?:-|–|—|to)\s*({_DAY}))?"
)
CLOCK = r"\d{1,2}(?:[:.]\d{2})?\s*(?:am|pm)?"
TIME_RANGE = rf"(?iU)({CLOCK})\s*(?:-|–|—|to|~)\s*({CLOCK})"
CLOCK_PARTS = r"(?iU)^(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm)?"
CLOSED = r"(?iU)\bclosed\b"
SEGMENTS = r"(?U)[;,\n]|\s{2,}|\.\s+(?=[A-Z])"
RANGES = "array<struct<open:string,close:string>>"
ENTRY = "struct<day:string,open:string,close:string>"


def _half(clock: Column) -> Column:
    """"am", "pm" or the empty string."""
    return F.lower(F.regexp_extract(F.trim(clock), CLOCK_PARTS, 3))


def _clock24(clock: Column, half: Column, pm_until: int) -> Column:
    """HH:MM; without am/pm an hour up to ``pm_until`` means the afternoon."""
    hour = F.regexp_extract(F.trim(clock), CLOCK_PARTS, 1).try_cast("int")
    minute = F.coalesce(
        F.regexp_extract(F.trim(clock), CLOCK_PARTS, 2).try_cast("int"), F.lit(0)
    )

    def render(p: Column) -> Column:
        h = p["h"]
        shifted = (
            F.when((half == "pm") & (h < 12), h + 12)
            .when((half == "am") & (h == 12), 0)
            .when((half == "") & (h <= pm_until) & (h != 0), h + 12)
            .otherwise(h)
        )
        return F.when(
            (h <= 24) & (p["m"] <= 59), F.format_string("%02d:%02d", shifted % 24, p["m"])
        )

    return let(F.struct(hour.alias("h"), minute.alias("m")), render)


def _time_range(text: Column, pm_until: int) -> Column:
    """STRUCT(open, close) of one "11.30am - 2pm" text; null when it is not a time range."""
    ends = F.struct(
        F.regexp_extract(text, TIME_RANGE, 1).alias("a"), F.regexp_extract(text, TIME_RANGE, 2).alias("b")
    )

    def with_halves(e: Column) -> Column:
        return let(
            F.struct(
                e["a"].alias("a"), e["b"].alias("b"), _half(e["a"]).alias("ha"), _half(e["b"]).alias("hb")
            ),
            clocks,
        )

    def clocks(e: Column) -> Column:
        borrow = (e["ha"] == "") & (e["hb"] != "")
        close = F.when(borrow, _clock24(e["b"], e["hb"], 0)).otherwise(_clock24(e["b"], e["hb"], pm_until))
        start = F.when(borrow, _clock24(e["a"], e["hb"], 0)).otherwise(_clock24(e["a"], e["ha"], pm_until))
        return let(
            F.struct(start.alias("open"), close.alias("close")),
            lambda r: F.when(
                r["open"].isNotNull() & r["close"].isNotNull(),
                F.struct(
                    # "11 - 2pm" opens in the morning
                    F.when(borrow & (r["open"] >= r["close"]), _clock24(e["a"], F.lit(""), 0))
                    .otherwise(r["open"])
                    .alias("open"),
                    r["close"].alias("close"),
                ),
            ),
        )

    return let(ends, with_halves)


def time_ranges(text: Column, pm_until: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(TIME_RANGE), F.lit(0))
    return F.array_compact(F.transform(found, lambda r: _time_range(r, pm_until)))


def _days_named(segment: Column) -> Column:
    """Days a segment speaks about; null when it names none (the previous ones stay in force)."""
    first = F.lower(F.regexp_extract(segment, DAY_SPAN, 1))
    last = F.lower(F.regexp_extract(segment, DAY_SPAN, 2))
    return let(
        F.struct(
            first.alias("word"),
            lookup(DAY_NUMBER, first).alias("a"),
            lookup(DAY_NUMBER, last).alias("b"),
        ),
        _expand_days,
    )


def _expand_days(span_of: Column) -> Column:
    first, a, b = span_of["word"], span_of["a"], span_of["b"]
    week = strings(DAYS)
    span = F.when(a <= b, F.slice(week, a + 1, b - a + 1)).otherwise(
        F.concat(F.slice(week, a + 1, F.lit(7) - a), F.slice(week, F.lit(1), b + 1))
    )
    return (
        F.when(first == "", F.lit(None).cast("array<string>"))
        .when(first.isin("daily", "everyday", "every day"), week)
        .when(first.isin("weekend", "weekends"), strings(DAYS[5:]))
        .when(first.isin("weekday", "weekdays"), strings(DAYS[:5]))
        .when(first.isin("ph", "public holiday", "public holidays"), strings(["ph"]))
        .when(b.isNull(), F.array(F.get(week, a)))
        .otherwise(span)
    )


def _collect_days(entries: Column, days: list[str]) -> Column:
    """Entries in text order -> map; an entry without times closes the day and forgets earlier ones."""
    return let(entries, lambda e: _day_map(e, days))


def _day_map(entries: Column, days: list[str]) -> Column:
    def of_day(day: str) -> Column:
        mine = F.filter(entries, lambda e: e["day"] == day)
        folded = F.aggregate(
            mine,
            F.array().cast(RANGES),
            lambda acc, e: F.when(e["open"].isNull(), F.array().cast(RANGES)).otherwise(
                F.concat(acc, F.array(F.struct(e["open"].alias("open"), e["close"].alias("close"))))
            ),
        )
        return F.when(F.size(mine) > 0, folded)

    whole = F.map_from_arrays(strings(days), F.array(*[of_day(d) for d in days]))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def hours_from_text(text: Column) -> Column:
    """Free text such as "Mon-Fri 11.30am-2.30pm, 5-10pm; Sat-Sun 11am-10pm; Closed on PH"."""
    segments = F.filter(F.transform(F.split(text, SEGMENTS), lambda s: F.trim(s)), lambda s: s != "")
    parsed = F.transform(
        segments,
        lambda s: F.struct(
            _days_named(s).alias("days"),
            time_ranges(s, 6).alias("ranges"),
            s.rlike(TIME_RANGE).alias("timed"),
            s.rlike(CLOSED).alias("closed"),
        ),
    )

    def step(acc: Column, seg: Column) -> Column:
        known = F.coalesce(
            seg["days"], acc["days"], F.when(seg["timed"], strings(DAYS)), F.array().cast("array<string>")
        )
        shut = F.transform(
            known,
            lambda d: F.struct(
                d.alias("day"),
                F.lit(None).cast("string").alias("open"),
                F.lit(None).cast("string").alias("close"),
            ),
        )
        opened = F.flatten(
            F.transform(
                seg["ranges"],
                lambda r: F.transform(
                    known,
                    lambda d: F.struct(
                        d.alias("day"), r["open"].alias("open"), r["close"].alias("close")
                    ),
                ),
            )
        )
        new = F.when(seg["closed"] & ~seg["timed"], shut).otherwise(opened)
        return F.struct(
            F.when(F.size(known) > 0, known).alias("days"),
            F.concat(acc["entries"], new).alias("entries"),
        )

    start = F.struct(
        F.lit(None).cast("array<string>").alias("days"),
        F.array().cast(f"array<{ENTRY}>").alias("entries"),
    )
    entries = F.aggregate(parsed, start, step, lambda acc: acc["entries"])
    return _collect_days(entries, [*DAYS, "ph"])


def hours_from_lines(lines: Column) -> Column:
    """One line per day: "Monday: 7:30 AM – 8:00 PM", "Tuesday: Closed", "Open 24 hours"."""

    def parse(line: Column) -> Column:
        number = lookup(DAY_NUMBER, F.lower(F.trim(F.substring_index(line, ":", 1))))
        rest = F.regexp_replace(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1), "[   ]", " ")
        all_day = F.array(F.struct(F.lit("00:00").alias("open"), F.lit("24:00").alias("close")))
        ranges = (
            F.when(rest.rlike(CLOSED), F.array().cast(RANGES))
            .when(F.contains(F.lower(rest), F.lit("open 24 hours")), all_day)
            .otherwise(time_ranges(rest, 0))
        )
        return F.struct(F.get(strings(DAYS), number).alias("day"), ranges.alias("ranges"))

    def last_of(parsed: Column, day: str) -> Column:
        return F.try_element_at(F.filter(parsed, lambda p: p["day"] == day), F.lit(-1))["ranges"]

    whole = let(
        F.transform(lines, parse),
        lambda parsed: F.map_from_arrays(strings(DAYS), F.array(*[last_of(parsed, d) for d in DAYS])),
    )
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def opening_hours(lines: Column, text: Column) -> Column:
    """Weekday lines win over free text; nothing recognised in free text is null."""
    found = let(hours_from_text(text), lambda h: F.when(F.cardinality(h) > 0, h))
    return F.when(F.size(lines) > 0, hours_from_lines(lines)).otherwise(found)


def hours_flags(hours: Column) -> Column:
    """STRUCT(open_weekends, late_night, ph_closed), each null when unknown."""
    return let(hours, _flags_of)


def _flags_of(hours: Column) -> Column:
    week = F.map_filter(hours, lambda k, _: k != "ph")
    ranges = F.flatten(F.map_values(week))
    weekend = F.map_filter(hours, lambda k, v: k.isin("sat", "sun") & (F.size(v) > 0))
    return F.struct(
        F.when(F.cardinality(week) > 0, F.cardinality(weekend) > 0).alias("open_weekends"),
        F.when(
            F.size(ranges) > 0,
            F.exists(ranges, lambda r: (r["close"] >= "23:00") | (r["close"] < "05:00")),
        ).alias("late_night"),
        F.when(F.map_contains_key(hours, "ph"), F.size(F.try_element_at(hours, F.lit("ph"))) == 0).alias(
            "ph_closed"
        ),
    )

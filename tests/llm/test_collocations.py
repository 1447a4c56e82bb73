import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placerank.llm import collocations as col


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=100, longest=5, top=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in col.collocations(df, **kw).collect())


def invented(n=300, seed=5):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "ÉTÉ", "été", "x", "a" * 300, "don't", " "]
    return [(rng.choice(["", " ", "\t "]).join([""]) + "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " \r\n"]) for _ in range(rng.randrange(40))),
             rng.choice(["en", "fr", None, "und", ""])) for _ in range(n)]


def test_small_thresholds_equal_brute_force(spark):
    rows = invented()
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("prefix", F.lit("p")).withColumn("n", F.lit(1))
    for kw in ({"least": 3}, {"least": 10, "longest": 3, "top": 7}, {"least": 1, "longest": 2}):
        assert mined(df.repartition(5), **kw) == brute(rows, **kw)


def test_the_whole_table(spark, documents):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    found = mined(documents, least=20)
    assert found == brute(rows, least=20) and len(found) > 20


def test_copies_are_subsumed_and_overlaps_count(spark):
    rows = [("one two three four five six", "en")] * 200 + [("aa aa aa aa", "en")] * 50 + [("two three", "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    found = mined(df, least=100)
    assert found == brute(rows, least=100)
    assert {f[2]: f[3] for f in found} == {"one two three four five": 200, "two three four five six": 200, "two three": 203, "aa aa": 150, "aa aa aa": 100}


def test_no_words(spark):
    rows = [(None, "en"), ("", "en"), (" \t\n.,;", None)]
    assert mined(spark.createDataFrame(rows, "text string, lang string")) == []
    assert mined(spark.createDataFrame([], "text string, lang string")) == []


def test_a_saturated_filter_only_costs_work(spark, monkeypatch):
    rows = invented(200, 9)
    monkeypatch.setattr(col, "MOST_BITS", 1 << 12)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert mined(df, least=2) == brute(rows, least=2)


def test_pieces_of_texts():
    codes, words, piece, row = col.piece_words(pa.array(["A b.c", "", " d\te", "É"], pa.large_string()))
    assert words.take(pa.array(codes)).to_pylist() == ["a", "b", "c", "d", "e", "É"]
    assert row.tolist() == [0, 0, 0, 2, 2, 3] and piece[0] == piece[1] != piece[2] != piece[3] == piece[4] != piece[5]


def test_packed_counts_come_back():
    rng = random.Random(1)
    for top in (1, 200, 70_000, 2**61):
        keys = np.array(sorted({rng.randrange(top + 1) for _ in range(500)}), np.uint64)
        counts = np.array([rng.choice([1, 2, 300]) for _ in keys], np.int64)
        wide, data = col.pack(keys, counts)
        back = col.unpack(len(keys), wide, data)
        assert (back[0] == keys).all() and (back[1] == counts).all()

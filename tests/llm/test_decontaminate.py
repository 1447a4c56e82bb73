import random
import string
from collections import Counter

from conftest import WORD
from pyspark.sql import functions as F

from placerank.llm.decontaminate import blocks, contaminated, drop_contaminated

PLAIN = str.maketrans("", "", string.punctuation)


def cut(text, k):
    words = WORD.findall((text or "").lower().translate(PLAIN))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items, least=0.8):
    """Best similarity of all windows of an item's size, for every pair that reaches `least`."""
    found = {}
    for item, text in items:
        k = min(5, len(WORD.findall((text or "").lower().translate(PLAIN))))
        if not k:
            continue
        want = Counter(cut(text, k))
        m = sum(want.values())
        for doc, said in docs:
            have = cut(said, k)
            if len(set(have) & set(want)) < 0.3 * len(want):
                continue
            for p in range(len(have)):
                window = Counter(have[p : p + m])
                s = sum((window & want).values()) / sum((window | want).values())
                if s >= least:
                    found[doc, item] = max(s, found.get((doc, item), 0))
    return found


def result(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def test_all_documents_against_brute_force(spark, documents, texts, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute(texts, [tuple(r) for r in items.select("item_id", "text").collect()])
    got = result(contaminated(documents, items))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r.doc_id for r in drop_contaminated(documents, items).collect()}
    assert kept == {i for i, _ in texts} - {d for d, _ in want}


def test_near_passages_short_items_and_ends(spark):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    docs = [
        (1, "x y z " + item + " q r"), (2, item.upper().replace(" ", ",  ")), (3, " ".join(words[:36])), (4, " ".join(words[:20])),
        (5, "a b " + " ".join(words[:37] + ["n1", "n2", "n3"])), (6, "tiny item"), (7, "a tiny item here"), (8, None), (9, ""),
        (1, "x y z " + item + " q r"), (None, item),
    ]
    items = [(1, item), (2, "Tiny item!"), (3, None), (4, "..."), (5, item)]
    got = result(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)
    assert {d for d, _ in got} == {1, 2, 3, 5, 6, 7, None}


def test_blocks_meet_within_the_radius(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 20)):
            y ^= 1 << b
        rows.append((i, x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(rows, "i int, x long, y long")
    same = F.arrays_overlap(blocks(F.col("x"), 20), blocks(F.col("y"), 20))
    assert df.where(~same).count() == 0


def test_empty_tables_and_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert result(contaminated(odd_documents, items)) == {(1, 1): 1.0}
    assert contaminated(no_documents, items).count() == 0 and contaminated(odd_documents, items.limit(0)).count() == 0
    left = drop_contaminated(odd_documents, items)
    assert left.columns == odd_documents.columns and left.count() == 7


def test_rows_without_id_and_ids_with_two_texts_keep_their_own_verdict(spark):
    item = " ".join(f"w{i}" for i in range(40))
    clean = [(None, f"clean text {i}") for i in range(10)] + [(None, None), (2, "another text of the same id")]
    docs = spark.createDataFrame([*clean, (None, "x " + item), (2, item), (3, item + " y")], "doc_id long, text string")
    left = drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(tuple(r) for r in left.collect()) == Counter(clean)


def test_words_and_shingles_are_made_in_single_scans(spark):
    import string

    from pyspark.sql import functions as F

    from placerank.llm.decontaminate import plain_words, shingles

    texts = ["", None, " \t ", "--- !!", "A-b c\x0bd\x1ce\x85f\xa0g ¿q?", " x\n\n y. ", "İ ǅ ﬁ `~^| one, two (three) four's"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", plain_words(F.col("text")).alias("tokens"))
    got = {r.i: r for r in rows.select("i", "tokens", shingles(F.col("tokens"), 2).alias("h")).collect()}
    for i, text in enumerate(texts):
        bare = (text or "").lower().translate({ord(c): None for c in string.punctuation})
        want = [w for w in bare.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        assert got[i].tokens == want and len(got[i].h) == max(0, len(want) - 1)
    cut = F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: F.xxhash64(F.slice("tokens", i + 1, 2), F.lit(2)))
    assert {r.i: r.h for r in rows.where(F.size("tokens") > 1).select("i", cut.alias("h")).collect()} == {i: r.h for i, r in got.items() if r.h}
    plan = rows.select(shingles(F.col("tokens"), 2))._jdf.queryExecution().analyzed().toString()
    assert "translate(" not in plan and "slice(" not in plan

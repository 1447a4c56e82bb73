import random

from placerank.functions.similarity import lcs_length, lcs_lengths, partial_ratio, ratio, token_set_ratio, token_set_ratio_udf, token_set_ratios
from placerank.operators import blocking
from placerank.operators.blocking import best_windows, similar_texts, texts_near
from placerank.operators.social import _best_of_texts, _guesses_of_texts, match_captions, match_guesses, match_handles

VOCAB = "golden dragon palace kopitiam zi char hua seng lee garden luna rooftop noodle king crab old town street".split()


def mutate(rnd, s):
    s = list(s)
    for _ in range(rnd.randint(0, 3)):
        i = rnd.randrange(len(s))
        op = rnd.random()
        if op < 0.4:
            s[i] = rnd.choice("abcdeins ")
        elif op < 0.7:
            s.insert(i, rnd.choice("abcdeins"))
        elif len(s) > 3:
            del s[i]
    return " ".join("".join(s).split())


def test_no_similar_pair_is_lost(spark):
    rnd = random.Random(5)
    left = {" ".join(rnd.sample(VOCAB, rnd.randint(1, 4))) for _ in range(60)}
    right = {mutate(rnd, s) for s in left for _ in range(2)} | {" ".join(rnd.sample(VOCAB, 3)) for _ in range(30)}
    right.discard("")
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "text string")
    pairs = similar_texts(df(left), df(right))
    got = {(r.left_text, r.right_text) for r in pairs.where(token_set_ratio_udf("left_text", "right_text") >= 88).collect()}
    want = {(a, b) for a in left for b in right if token_set_ratio(a, b) >= 88}
    assert want and got == want


def test_nothing_is_lost_when_blanks_move_and_few_pairs_are_left(spark):
    rnd = random.Random(21)
    vocab = [*VOCAB, "a", "25", "2", "brand"]
    left = {" ".join(rnd.choices(vocab, k=rnd.randint(1, 5))) for _ in range(150)}
    right = set()
    for s in left:
        for _ in range(2):
            t = list(mutate(rnd, s))
            if " " in t and rnd.random() < 0.5:
                t.remove(" ")
            if len(t) > 3 and rnd.random() < 0.5:
                t.insert(rnd.randrange(1, len(t)), " ")
            right.add(" ".join("".join(t).split()))
    right.discard("")
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "text string")
    got = {(r.left_text, r.right_text) for r in similar_texts(df(left), df(right)).collect()}
    want = {(a, b) for a in left for b in right if token_set_ratio(a, b) >= 88}
    assert len(want) > 300 and want <= got and len(got) < 2 * len(want)


def test_ratios_of_a_batch_equal_those_of_pairs():
    rnd = random.Random(2)
    texts = lambda: ["".join(rnd.choice("abcé ") for _ in range(rnd.choice([0, 1, 7, 63, 64, 90]))) for _ in range(400)]
    left, right = texts(), texts()
    assert lcs_lengths(left, right).tolist() == [lcs_length(a, b) for a, b in zip(left, right)]
    left, right = ([" ".join(rnd.choices(VOCAB, k=rnd.randint(0, 5))) for _ in range(400)] for _ in range(2))
    assert token_set_ratios(left, right).tolist() == [token_set_ratio(a, b) for a, b in zip(left, right)]


def test_zones_keep_pairs_apart(spark):
    left = spark.createDataFrame([("luna bar", "1"), ("luna hall", None)], "text string, zone string")
    right = spark.createDataFrame([("luna bar x", "1"), ("luna bar y", "2"), ("luna hall z", "3"), ("luna bar w", None)], "text string, zone string")
    got = {(r.left_text, r.right_text) for r in similar_texts(left, right).collect()}
    assert {("luna bar", "luna bar x"), ("luna bar", "luna bar w"), ("luna hall", "luna hall z")} <= got
    assert ("luna bar", "luna bar y") not in got


def brute_partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))} - {""}
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n) if short[max(0, i) : i + n]))
    return best


def test_partial_ratio_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 8)))
        b = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 20)))
        assert abs(partial_ratio(a, b) - brute_partial(a, b)) < 1e-9, (a, b)


def test_windows_are_found(spark):
    rnd = random.Random(9)
    needles = {" ".join(rnd.sample(VOCAB, 2)) for _ in range(25)}
    hays = {"dinner at " + mutate(rnd, s) + " tonight" for s in needles} | {"nothing to see here"}
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "text string")
    got = {(r.needle, r.haystack) for r in texts_near(df(needles), df(hays)).collect()}
    want = {(a, b) for a in needles for b in hays if len(a) <= len(b) and partial_ratio(a, b) >= 88}
    assert want and want <= got


def test_best_windows_equal_brute_force(spark):
    rnd = random.Random(11)
    needles = {" ".join(rnd.sample(VOCAB, 2)) for _ in range(30)} | {"abcdefgh", "x" * 40}
    hays = {"at " + mutate(rnd, mutate(rnd, s)) + " now" for s in needles} | {"abxdexgh and more", "nothing to see here"}
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "text string")
    for whole, least in ((False, 60), (False, 75), (True, 40)):
        score = ratio if whole else (lambda a, b: partial_ratio(a, b) if len(a) <= len(b) else 0.0)
        got = {}
        for r in best_windows(df(needles), df(hays), least, 3, whole, block=7).collect():
            assert abs(score(r.needle, r.haystack) - r.score) < 1e-9
            got.setdefault(r.haystack, []).append(r.score)
        for h in hays:
            want = sorted((s for s in (score(x, h) for x in needles) if s >= least), reverse=True)
            assert sorted(got.get(h, []), reverse=True)[:3] == want[:3]


def test_guesses_without_a_shared_trigram(spark):
    mentions = spark.createDataFrame([("m1", "abxdexgh and more", None), ("m2", None, "pqxstxvw")], "key string, caption string, creator_handle string")
    keys = spark.createDataFrame([("v1", "abcdefgh", "abcdefgh"), ("v2", "pqrstuvw", "pqrstuvw")], "venue_id string, name_key string, handle_key string")
    assert {(r.key, r.venue_id, r.score) for r in match_guesses(mentions, keys).collect()} == {("m1", "v1", 75.0), ("m2", "v2", 75.0)}


def test_copies_of_texts_and_names_are_not_multiplied(spark):
    keys = spark.createDataFrame([(f"v{i:03d}", "golden dragon", "goldendragon") for i in range(200)], "venue_id string, name_key string, handle_key string")
    rows = [(f"m{i:03d}", "dinner at golden dragon tonight", "golden_dragon_sg") for i in range(150)]
    mentions = spark.createDataFrame(rows, "key string, caption string, creator_handle string")
    for match, score in ((match_handles, 95.0), (match_captions, 100.0)):
        assert {(r.key, r.venue_id, r.score) for r in match(mentions, keys).collect()} == {(k, "v000", score) for k, _, _ in rows}
    got = match_guesses(mentions, keys).collect()
    assert {(r.key, r.venue_id, r["rank"]) for r in got} == {(k, f"v00{i}", i + 1) for k, _, _ in rows for i in range(3)}
    scored = spark.createDataFrame([("golden dragon", "at golden dragon", 100.0)], "needle string, haystack string, score double")
    assert _best_of_texts(scored, keys, "name_key").count() == 1 and _guesses_of_texts(scored, keys, "name_key", 3).count() == 3


def test_texts_of_a_zone_meet_in_it_alone(spark, monkeypatch):
    """Small zones are compared whole, crowded ones through the indexes; `inside` says in which zone a pair meets."""
    monkeypatch.setattr(blocking, "_WHOLE_ZONE", 3)
    rnd = random.Random(8)
    left = {(" ".join(rnd.sample(VOCAB, rnd.randint(1, 4))), rnd.choice(["crowd", "crowd", *"abcdefgh", None])) for _ in range(60)}
    right = {(mutate(rnd, s), rnd.choice([z, z, "crowd", "a", None])) for s, z in left for _ in range(2)}
    right = {r for r in right if r[0]}
    df = lambda xs: spark.createDataFrame(sorted(xs, key=str), "text string, zone string")
    found = blocking.candidates(df(left), df(right))
    like = {(a, b) for a, _ in left for b, _ in right if token_set_ratio(a, b) >= 88}
    pairs = {tuple(r) for r in found.pairs.collect()}
    assert {(a, b) for a, p in left for b, q in right if (p is None or q is None or p == q) and (a, b) in like} <= pairs
    inside = {tuple(r) for r in found.inside.collect()}
    want = {(a, b, p) for a, p in left for b, q in right if p is not None and p == q and (a, b) in like}
    assert want and {t for t in inside if t[:2] in like} == want
    assert {z for _, _, z in inside} <= {p for _, p in left} & {q for _, q in right}

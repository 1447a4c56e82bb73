import hashlib
import random
import re

from pyspark.sql import functions as F

from placerank.llm.secrets import battery, scan, structured_below

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(spans)]


def check(rows, docs):
    for r, (i, text) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d[0]), strict=True):
        want = base(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.doc_id == i and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, want, r)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, *_ in want) for x in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]


def test_all_documents_against_python_patterns(documents, texts):
    check(scan(documents).collect(), texts)


def test_odd_matches(spark):
    texts = [
        "token=api_key: abcdefgh1234", "PassWord = 'hunter2hunter2' and secret:short", "😀😀 api_key=\"ABCDEFGH\" é token : x", "AKIAAKIAAKIAAKIA AKIA1234", "AKIA" + "Z" * 40,
        "f" * 31 + " " + "0" * 32 + "g" + "a" * 33, "secret=" + "deadbeef" * 5, "secret\n=\nabcdefghij", "tokens=abcdefghijk passwd''=xyz12345678", "", None, "api_key" * 3000,
        "password=" * 50 + "longenough", "x" * 100_000 + " token=abcdefgh", "ſecret=abcdefgh Key", "token=аbcdefghij",
    ]
    docs = list(enumerate(texts))
    check(scan(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_random_tokens_are_told_from_structured_ones(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = [(i, "key " + "".join(rng.choice(letters) for _ in range(rng.randint(32, 64))) + " end") for i in range(120)]
    plain = []
    for i in range(120):
        word = ["Aaaa0aaaaa" * 5, "Chapter1Chapter2Chapter3Chapter4", "abcABC0123456789" * 3, "Zz9" + "a" * 40][i % 4]
        plain.append((1000 + i, "see " + word + " there"))
    got = {r.doc_id: r.n_random for r in scan(spark.createDataFrame(secrets + plain, "doc_id long, text string")).collect()}
    assert sum(got[i] for i, _ in secrets) >= 108 and sum(got[i] for i, _ in plain) <= 30


def test_p_values_are_uniform_for_random_tokens(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("0123456789abcdef") for _ in range(96))) for i in range(1500)]
    df = battery(spark.createDataFrame(rows, "i long, token string"))
    for c in ("p1", "p2", "p3"):
        mean, low = df.agg(F.avg(c), F.avg(F.expr(f"int({c} < 0.1)"))).first()
        assert 0.45 < mean < 0.56 and 0.06 < low < 0.14, c


def test_step_up_control(spark):
    ps = [0.001, 0.002, 0.004, 0.03, 0.2, 0.5, 0.6, 0.7, 0.8, 0.9]
    df = spark.createDataFrame([("hex", 10, p) for p in ps] + [("hex", 12, 0.5)], "encoding string, band long, p double")
    cuts = {r.band: r.cut for r in structured_below(df, 0.05).collect()}
    assert 0.004 <= cuts[10] < 0.03 and 12 not in cuts


def test_odd_rows_and_empty_tables(odd_documents, no_documents):
    assert scan(odd_documents).count() == 9 and scan(no_documents).count() == 0

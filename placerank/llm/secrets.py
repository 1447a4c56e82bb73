"""Secret scan: three fixed patterns, and a battery of randomness tests over long tokens, with DataFrame functions only.

Tokens outside the patterns' matches whose characters fit an encoding (hex, base32, base64) are tested against that
encoding's uniform distribution: chi-squared of the symbol counts, runs above and below the middle of the alphabet, and
lag-1 serial correlation.  The three p-values are combined by Fisher's rule.  A small p means structure: names, words,
counters, paths.  Step-up control of the false-discovery rate (Benjamini-Hochberg) runs over all tokens of the corpus
within classes of equal encoding and similar length, since short tokens are weak evidence and must not set the bar for
long ones; tokens it finds structured are dropped and the rest are reported as `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placerank.llm.common import materialise, small

#: Fixed by the contract: kind, pattern, group whose length counts, least length; a cheap test that any match passes.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8, r"(?i:passw|secret|token|api_?key)"),
    ("access", r"AKIA[A-Z0-9]+", 2, 16, r"AKIA"),
    ("hex", r"[0-9a-f]+", 2, 32, r"[0-9a-f]{32}"),
]
#: Encodings by preference: name, characters as a class, alphabet in order of value, least length, characters it must have.
ENCODINGS = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789ABCDEF", 32, r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26, r"[A-Z].*[2-7]|[2-7].*[A-Z]"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"),
]
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
RATE = 0.05
#: Bins per unit of -ln p in which p-values are ranked; their number is bounded by the range of doubles.
BINS = 64


def found_spans(text: Column, pattern: str, group: int, least: int, hint: str) -> Column:
    """(start, end, length of the group) of leftmost non-overlapping matches, in code points.

    Every match is taken with the text before it, so that lengths add up to positions; the end of the text closes the
    list.  Texts without the hint are not searched."""
    whole = rf"(?s)(.*?)({pattern}|\z)"
    part = [F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in (1, 2, group)]
    steps = F.arrays_zip(F.transform(part[0], lambda x: F.length(x)).alias("gap"), F.transform(part[1], lambda x: F.length(x)).alias("took"), F.transform(part[2], lambda x: F.length(x)).alias("size"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["took"]).alias("end")))
        return F.struct((begin + x["took"]).alias("at"), F.when(x["size"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(hint), F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(empty)


def tail(z: Column, t: Column) -> Column:
    """Upper tail of the normal distribution; t = 1 / (1 + 0.3275911 |z| / sqrt 2) (erfc to 2e-7)."""
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z / 2)
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding and p (Fisher's combination of the three tests) to rows with `token`; tokens of no encoding go."""
    kind = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for name, shape, letters, least, must in reversed(ENCODINGS):
        fits = F.col("token").rlike(shape) & F.col("token").rlike(must) & (F.length("token") >= least)
        kind = F.when(fits, name).otherwise(kind)
        alphabet = F.when(fits, letters).otherwise(alphabet)
    rows = tokens.withColumn("encoding", kind).withColumn("alphabet", alphabet).where("encoding is not null")
    plain = F.translate(F.rtrim(F.translate("token", "=", " ")), "-_", "+/")
    plain = F.when(F.col("encoding") == "hex", F.upper(plain)).otherwise(plain)
    rows = rows.withColumn("values", F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.col("alphabet")) - 1))
    # one column after the other: each is computed once, where a single expression would repeat its parts
    pairs = F.arrays_zip(F.slice("values", F.lit(1), F.size("values") - 1).alias("x"), F.slice("values", F.lit(2), F.size("values") - 1).alias("y"))
    rows = rows.withColumns({"n": F.size("values").cast("double"), "size": F.length("alphabet").cast("double"), "pairs": pairs})
    n, size, mean, above, below = F.col("n"), F.col("size"), F.col("mean"), F.col("above"), F.col("n") - F.col("above")
    alike = lambda v: F.size(F.filter("values", lambda y: y == v)).cast("double")
    rows = rows.withColumns({
        "squares": F.aggregate(F.array_distinct("values"), F.lit(0.0), lambda acc, v: acc + alike(v) * alike(v)),
        "above": F.size(F.filter("values", lambda v: v >= F.col("size") / 2)).cast("double"),
        "runs": 1 + F.size(F.filter("pairs", lambda p: (p["x"] >= F.col("size") / 2) != (p["y"] >= F.col("size") / 2))).cast("double"),
        "mean": F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v) / n,
    })
    rows = rows.withColumns({
        "chi": F.col("squares") * size / n - n, "expected": 1 + 2 * above * below / n,
        "power": F.aggregate("values", F.lit(0.0), lambda acc, v: acc + (v - F.col("mean")) * (v - F.col("mean"))),
        "lagged": F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + (p["x"] - F.col("mean")) * (p["y"] - F.col("mean"))),
    })
    df = size - 1
    spread = (F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1)
    rows = rows.withColumns({
        "z1": (F.cbrt(F.col("chi") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z2": F.when(spread > 0, F.abs(F.col("runs") - F.col("expected")) / F.sqrt(spread)).otherwise(F.lit(9.0)),
        "z3": F.when(F.col("power") > 0, F.abs(F.col("lagged") / F.col("power") * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.lit(9.0)),
    })
    for k, sides in ((1, 1), (2, 2), (3, 2)):
        rows = rows.withColumn(f"t{k}", 1 / (1 + 0.3275911 * F.abs(f"z{k}") / 2**0.5))
        rows = rows.withColumn(f"p{k}", F.greatest(F.least(sides * tail(F.col(f"z{k}"), F.col(f"t{k}")), F.lit(1.0)), F.lit(1e-100)))
    rows = rows.withColumn("logs", F.ln("p1") + F.ln("p2") + F.ln("p3"))
    logs = F.col("logs")
    p = F.exp(logs) * (1 - logs + logs * logs / 2)  # upper tail of chi-squared with 6 degrees at -2 * logs
    return rows.withColumn("p", F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-100))).select(*tokens.columns, "encoding", "p1", "p2", "p3", "p")


def structured_below(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """encoding, band (length class) and `cut`: tokens with p <= cut are structured at this false-discovery rate.

    P-values are counted in bins of -ln p, so that each class ranks a bounded number of rows whatever its tokens."""
    bins = tested.groupBy("encoding", "band", F.floor(-F.ln("p") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("encoding", "band")
    ranked = bins.withColumn("rank", F.sum("k").over(w.orderBy(F.col("bin").desc()))).withColumn("m", F.sum("k").over(w))
    edge = F.exp(-F.col("bin") / BINS)  # the largest p of the bin
    return ranked.where(edge <= rate * F.col("rank") / F.col("m")).groupBy("encoding", "band").agg(F.max(edge).alias("cut"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row's whole text; null texts are empty.

    Repeated rows of one doc_id and text have the same spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = [found_spans(text, pattern, group, least, hint).alias(kind) for kind, pattern, group, least, hint in BASE]
    tokens = found_spans(text, TOKEN, 2, 24, TOKEN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), *cols, text.alias("_text"), tokens.alias("tokens"))
    taken = F.concat(*[F.col(kind) for kind, *_ in BASE])
    free = F.filter("tokens", lambda t: ~F.exists(taken, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    cut = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.substring(F.col("_text"), t["start"] + 1, t["end"] - t["start"]).alias("token")))
    rows = materialise(rows.select("doc_id", "mark", *[kind for kind, *_ in BASE], cut.alias("tokens")))
    loose = rows.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.*").distinct()
    tested = materialise(battery(loose).withColumn("band", F.floor(F.log2(F.length("token").cast("double")) * 2)))
    cuts = small(structured_below(tested, rate))
    random = tested.join(cuts, ["encoding", "band"], "left").where(F.col("cut").isNull() | (F.col("p") > F.col("cut")))
    random = random.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("random"))
    random = random.select(F.col("doc_id").alias("d"), F.col("mark").alias("k"), "random")
    rows = rows.join(random, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k")), "left")
    kinds = [kind for kind, *_ in BASE]

    def listed(names: list[str]) -> Column:
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")

        def of(rank: int, kind: str) -> Column:
            return F.transform(F.coalesce(F.col(kind), none), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

        own = [of(i, k) for i, k in enumerate(names)]
        return F.array_join(F.transform(F.array_sort(F.concat(*own)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(listed(kinds).cast("binary"), 256).alias("base_sha256"),
        listed([*kinds, "random"]).alias("spans"), F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"),
    )

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from placerank.llm import vector_codes as vc


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error) and the digest, by plain loops over Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    size = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * size : (k + 1) * size]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]
    pick = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(pick(cut(v, k), books[k])[1], []).append(cut(v, k))
            for j, g in groups.items():
                books[k][j] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, v, lab in kept:
        found = [pick(cut(v, k), books[k]) for k in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def compare(df, rows):
    want, digest = brute(rows)
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())
    assert got == sorted((i, c, e, sums[lab], digest) for i, lab, c, e in want)


def test_search_equals_brute_force_with_ties_and_huge_values():
    rng = np.random.default_rng(7)
    for turn in range(300):
        wide = int(rng.integers(0, 6))
        entries = rng.integers(-4, 5, (int(rng.integers(1, 17)), wide))
        rows = rng.integers(-5, 6, (40, wide))
        if turn % 5 == 0:
            rows, entries = rows * 2**47, entries * 2**47
        at, best = vc.nearest(rows, entries)
        far = ((rows[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2) if wide else np.zeros((40, len(entries)), object)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_the_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    compare(vc.vector_codes(table), [(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_odd_rows_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(100 + i, [0.25] * 16, 3) for i in range(40)]
    rows += [(-1, None, 1), (-2, [0.5] * 15 + [None], 1), (-3, [float("nan")] * 16, 1), (-4, [float("-inf")] + [0.0] * 15, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("n", F.lit(1))
    compare(vc.vector_codes(df.repartition(5)), rows)


def test_few_short_unequal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = vc.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], None), (3, [1.0], 5)], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in few) == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    assert vc.vector_codes(spark.createDataFrame([], schema)).count() == 0
    empty = vc.vector_codes(spark.createDataFrame([(1, [], 1), (None, [], 1)], schema)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 8, 0)] * 2
    huge = vc.vector_codes(spark.createDataFrame([(i, [3e38 * (-1) ** (i // 16)] * 8, 1) for i in range(40)], schema)).collect()
    assert len(huge) == 40 and {r.error for r in huge if r.vec_id < 16} == {0}

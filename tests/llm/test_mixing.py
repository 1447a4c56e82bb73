from collections import defaultdict

import pytest
from conftest import WORD
from pyspark.sql import functions as F

from placerank.llm.mixing import demanded_at, mix, mix_report, mixed_documents, source_targets


def water(sizes, weights, repeats=3):
    """Targets by repeated resharing: cut what is above its bound, share the rest again."""
    total, cut = sum(sizes.values()), {}
    while True:
        rest = total - sum(cut.values())
        open_ = {s: w for s, w in weights.items() if s not in cut}
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return cut | share
        cut |= {s: repeats * sizes[s] for s in over}


def by_source(rows):
    names = sorted({r[1] for r in rows if r[1] is not None}, key=lambda s: s.encode()) + ([None] if any(r[1] is None for r in rows) else [])
    return {s: 1 + i % 3 for i, s in enumerate(names)}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 0, None: 50}, {"x": 0, "y": 0}, {"one": 7}, {"a": 1, "b": 1, "c": 500}, {"a": 10, "b": 20, "c": 30, "d": 10, "e": 20}])
def test_targets_are_the_fixed_point_of_resharing(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = water(sizes, by_source([(0, s) for s in sizes]))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_all_documents(documents):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in documents.collect()]
    got = {r.doc_id: r for r in mix_report(documents).collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, s, n in rows:
        assert got[i].size == n and got[i].taken % max(1, n) == 0 and 0 <= got[i].taken <= 3 * n
        sizes[s] += n
        taken[s] += got[i].taken
        largest[s] = max(largest[s], n)
    want = water(sizes, by_source(rows))
    for i, s, _ in rows:
        assert got[i].source_size == sizes[s] and abs(got[i].target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert {r.doc_id: r.taken for r in mix_report(documents.repartition(7)).collect()} == {i: r.taken for i, r in got.items()}


def test_positions_invert_the_integrated_schedule(spark):
    df = spark.createDataFrame([(s / 10, c / 20) for s in range(-20, 21, 5) for c in range(21)], "slope double, u double")
    for r in df.select("slope", "u", demanded_at(F.col("u"), F.lit(1.0), F.col("slope")).alias("t")).collect():
        assert abs(r.t * (1 - r.slope / 2) + r.slope * r.t**2 / 2 - r.u) < 1e-9 and -1e-9 <= r.t <= 1 + 1e-9


def test_early_sources_come_early_and_rows_are_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * 5, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    rows = mix(docs, weights=(1, 1, 1), slopes=(-2.0, 0.0, 2.0)).select("source", F.explode("times").alias("t")).groupBy("source").agg(F.avg("t").alias("t")).collect()
    mean = {r.source: r.t for r in rows}
    assert mean["s0"] < 0.4 < mean["s1"] < 0.6 < mean["s2"]
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == 900


def test_a_hot_source_is_summed_in_small_windows(spark):
    docs = spark.createDataFrame([(i, "a b", "hot" if i % 10 else "cold") for i in range(2000)], "doc_id long, text string, source string")
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan
    got = mix_report(docs).groupBy("source_size").agg(F.sum("taken").alias("n")).collect()
    assert {r.source_size for r in got} == {3600, 400}


def test_odd_rows_and_empty_tables(odd_documents, no_documents):
    rows = mix_report(odd_documents).collect()
    assert len(rows) == 9 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mix_report(no_documents).count() == 0 and mixed_documents(no_documents).count() == 0
    assert mixed_documents(odd_documents).columns == odd_documents.columns


def test_words_are_counted_without_an_array_of_them(spark, documents):
    """Sizes are counted twice over whole texts: no array is cut for them and no character is looked up in a map."""
    from placerank.llm.common import word_count, words

    odd = [None, "", " ", "x", " x", "x ", "a\u00a0b c", "\t\n\x0b\x0c\r ", "one\r\ntwo\x0bthree  four\t", "xx x\x1cx", "é\u2003日 本\x00y"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").union(documents.select("text"))
    got = rows.select(word_count(rows["text"]).alias("n"), F.size(words(rows["text"])).alias("want")).collect()
    assert len(got) > len(odd) and [r.n for r in got] == [r.want for r in got] and [r.n for r in got[:9]] == [0, 0, 0, 1, 1, 1, 2, 0, 4]
    plan = mix(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "split(" not in plan

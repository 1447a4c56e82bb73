from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import WORD

import placerank.llm.arrow_text as arrow_text
from placerank.llm.quality import COUNTS, Condition, as_column, learn_list, measure, quality_verdicts, text_counts


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_of_odd_texts():
    odd = ["", " ", "a", "a b a b a b", "x y z x y z", "é ü\x0bß\x0c#$", "\n\nq\nq\n \nq", "a a a a", "   x"]
    got = measure(pa.array(odd, pa.large_string()))
    for i, text in enumerate(odd):
        assert tuple(int(got[c][i]) for c in COUNTS[:5]) == brute(text), text


def test_counts_of_all_documents(documents, texts, monkeypatch):
    got = {r.doc_id: tuple(r)[1:6] for r in text_counts(documents).collect()}
    assert got == {i: brute(t) for i, t in texts}


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array([f"Text {i} ABC" for i in range(50)] + [None])], ["text"])
    parts = [arrow_text.text_of(p).to_pylist() for p in arrow_text.slices(batch, limit=30)]
    assert sum(parts, []) == [f"Text {i} ABC" for i in range(50)] + [""] and len(parts) > 10
    lowered = [pa.compute.ascii_lower(arrow_text.text_of(p)).to_pylist() for p in arrow_text.slices(batch, limit=30)]
    assert sum(lowered, []) == [f"text {i} abc" for i in range(50)] + [""]


def test_covering_finds_conjunctions():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.3)) | (x["b"] > 0.95)
    rules = learn_list(x, bad)
    fired = np.zeros(3000, bool)
    for rule in rules:
        hit = np.ones(3000, bool)
        for c in rule:
            hit &= c.holds(x)
        fired |= hit
    assert (fired == bad).mean() > 0.97 and all(c.feature != "noise" for c in rules[0])


@pytest.mark.parametrize("bad", [[True] * 9, [False] * 9, []])
def test_one_class_or_nothing_teaches_nothing(bad):
    assert learn_list({"a": np.arange(len(bad), dtype=float)}, np.array(bad, bool)) == []


def test_rules_are_ordered_when_branches(spark):
    column = as_column([[Condition("n_words", True, 5.0)], [Condition("symbols", True, 0.5)]])
    assert str(column).count("WHEN") == 2


def test_verdicts(spark, documents, sf_dir, texts):
    got = {r.doc_id: r for r in quality_verdicts(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    for i, t in texts:
        n, *_, repeated = brute(t)
        assert got[i].base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (got[i].base_failed and got[i].kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    fine = [got[i].kept for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    assert sum(fine) / len(fine) > 0.95


def test_odd_rows_and_empty_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_verdicts(odd_documents, labels).collect()
    assert len(rows) == 9 and sum(r.kept for r in rows) == 0  # the long one repeats itself
    assert quality_verdicts(no_documents, labels).count() == 0
    assert quality_verdicts(odd_documents, labels.limit(0)).count() == 9

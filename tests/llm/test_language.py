import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from placerank.llm import language
from placerank.llm.language import BUCKETS, UNKNOWN, fit, keep_known_languages, posteriors, predict_languages, train, word_features


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    trans, first = rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    starts = np.array([0, 4, 4, 5, 10])
    emit = rng.random((10, 3)) + 0.05
    got = posteriors(emit, starts, trans, first)
    for a, b in itertools.pairwise(starts):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = first[path[0]] * emit[a, path[0]] if path else 0
            for t in range(1, b - a):
                w *= trans[path[t - 1], path[t]] * emit[a + t, path[t]]
            for t in range(b - a):
                want[t, path[t]] += w
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))
    assert posteriors(np.zeros((0, 3)), np.zeros(1, int), trans, first).shape == (0, 3)


def test_code_switched_words_are_labelled(texts, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    known = [r for r in rows.values() if r.text and r.lang and r.doc_id % 2]
    model = train([r.text for r in known], [r.lang for r in known])
    import pyarrow as pa

    held = {}
    for r in rows.values():
        if r.doc_id % 2 == 0 and r.text and len(r.text) > 300:
            held.setdefault(r.lang, r.text)
    a, b = sorted(held)[:2]
    mean, *_ = model.score(pa.array([held[a][:300] + " " + held[b][:300]], pa.large_string()))
    top = sorted(model.labels[i] for i in np.argsort(mean[0])[-2:])
    assert top == [a, b] and mean[0].max() < 0.8


def test_mixed_texts_stay_and_marks_alone_have_no_language(spark, documents):
    texts = {}
    for r in documents.collect():
        if r.text and r.lang and len(r.text) > 400:
            texts.setdefault(r.lang, r.text)
    some = sorted(texts)[:3]
    mix = " ".join(" ".join(texts[k].split()[: n]) for k, n in zip(some, (27, 27, 6)))
    odd = spark.createDataFrame([(10**6, mix, None, None, 0), (10**6 + 1, "\u0301 \u0301\u0300", None, None, 0), (10**6 + 2, "x" * 300_000, None, None, 0)], documents.schema)
    both = documents.unionByName(odd)
    assert 10**6 in {r.doc_id for r in keep_known_languages(both).where("doc_id >= 1000000").collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(both).where("doc_id >= 1000000").collect()}
    assert got[10**6 + 1] == (UNKNOWN, 0.0) and got[10**6 + 2][0] != UNKNOWN and got[10**6][1] < 0.7


def test_every_part_of_a_long_word_counts():
    word = "donaudampfschifffahrtsgesellschaft"
    assert len(set(word_features(word))) > 80 and word_features(word)[-1] == zlib.crc32(b"aft") % (BUCKETS - 1) + 1


def test_held_out_accuracy(documents):
    rows = {r.doc_id: r for r in predict_languages(documents).collect()}
    right = total = 0
    for r in documents.collect():
        got = rows[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= got.score <= 1
        if got.held_out and r.lang:
            total += 1
            right += got.lang_pred == r.lang
    assert total > 30 and right / total > 0.95


def test_predictions_use_the_text_alone(documents):
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.col("lang")))
    changed = changed.withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, predict_languages(changed).collect())) == sorted(map(tuple, predict_languages(documents).collect()))


def test_odd_rows_and_empty_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.lang_pred) for r in predict_languages(odd_documents).collect()]
    assert len(rows) == 9 and {p for i, p in rows if i in (2, 3, 4, 7)} == {UNKNOWN}
    assert predict_languages(no_documents).count() == 0 and fit(no_documents) is None
    left = keep_known_languages(odd_documents)
    assert left.columns == odd_documents.columns and {r.doc_id for r in left.collect()} <= {1, 5, 6, None}


def test_features_of_many_words_are_those_of_each(monkeypatch):
    words = ["", "a", "banana", "aaaa", "anannanan", "schöön", "éé", "ñandú", "ßß", "日本語", "x日", "\u07ff\u0800", "z" * 300, "abcd", "\ud800x"]
    want = [language.word_features(w) for w in words]
    flat, counts = language.feature_rows(words)
    assert flat.tolist() == [f for w in want for f in w] and counts.tolist() == [len(w) for w in want]
    assert [len(x) for x in language.feature_rows([])] == [0, 0]
    # letters of one or two bytes are not gone through word by word
    monkeypatch.delattr(language, "word_features")
    assert language.feature_rows(words[:9])[1].tolist() == counts[:9].tolist()

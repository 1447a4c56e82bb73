import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest import WORD

import placerank.llm.near_dedup as near_dedup
from placerank.llm.graph import components
from placerank.llm.near_dedup import drop_near_duplicates, near_duplicates, shingle_sets, sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, size):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in seen[s])
        for j, k in shared.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_all_documents_against_brute_force(documents, texts):
    got = near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_slices_agree_with_whole_batches(texts, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts])], ["text"])
    from placerank.llm.arrow_text import slices, text_of

    whole, _ = shingle_sets(text_of(batch))
    parts = np.concatenate([shingle_sets(text_of(p))[0] for p in slices(batch, limit=20_000)])
    assert (whole == parts).all()


def test_chains_and_large_groups_of_near_copies(spark):
    """A drifting chain (neighbours linked, ends not) and a group of near copies of one text, among unrelated texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = rng.sample(words, 60)
    rows, chain = [], rng.sample(words, 60)
    for i in range(30):
        chain = chain.copy()
        chain[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 + i, " ".join(chain)))
    for i in range(150):
        copy = base.copy()
        for _ in range(i % 4):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, " ".join(rng.sample(words, 50))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_duplicates(df)) == brute(rows, 2)


def test_sketches_fill_and_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 3000):
        shared = rng.integers(1 << 62, size=n, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([shared, rng.integers(1 << 62, size=n // 4, dtype=np.uint64)])) for _ in range(2))
        s = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert (s != near_dedup.FULL).all()
        assert abs((s[0] == s[1]).mean() - n / (n + 2 * (n // 4))) < 0.1


def test_components_of_stars_and_paths(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 420)] + [(900, 900), (999, 500), (500, 700), (700, 999)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(300, 421)} == {300}
    assert got[900] == 900 and got[999] == got[700] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_path_takes_logarithmic_rounds_in_any_order(spark, monkeypatch):
    import placerank.llm.graph as graph

    cuts, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: cuts.append(1) or settle(df))
    for ids in (list(range(10_000)), random.Random(1).sample(range(10_000), 10_000)):
        cuts.clear()
        path = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
        assert [tuple(r) for r in components(path).groupBy("label").count().collect()] == [(0, 10_000)]
        assert len(cuts) <= 60


def test_odd_rows_and_empty_tables(odd_documents, no_documents):
    rows = near_duplicates(odd_documents).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got == Counter({
        (1, 5, 1, True): 2, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 1, 5, True): 1, (None, 5, None, True): 1,
        (6, 5, 6, True): 1, (7, 1, 7, True): 1,
    })
    assert near_duplicates(no_documents).count() == 0
    left = drop_near_duplicates(odd_documents)
    assert left.columns == odd_documents.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]


def test_rows_without_id_and_ids_with_two_texts_keep_their_own_verdict(spark):
    copied, near = " ".join(f"c{i}" for i in range(60)), " ".join(f"c{i}" for i in range(59))
    rows = [(None, f"own words of row {i} and no other {i * i}") for i in range(20)] + [(None, copied), (None, copied), (None, None), (None, None), (None, " ")]
    rows += [(1, copied), (2, near), (2, "another text of the same id that no row shares"), (2, "another text of the same id that no row shares")]
    rows += [(3, "first text of three stands here"), (3, "second one of three is different"), (4, None), (4, None), (4, "")]
    got = Counter(tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    want = Counter({r: 1 for r in rows if r not in {(None, copied), (2, near)}})
    want[None, None] = 2
    assert got == want
    both = near_duplicates(spark.createDataFrame([(None, copied), (7, copied)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in both} == {(None, 7, False), (7, 7, True)}

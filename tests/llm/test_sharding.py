import random
import zlib
from collections import defaultdict

from placerank.llm.sharding import Treap, best_fit_decreasing, pack_evenly, shard


def naive(items, capacity):
    left, placed = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(r, b) for b, r in enumerate(left) if r >= size]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(max(capacity, size))
        left[b] -= size
        placed[name] = b
    return placed


def test_tree_packs_like_a_scan_of_all_bins():
    rng = random.Random(1)
    for _ in range(30):
        items = [(f"g{i}", rng.randint(1, 60)) for i in range(rng.randint(0, 120))]
        assert best_fit_decreasing(items, 50) == naive(items, 50)


def test_tree_takes_the_tightest_entry():
    tree = Treap()
    keys = random.Random(2).sample(range(1000), 200)
    for k in keys:
        tree.add((k, 0))
    for bound in (0, 500, 999, 1000):
        want = min((k for k in keys if k >= bound), default=None)
        got = tree.take_at_least((bound, -1))
        assert (got and got[0]) == want
        if got:
            tree.add(got)
    assert tree.take_largest() == (max(keys), 0)


def test_few_bins_for_fixed_capacity():
    rng = random.Random(3)
    items = [(f"g{i}", rng.randint(1, 40)) for i in range(3000)]
    used = len(set(best_fit_decreasing(items, 100).values()))
    assert used <= 1.02 * sum(s for _, s in items) / 100 + 1


def test_a_giant_takes_a_shard_and_the_rest_is_even():
    placed = pack_evenly([("giant", 10_000)] + [(f"g{i}", 10) for i in range(900)], 10)
    load = defaultdict(int)
    for name, b in placed.items():
        load[b] += 10_000 if name == "giant" else 10
    assert sorted(load.values()) == [1000] * 9 + [10_000]


def check(rows, docs, shards=40):
    assert len(rows) == len(docs)
    slots, group = defaultdict(list), {}
    text = {i: t for i, t in docs}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < shards
        assert group.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_all_documents(documents, texts):
    check(shard(documents).collect(), texts)


def test_even_sizes_through_bundles(spark):
    rng = random.Random(6)
    docs = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(5000 + i, "copy") for i in range(200)]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string"), shards=8, bundles=256).collect()
    check(rows, docs, 8)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8


def test_odd_rows_and_empty_tables(odd_documents, no_documents):
    rows = shard(odd_documents).collect()
    assert len(rows) == 9 and len({r.shard for r in rows if r.size == 16}) == 1
    assert shard(no_documents).count() == 0

import os

from builders import sighting, sightings
from pyspark.sql import functions as F

from placerank.operators import resolve, social
from placerank.plans.store import read_registry
from placerank.streaming import incremental


def sources(spark):
    return spark.createDataFrame([("sethlui", True)], "source_key string, independent boolean")


def test_stream_equals_batch(spark, tmp_path):
    first = [sighting("sethlui", "Cafe Alpha", postal_code="160056"), sighting("burpple", "Two Chefs", postal_code="140116")]
    second = [sighting("eatbook", "Cafe Alpha", postal_code="160056"), sighting("eatbook", "Luna Rooftop", postal_code="018956")]
    runs = [sightings(spark, first, "20260901T000000Z"), sightings(spark, second, "20260908T000000Z")]
    landing = str(tmp_path / "in")
    for i, run in enumerate(runs):
        run.coalesce(1).write.mode("append").parquet(landing)
        query = incremental.stream_resolve(
            spark.readStream.schema(run.schema).parquet(landing), str(tmp_path / "reg"), str(tmp_path / "ck"), sources(spark)
        )
        query.awaitTermination()
        assert query.exception() is None, i
    registry, next_id = read_registry(spark, str(tmp_path / "reg"))
    stored = {r.venue_id: (r.name, r.first_seen_run, r.last_seen_run) for r in registry.venues.collect()}
    batch = resolve.resolve(runs[0].unionByName(runs[1]))
    assert next_id == batch.next_id == 4
    assert stored == {
        "v00001": ("Cafe Alpha", "20260901T000000Z", "20260908T000000Z"),
        "v00002": ("Two Chefs", "20260901T000000Z", "20260901T000000Z"),
        "v00003": ("Luna Rooftop", "20260908T000000Z", "20260908T000000Z"),
    }
    # the same batch again changes nothing
    incremental.resolve_batch(runs[1], str(tmp_path / "reg"), "b0000000001", sources(spark))
    assert read_registry(spark, str(tmp_path / "reg"))[1] == 4


def landed(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_rolling_cap_stream_equals_batch(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("a"), F.col("user_id") % 3).alias("account"), F.col("event_id").alias("request_id"),
        F.concat("event_type", F.col("event_id") % 7).alias("tag"), F.col("ts").cast("timestamp").alias("at"),
    )
    want = social.capped_tags(rows, cap=10, days=3).select("request_id", "outcome")
    got = drain(incremental.rolling_cap_stream(landed(spark, tmp_path, rows, "cap"), cap=10, days=3), "cap")
    key = lambda df: sorted((r.request_id, r.outcome) for r in df.select("request_id", "outcome").collect())
    assert key(got) == key(want)
    assert {o for _, o in key(got)} == {"accepted", "repeat", "rejected"}


def test_one_account_over_many_ranges_equals_a_single_fold(spark):
    """One busy account, a few quiet ones, one without a name; ranges much shorter than the days a tag stays live."""
    import random

    import pandas as pd

    from placerank.streaming.caps import decide

    rnd = random.Random(8)
    day = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(1500):
        who = "busy" if i % 10 else rnd.choice(["a", "b", None])
        rows.append((who, i, f"t{rnd.randrange(40)}", (day + pd.Timedelta(minutes=rnd.randrange(60 * 24 * 20))).to_pydatetime()))
    df = spark.createDataFrame(rows, "account string, request_id long, tag string, at timestamp")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {r.request_id: r.outcome for r in social.capped_tags(df, cap=6, days=3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    live, want = {}, {}
    for who, i, tag, at in sorted(rows, key=lambda r: (r[3], r[1])):
        want[i] = decide(live.setdefault(who, {}), tag, pd.Timestamp(at), 6, 3)
    assert got == want and set(want.values()) == {"accepted", "repeat", "rejected"}
    assert social.capped_tags(df.limit(0)).count() == 0


def test_daily_buzz_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = events.select(F.concat(F.lit("m"), "user_id").alias("venue_id"), F.concat(F.lit("u"), "event_id").alias("key"), F.col("ts").cast("timestamp").alias("posted_at"))
    daily = drain(incremental.daily_mentions(landed(spark, tmp_path, m, "buzz")), "daily", "complete")
    got = {r.venue_id: (r.mentions_window, round(r.score, 9)) for r in incremental.buzz_from_daily(daily, "2024-02-01").collect()}
    batch = social.buzz_scores(m.select("venue_id", F.col("key").alias("url"), F.to_date("posted_at").cast("string").alias("post_date"), F.lit(1).alias("arrival")), "2024-02-01")
    assert got == {r.venue_id: (r.mentions_window, round(r.score, 9)) for r in batch.collect()}
    once = drain(incremental.first_mentions(landed(spark, tmp_path, m.union(m), "dup")), "once")
    assert once.count() == m.count()


def test_checkpoint_dir_comes_from_the_session(spark):
    from placerank.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    assert os.path.basename(spark.sparkContext.getCheckpointDir() or "")


def test_upsert_store_equals_a_fold_of_the_batches(spark, tmp_path):
    """Seven batches over a base every third, replays of an old and of the last batch, a batch without keys."""
    import random
    import shutil

    from placerank.streaming import mention_store as store

    rng, root, want, batches = random.Random(4), str(tmp_path / "store"), {}, []
    schema = "key string, venue_id string, matched_by string, caption string"
    for n in range(7):
        rows = [(f"k{k}", rng.choice([None, "v1", "v2"]), rng.choice(["handle", "caption"]), rng.choice([None, "", f"c{n}"])) for k in rng.sample(range(30), 8)]
        batches.append([(None, "v1", "handle", "lost")] if n == 5 else rows)
    for rows in batches:
        for key, venue, how, caption in rows:
            if key is None:
                continue
            old = want.get(key)
            if old is None or (venue and (old[0], old[1]) != (venue, how)) or (not old[2] and caption):
                want[key] = (venue, how, caption)
    for n, rows in enumerate(batches):
        store.upsert_batch(spark.createDataFrame(rows, schema), root, n, buckets=4, compact_every=3)
    read = lambda: {r.key: tuple(r)[1:] for r in store.read_mentions(spark, root, spark.createDataFrame([], schema).schema).collect()}
    assert read() == want and len(want) > 20
    for n in (6, 2, 4):
        store.upsert_batch(spark.createDataFrame(batches[n], schema), root, n, buckets=4, compact_every=3)
    assert read() == want
    # a batch touches the buckets of its keys only
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    before = files()
    store.upsert_batch(spark.createDataFrame([("fresh", "v1", "handle", "c")], schema), root, 7, buckets=4, compact_every=3)
    made = files() - before
    assert len({f for f in made if "/deltas/batch=7/bucket=" in f}) == 1 and len(made) == 2
    # deltas that a base has taken in are no longer read
    shutil.rmtree(os.path.join(root, "deltas", "batch=0"))
    assert read() == want | {"fresh": ("v1", "handle", "c")}


def test_stream_upsert_drains_into_the_store(spark, tmp_path):
    from placerank.streaming import mention_store as store

    schema = "key string, venue_id string, matched_by string, caption string"
    landing, root = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([("a", None, "unmatched", ""), ("b", "v1", "handle", "x")], [("a", "v2", "caption", "now"), ("b", None, "unmatched", "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        query = store.stream_upsert(spark.readStream.schema(schema).parquet(landing), root, str(tmp_path / "ck"))
        query.awaitTermination()
        assert query.exception() is None
    got = store.read_mentions(spark, root, spark.createDataFrame([], schema).schema)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "v2", "caption", "now"), ("b", "v1", "handle", "x")]


def test_requests_decided_at_once_equal_those_decided_one_by_one():
    """The live tags are looked through when one may have run out, not for every request; a missing time never runs out."""
    import random

    import pandas as pd

    from placerank.streaming.caps import decide, decide_all

    rng = random.Random(4)
    for days, step in ((1, 3), (3, 1), (3, 40), (0, 0)):
        times = [pd.NaT] * 2 + sorted(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=rng.randrange(1 + 400 * step // 10)) for _ in range(400))
        tags = [f"t{rng.randrange(12)}" for _ in times]
        for cap in (0, 1, 5, 20):
            slow, quick = {}, {}
            want = [decide(slow, tag, at, cap, days) for tag, at in zip(tags, times, strict=True)]
            assert decide_all(quick, tags[:150], [t.value for t in times[:150]], cap, days) + decide_all(quick, tags[150:], [t.value for t in times[150:]], cap, days) == want
            assert quick == {t: s.value for t, s in slow.items()}

"""Continuously arriving runs: the batch operators behind Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placerank.operators.merge import build_registry
from placerank.operators.resolve import known_keys, resolve
from placerank.params import BuzzParams, ScoringParams
from placerank.plans.store import read_registry, write_registry
from placerank.session import materialise
from placerank.streaming.caps import decide
from placerank.streaming.mention_store import exists


def resolve_batch(
    batch: DataFrame, root: str, version: str, sources: DataFrame, params: ScoringParams | None = None
) -> None:
    """Resolve one batch against the current registry and publish the next version.

    Running the same version twice changes nothing: its pointer row is the last thing written."""
    spark = batch.sparkSession
    known, next_id, past = None, 1, None
    if exists(spark, f"{root}/versions"):
        published = spark.read.parquet(f"{root}/versions").where(F.col("version") == version)
        if not published.isEmpty():
            return
        registry, next_id = read_registry(spark, root)
        known = known_keys(registry.venues, registry.names)
        # a retry of this version may have left its own rows behind
        past = spark.read.parquet(f"{root}/assigned").where(F.col("version") < version).drop("version")
    done = resolve(batch, known, next_id, params)
    assigned = materialise(done.assignments)
    assigned.withColumn("version", F.lit(version)).write.partitionBy("version").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(f"{root}/assigned")
    if past is None:
        fresh = build_registry(assigned, sources)
    else:
        # only venues seen in this batch are folded again; the others are carried over
        touched = assigned.select("venue_id").distinct()
        again = build_registry(
            past.join(touched, "venue_id", "left_semi").unionByName(assigned, allowMissingColumns=True), sources
        )
        keep = lambda old, new: old.join(touched, "venue_id", "left_anti").unionByName(new)
        fresh = type(registry)(
            keep(registry.venues, again.venues), keep(registry.names, again.names),
            keep(registry.evidence, again.evidence), keep(registry.reviews, again.reviews),
        )
    write_registry(fresh, root, version, done.next_id)


def stream_resolve(
    sightings: DataFrame, root: str, checkpoint: str, sources: DataFrame, params: ScoringParams | None = None
) -> StreamingQuery:
    """Incremental resolution of a sightings stream; drains what has arrived, then stops."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            resolve_batch(batch, root, f"b{batch_id:010d}", sources, params)

    return (
        sightings.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_mentions(mentions: DataFrame, watermark: str = "7 days") -> DataFrame:
    """First arrival of every mention key; repeats within the watermark are dropped.

    ``mentions``: key, posted_at (timestamp)."""
    return mentions.withWatermark("posted_at", watermark).dropDuplicatesWithinWatermark(["key"])


def daily_mentions(mentions: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Mentions per venue and day; later ones than the watermark are dropped."""
    return (
        mentions.withWatermark("posted_at", watermark)
        .groupBy("venue_id", F.window("posted_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("mentions"))
        .select("venue_id", F.to_date("window.start").alias("day"), "mentions")
    )


def buzz_from_daily(daily: DataFrame, today: str, params: BuzzParams | None = None) -> DataFrame:
    """Decayed buzz from stored day counts, as of any day."""
    p = params or BuzzParams()
    now = F.lit(today).cast("date")
    rows = daily.where(F.col("day") >= F.date_sub(now, p.window_days))
    weight = F.pow(F.lit(0.5), F.date_diff(now, "day").cast("double") / F.lit(float(p.half_life_days)))
    raw = rows.groupBy("venue_id").agg(
        F.sum("mentions").alias("mentions_window"), F.sum(weight * F.col("mentions")).alias("raw"), F.max("day").alias("latest")
    )
    top = raw.agg(F.max("raw").alias("top")).scalar()
    return raw.select(
        "venue_id", "mentions_window", "raw", (F.col("raw") / top).alias("score"),
        (F.col("mentions_window") >= p.trending_threshold).alias("trending"), "latest",
    )


def rolling_cap_stream(requests: DataFrame, cap: int = 25, days: int = 7, by: str = "account", watermark: str = "1 hour") -> DataFrame:
    """Rolling distinct cap on a stream; the state of an account is at most ``cap`` tags.

    Requests older than the watermark come out as ``late`` and change nothing.  An account silent for
    ``days`` loses its state."""
    kind = requests.schema[by].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = {t: pd.Timestamp(s) for t, s in json.loads(state.get[0]).items()} if state.exists else {}
        seen = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])  # one micro-batch of one account
        out = []
        for tag, at in zip(rows["tag"], rows["at"], strict=True):
            out.append("late" if at < seen else decide(live, tag, at, cap, days))
        state.update((json.dumps({t: str(s) for t, s in live.items()}),))
        newest = max([seen, *live.values()])
        state.setTimeoutTimestamp(int((newest + pd.Timedelta(days=days)).timestamp() * 1000) + 1)
        yield rows.assign(outcome=out)[[by, "request_id", "tag", "at", "outcome"]]

    return (
        requests.select(by, "request_id", "tag", "at")
        .withWatermark("at", watermark)
        .groupBy(by)
        .applyInPandasWithState(
            step, f"{by} {kind}, request_id long, tag string, at timestamp, outcome string", "live string", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )

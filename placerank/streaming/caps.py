"""The rolling distinct cap as a fold over time-ordered requests, in parallel over ranges of a timeline."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.session import materialise

#: Tags in use with the time of their last accepted request: at most ``cap`` of them.
Live = dict[str, pd.Timestamp]


def decide(live: Live, tag: str, at: pd.Timestamp, cap: int, days: int) -> str:
    """Decide one request and update ``live`` (tag -> last accepted use) in place."""
    horizon = at - pd.Timedelta(days=days)
    for old in [t for t, seen in live.items() if seen < horizon]:
        del live[old]
    if tag in live:
        outcome = "repeat"
    elif len(live) < cap:
        outcome = "accepted"
    else:
        return "rejected"
    live[tag] = at
    return outcome


#: A missing time among the nanoseconds of a timeline; it never runs out.
_NEVER = pd.NaT.value


def decide_all(live: dict[str, int], tags: Sequence[str], times: Sequence[int], cap: int, days: int) -> list[str]:
    """`decide` for requests in time order, on nanoseconds.

    The live tags are looked through only when the oldest use known of may have run out, not for every request."""
    span, outcomes = days * 86_400_000_000_000, []

    def oldest() -> int | None:
        return min((seen for seen in live.values() if seen != _NEVER), default=None)

    soonest = oldest()
    for tag, at in zip(tags, times, strict=True):
        if at != _NEVER and soonest is not None and soonest < at - span:
            for old in [t for t, seen in live.items() if seen != _NEVER and seen < at - span]:
                del live[old]
            soonest = oldest()
        if tag in live:
            outcomes.append("repeat")
        elif len(live) < cap:
            outcomes.append("accepted")
        else:
            outcomes.append("rejected")
            continue
        live[tag] = at
        if at != _NEVER and (soonest is None or at < soonest):
            soonest = at
    return outcomes


def _fold(incoming: dict[int, str], cap: int, days: int, borders: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """mapInPandas function over the ranges of a timeline, each sorted by account and time.

    The first account of a range goes on with ``incoming[range]``.  With ``borders`` a range returns one row: its first and last
    account and what is live at its end; else every row comes back with its outcome."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, account, live, chunk = None, None, {}, None
        for rows in batches:
            if not len(rows):
                continue
            outcomes: list[str] = []
            who, tags = rows["_who"].to_numpy(), rows["tag"].tolist()
            times = rows["at"].astype("datetime64[ns]").astype("int64").tolist()
            if chunk is None:
                chunk, first = int(rows["_chunk"].iloc[0]), who[0]
                account, live = first, json.loads(incoming.get(chunk) or "{}")
            starts = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)]
            for start, end in zip(starts, starts[1:], strict=False):
                if who[start] != account:
                    account, live = who[start], {}
                outcomes += decide_all(live, tags[start:end], times[start:end], cap, days)
            if not borders:
                yield rows.assign(outcome=outcomes)
        if borders and chunk is not None:
            yield pd.DataFrame([(chunk, first, account, json.dumps(live, sort_keys=True))], columns=["chunk", "first", "last", "live"])

    return fold


def fold_ranges(requests: DataFrame, by: str, order: list[str], cap: int, days: int) -> DataFrame:
    """``requests`` (by, tag, at, order...) with ``outcome``.

    The rows are dealt into ranges of (account, order), so one account may fill many tasks.  Every range is folded as if nothing
    were live before it; then what is live at its end is carried into the next range of the same account, and the ranges whose
    start has changed are folded again, until nothing changes.  The first range of an account is right at once and every
    round makes one more right at least; as uses expire, two or three rounds are usual.  What crosses a border, and what
    reaches the driver, is one row of at most ``cap`` tags for each range."""
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = requests.withColumn("_who", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    ranged = keyed.repartitionByRange(parts, "_who", *order).sortWithinPartitions("_who", *order)
    rows = materialise(ranged.withColumn("_chunk", F.spark_partition_id()))
    slim = rows.select("_who", "_chunk", "tag", "at")
    ends: dict[int, tuple[str, str, str]] = {}
    incoming: dict[int, str] = {}
    stale = slim
    while True:
        found = stale.mapInPandas(_fold(incoming, cap, days, True), "chunk int, first string, last string, live string").collect()
        ends |= {r.chunk: (r.first, r.last, r.live) for r in found}
        before, changed = None, []
        for chunk in sorted(ends):
            first, last, live = ends[chunk]
            start = before[1] if before and before[0] == first else "{}"
            if start != incoming.get(chunk, "{}"):
                incoming[chunk] = start
                changed.append(chunk)
            before = (last, live)
        if not changed:
            break
        stale = slim.where(F.col("_chunk").isin(changed))
    schema = rows.select(*requests.columns).schema.add("outcome", "string")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    extra = "_who string, _chunk int"
    done = rows.select(*requests.columns, "_who", "_chunk").mapInPandas(_fold(incoming, cap, days, False), plain.replace(", `outcome` string", f", {extra}, `outcome` string"))
    return done.drop("_who", "_chunk")

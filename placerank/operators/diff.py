"""Run-to-run changes as joins between two scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def top_list(scores: DataFrame, n: int) -> DataFrame:
    """(category_key, venue_id, rank) of the first n ranked, non-excluded venues per category."""
    ok = F.col("rank").between(1, n)
    if "excluded_reason" in scores.columns:
        ok = ok & F.col("excluded_reason").isNull()
    return scores.where(ok).select("category_key", "venue_id", "rank")


def previous_run(runs: DataFrame, run_id: str) -> DataFrame:
    """(run_id) of the latest completed, scored run before this one; empty when there is none."""
    done = runs.where(F.col("status").isin("ok", "partial") & F.col("scored") & (F.col("run_id") < run_id))
    return done.agg(F.max("run_id").alias("run_id")).where("run_id is not null")


def list_churn(current: DataFrame, previous: DataFrame, n: int) -> DataFrame:
    """Entered and left venues per category that exists now.

    Returns category_key, venue_id, change, rank, prev_rank."""
    live = current.select("category_key").distinct()
    now = top_list(current, n)
    before = top_list(previous, n).join(live, "category_key", "left_semi").withColumnRenamed("rank", "prev_rank")
    both = now.join(before, ["category_key", "venue_id"], "full_outer")
    return both.where("rank is null or prev_rank is null").select(
        "category_key", "venue_id", F.when(F.col("prev_rank").isNull(), "entered").otherwise("left").alias("change"),
        "rank", "prev_rank",
    )


def rank_moves(current: DataFrame, previous: DataFrame, n: int) -> DataFrame:
    """Every top-list change, moves included, for categories the current run scored."""
    live = current.select("category_key").distinct()
    now = top_list(current, n)
    before = top_list(previous, n).join(live, "category_key", "left_semi").withColumnRenamed("rank", "prev_rank")
    both = now.join(before, ["category_key", "venue_id"], "full_outer")
    change = (
        F.when(F.col("prev_rank").isNull(), "entered")
        .when(F.col("rank").isNull(), "left")
        .when(F.col("rank") < F.col("prev_rank"), "moved up")
        .when(F.col("rank") > F.col("prev_rank"), "moved down")
    )
    return both.withColumn("change", change).where("change is not null").select(
        "category_key", "venue_id", "change", "rank", "prev_rank"
    )


def baseline(history: DataFrame, run_id: str) -> DataFrame:
    """Last state of every venue before this run (not only from the directly preceding run)."""
    rest = [c for c in history.columns if c != "venue_id"]
    earlier = history.where(F.col("run_id") < run_id)
    picked = earlier.groupBy("venue_id").agg(F.max_by(F.struct(*rest), "run_id").alias("r"))
    return picked.select("venue_id", *[F.col("r")[c].alias(c) for c in rest]).select(*history.columns)


def rating_changes(current: DataFrame, before: DataFrame, threshold: float = 0.2) -> DataFrame:
    """venue_id, from, to, delta where the main rating moved by at least the threshold."""
    joined = current.select("venue_id", F.col("rating").alias("to")).join(
        before.select("venue_id", F.col("rating").alias("from")), "venue_id"
    )
    delta = F.col("to") - F.col("from")
    return joined.where(F.abs(delta) >= threshold).select(
        "venue_id", "from", "to", F.round(delta, 2).alias("delta")
    )


def status_changes(current: DataFrame, before: DataFrame) -> DataFrame:
    """venue_id, change (closed / reopened), status."""
    joined = current.select("venue_id", F.col("business_status").alias("status")).join(
        before.select("venue_id", F.col("business_status").alias("_was")), "venue_id"
    )
    was = F.coalesce(F.col("_was").startswith("CLOSED"), F.lit(False))
    now = F.coalesce(F.col("status").startswith("CLOSED"), F.lit(False))
    change = F.when(now & ~was, "closed").when(was & (F.col("status") == "OPERATIONAL"), "reopened")
    return joined.withColumn("change", change).where("change is not null").select("venue_id", "change", "status")


def new_sources(current: DataFrame, before: DataFrame) -> DataFrame:
    """venue_id, sources: evidence sources a known venue did not have before.

    Both sides: venue_id, source_key (any number of rows)."""
    known = before.select("venue_id").distinct()
    fresh = (
        current.select("venue_id", "source_key")
        .join(known, "venue_id", "left_semi")
        .join(before.select("venue_id", "source_key"), ["venue_id", "source_key"], "left_anti")
    )
    return fresh.groupBy("venue_id").agg(F.array_sort(F.collect_set("source_key")).alias("sources"))


def new_venues(venues: DataFrame, evidence_categories: DataFrame, run_id: str) -> DataFrame:
    """Venues first seen in this run with the categories that found them."""
    fresh = venues.where(F.col("first_seen_run") == run_id)
    found = (
        evidence_categories.where("category_key <> '*'")
        .groupBy("venue_id")
        .agg(F.array_sort(F.collect_set("category_key")).alias("categories"))
    )
    return fresh.join(found, "venue_id", "left").select(
        "venue_id", "name", "region", F.coalesce("categories", F.array().cast("array<string>")).alias("categories")
    )


def new_mentions(mentions: DataFrame, run_id: str) -> DataFrame:
    return mentions.where(F.col("run_id") == run_id).select(
        "url", "platform", "venue_id", "creator_handle", "post_date"
    )


def change_table(parts: dict[str, DataFrame]) -> DataFrame:
    """All changes of a run as one long table (kind, venue_id, category_key, payload JSON)."""
    rows = None
    for kind, df in parts.items():
        rest = [c for c in df.columns if c not in ("venue_id", "category_key")]
        category = F.col("category_key") if "category_key" in df.columns else F.lit(None).cast("string")
        part = df.select(
            F.lit(kind).alias("kind"), "venue_id", category.alias("category_key"),
            F.to_json(F.struct(*rest)).alias("payload"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def change_feed(churn: DataFrame, previous_scores: DataFrame, fresh: DataFrame, limit: int = 12) -> DataFrame:
    """Entered rows of lists the previous run had too, then new venues, each venue once."""
    known = previous_scores.select("category_key").distinct()
    entered = churn.where("change = 'entered'").join(known, "category_key", "left_semi")
    rows = entered.select(
        "venue_id", F.struct(F.lit(0).alias("part"), "category_key", "rank").alias("at")
    ).union(
        fresh.select(
            "venue_id", F.struct(F.lit(1).alias("part"), F.col("venue_id").alias("category_key"), F.lit(0).alias("rank"))
        )
    )
    once = rows.groupBy("venue_id").agg(F.min("at").alias("at"))
    return once.orderBy("at").limit(limit).select(
        "venue_id", F.when(F.col("at.part") == 0, F.col("at.category_key")).alias("category_key"),
        F.when(F.col("at.part") == 0, F.col("at.rank")).alias("rank"),
    )


def ranks_key(pairs: Column) -> Column:
    """"#2 · A; #9 · B" from an array of (rank, label); "new" without any."""
    parts = F.transform(F.array_sort(pairs), lambda p: F.format_string("#%d · %s", p["rank"], p["label"]))
    return F.when(F.size(pairs) > 0, F.array_join(parts, "; ")).otherwise("new")


def cards(
    current: DataFrame, previous: DataFrame, labels: DataFrame, fresh: DataFrame, n: int, top: int = 3
) -> DataFrame:
    """One card per venue that is newly in a top ``top``, entered a top list, or is new.

    ``labels``: category_key, label, digest_only; ``fresh``: venue_id.  A venue can hold at most one
    rank per category, so the array of ranks is bounded by the configuration."""
    shown = labels.where(~F.col("digest_only")).select("category_key", "label")
    visible = current.where(~F.col("hidden")) if "hidden" in current.columns else current
    keys = ["category_key", "venue_id"]
    newly_top = top_list(visible, top).join(top_list(previous, top), keys, "left_anti")
    entered = list_churn(current, previous, n).where("change = 'entered'").select(*keys, "rank")
    ranked = newly_top.union(entered).distinct().join(F.broadcast(shown), "category_key")  # configuration
    pairs = ranked.groupBy("venue_id").agg(F.collect_set(F.struct("rank", "label")).alias("pairs"))
    starts_new = ranked.where(F.col("category_key").startswith("new_")).select("venue_id")
    flagged = fresh.select("venue_id").union(starts_new).distinct().withColumn("is_new", F.lit(True))
    out = pairs.join(flagged, "venue_id", "full_outer")
    pairs_or_none = F.coalesce("pairs", F.array().cast("array<struct<rank:int,label:string>>"))
    return out.select(
        "venue_id",
        ranks_key(pairs_or_none).alias("ranks"),
        F.coalesce(F.array_min("pairs")["rank"], F.lit(99)).alias("best_rank"),
        F.size(pairs_or_none).alias("lists"),
        F.coalesce("is_new", F.lit(False)).alias("is_new"),
    )


def unsent(card_rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Cards whose ranks differ from those the venue's last card was sent at.

    ``sent``: venue_id, ranks, sent_at."""
    last = sent.groupBy("venue_id").agg(F.max_by("ranks", "sent_at").alias("ranks"))
    return card_rows.join(last, ["venue_id", "ranks"], "left_anti")


def upsert_state(stored: DataFrame, answered: DataFrame) -> DataFrame:
    """Checked dates: answered names take the new date, the others keep theirs."""
    new = answered.select("name", F.col("checked").alias("_new")).distinct()
    return stored.join(new, "name", "full_outer").select("name", F.coalesce("_new", "checked").alias("checked"))


def is_new_venue(first_seen: Column, run_at: Column, bootstrap: str, in_new_list: Column, days: int = 14) -> Column:
    """In a new-openings list, or first seen lately and not in the very first run."""
    from placerank.functions.geo import run_time

    seen = run_time(first_seen)
    recent = (F.unix_timestamp(run_at) - F.unix_timestamp(seen)) <= days * 86400
    return in_new_list | F.coalesce(recent & (first_seen != bootstrap), F.lit(False))



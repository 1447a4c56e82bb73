"""Entity resolution: sightings -> canonical venues with stable ids.

The rule is "first match wins" along the ingest order (confidence descending, the main API first):
a sighting joins the venue of the earliest sighting it shares a key with, strongest key first, and
otherwise starts a venue of its own.  Instead of replaying the rows one by one, every key group is
reduced to its first member by an aggregate, each sighting points at the first member of its best
group, and pointers are followed to their roots.  No step pairs up the members of a group and none
gathers a group in one task, so a key shared by a third of the rows costs one partial aggregate.

Tiers: place_id > name_postal > phone > booking_link > name_exact > fuzzy_name.
A name without postal code belongs to the earliest postal code seen with that name.

Differences from replaying rows one at a time, all deliberate: every sighting's phone and booking
link counts, not only the ones its venue kept; a key claimed by two venues belongs to the one that
had it first; the postal code a venue ends up with is used for fuzzy compatibility.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placerank.functions.base import truthy
from placerank.functions.names import name_key
from placerank.functions.similarity import token_set_ratio_udf
from placerank.operators.blocking import candidates
from placerank.operators.joins import lookup
from placerank.operators.ordered import row_numbers
from placerank.params import ScoringParams
from placerank.session import materialise, settle, store

GOOGLE = ("google_places", "google_reserve")
METHODS = ("place_id", "name_postal", "phone", "booking_link", "name_exact", "fuzzy_name")
_KEYS = ("place_id", "name_key", "postal", "phone", "booking")


def with_ingest_order(sightings: DataFrame) -> DataFrame:
    """Add ``ord``, a comparable struct: run, confidence descending, main source first, position."""
    return sightings.withColumn(
        "ord",
        F.struct(
            F.coalesce("run_id", F.lit("")).alias("run"),
            (-F.coalesce("confidence", F.lit(1.0))).alias("rank"),
            (F.col("source_key") != "google_places").cast("int").alias("main"),
            F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
            F.xxhash64("source_key", "name", "source_ref", "page_url", "query", "category_key").alias("tie"),
        ),
    )


def match_keys(sightings: DataFrame) -> DataFrame:
    """Add the key columns the tiers compare and whether the row may create a venue."""
    return _plain_keys(sightings.withColumn("name_key", name_key(F.col("name"))))


def _plain_keys(sightings: DataFrame) -> DataFrame:
    """The keys that are read off a column; made again for every reader rather than stored."""
    strong = F.col("source_key").isin(*GOOGLE)
    enrich_only = F.coalesce(F.col("extra.enrich_only"), F.lit(False))
    low = F.coalesce("confidence", F.lit(1.0)) <= 0.5
    return sightings.withColumns(
        {
            "place_id": F.when(strong, truthy(F.col("source_ref"))),
            "postal": truthy(F.col("postal_code")),
            "booking": truthy(F.col("booking_url")),
            "creator": ~(low | enrich_only),
            "catalogue": enrich_only,
        }
    ).withColumn("phone", truthy(F.col("phone")))


def _digest() -> Column:
    """128 bits that stand for a node's keys where sightings meet it; made where it is needed, stored nowhere."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in _KEYS]
    parts += [F.col("creator").cast("string"), F.col("catalogue").cast("string")]
    return F.unhex(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32))


@dataclass(frozen=True)
class Resolution:
    """assignments: one row per sighting (venue_id null = skipped); created: new venue ids."""

    assignments: DataFrame
    created: DataFrame
    next_id: int


# --- nodes: sightings with the same keys always share their fate ----------------------------------
def _nodes(keyed: DataFrame) -> DataFrame:
    """One row for equal keys, with its first sighting's ord, row number and name."""
    lead = F.min(F.struct("ord", F.col("_row").alias("lead"), "name")).alias("_lead")
    nodes = keyed.groupBy(*_KEYS, "creator", "catalogue").agg(lead)
    return nodes.select(*_KEYS, "creator", "catalogue", "_lead.*", F.lit(None).cast("string").alias("venue_id"))


def _known_nodes(known: DataFrame) -> DataFrame:
    """Stored venues take part as nodes that come before every sighting.

    ``known``: venue_id, name_key (null for venues listed by another key only), postal, place_id,
    phone, booking, created (position in which the venue was created)."""
    zero = F.struct(
        F.lit("").alias("run"),
        F.lit(float("-inf")).alias("rank"),
        F.lit(0).alias("main"),
        F.col("created").cast("long").alias("seq"),
        F.xxhash64(*_KEYS).alias("tie"),
    )
    return known.select(
        *_KEYS,
        F.lit(True).alias("creator"),
        F.lit(False).alias("catalogue"),
        zero.alias("ord"),
        F.lit(None).cast("long").alias("lead"),
        F.col("name_key").alias("name"),
        "venue_id",
    )


def _numbered(nodes: DataFrame) -> DataFrame:
    """The nodes with a number ``node`` that ascends in ingest order, in place of ``ord``.

    Eight bytes stand for a node and its place in the order in all that follows.  Nodes of one ord are put in order by their keys."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc() for c in ("ord", "venue_id", *_KEYS, "creator", "catalogue")]
    rows = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return settle(rows.withColumn("node", F.monotonically_increasing_id()).drop("ord"))


#: Kinds of exact keys; a name with the node's own postal code is a stronger key than one with the postal code of its home.
_PLACE, _NAME, _PHONE, _BOOKING = 1, 2, 3, 4
_NAME_EXACT = 5


def _held(nodes: DataFrame, *kinds: tuple[int, Column]) -> DataFrame:
    """(the other columns, kind, key): one row for every key that is there; missing keys make no rows."""
    held = [F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key"))) for kind, key in kinds]
    rest = [c for c in nodes.columns if c not in _KEYS]
    return nodes.select(*rest, F.explode(F.array_compact(F.array(*held))).alias("k")).select(*rest, "k.kind", "k.key")


def _exact_parents(nodes: DataFrame) -> DataFrame:
    """(node, parent, tier) of each node that has one: its earliest predecessor through its best exact tier.

    One aggregate finds the first holder of every key, one lookup brings it back to the holders, one aggregate keeps the best
    tier.  The first holder with a postal code of its own is kept beside the first one: one row per name serves both tiers."""
    named = nodes.where("name_key is not null")
    homeless = F.col("postal").isNull()
    home = named.groupBy("name_key").agg(
        F.min(F.when(~homeless, F.struct("node", "postal"))).alias("_f"), F.count(F.when(homeless, 1)).alias("_n")
    )
    home = materialise(home.where("_n > 0").select("name_key", F.col("_f.postal").alias("_home"), "_n"))
    fresh = F.col("venue_id").isNull().alias("fresh")
    homes = lookup(named.where(homeless).select("node", fresh, "name_key"), home, ["name_key"], "_n")
    # the separator keeps "no postal anywhere" apart from a postal code
    place = F.concat_ws("\u0001", "name_key", F.coalesce("_home", F.lit("none")))
    homes = materialise(homes.select("node", "fresh", F.lit(False).alias("own"), F.lit(_NAME).alias("kind"), place.alias("key")))
    own = F.when(F.col("name_key").isNotNull() & F.col("postal").isNotNull(), F.concat_ws("\u0001", "name_key", "postal"))
    held = _held(
        nodes.select("node", fresh, F.lit(True).alias("own"), *_KEYS),
        (_PLACE, F.col("place_id")), (_NAME, own), (_PHONE, F.col("phone")), (_BOOKING, F.col("booking")),
    ).union(homes)
    firsts = held.groupBy("kind", "key").agg(
        F.min("node").alias("_first"), F.min(F.when(F.col("own"), F.col("node"))).alias("_own"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1")
    met = lookup(held.where("fresh"), materialise(firsts), ["kind", "key"], "_n")
    weak = F.when((F.col("kind") == _NAME), F.lit(_NAME_EXACT)).otherwise(F.col("kind"))
    link = F.when(F.col("own") & (F.col("_own") < F.col("node")), F.struct(F.col("kind").alias("tier"), F.col("_own").alias("parent")))
    link = link.when(F.col("_first") < F.col("node"), F.struct(weak.alias("tier"), F.col("_first").alias("parent")))
    best = met.select("node", link.alias("_l")).where("_l is not null").groupBy("node").agg(F.min("_l").alias("_b"))
    return best.select("node", "_b.parent", "_b.tier")


def follow_pointers(pointers: DataFrame) -> DataFrame:
    """(node, parent, ...) of nodes that have a parent -> (node, root, ...) by pointer doubling: the depth halves every round.

    A parent always precedes its child, so there are no cycles; a parent that is no node here is a root."""
    rest = [c for c in pointers.columns if c not in ("node", "parent")]
    state = settle(pointers.select("node", F.col("parent").alias("root"), *rest))
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = state.join(up, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root"), *rest, F.col("_next").isNotNull().alias("_m")
        )
        moved = settle(moved)
        if moved.where("_m").isEmpty():
            return moved.select("node", "root", *rest)
        state = moved.select("node", "root", *rest)


def _claims(index: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``f`` (entity_ord, since, entity): what a lookup at any time needs to find the earliest entity of a key.

    An entity counts from its ``since`` on, so an older entity that took the key late does not hide a younger one that
    had it before.  Only entities known before all older ones of the key can ever win: beside the oldest itself, those
    with a smaller ``since`` than it, thinned by a running minimum."""
    oldest = index.groupBy(*keys).agg(F.min(F.struct("entity_ord", "since", "entity")).alias("f"))
    rivals = index.join(oldest, keys).where(F.col("since") < F.col("f.since"))
    rivals = rivals.groupBy(*keys, "entity_ord", "entity").agg(F.min("since").alias("since"))
    rivals = _thinned(rivals, keys, ["entity_ord", "since"])
    return oldest.union(rivals.select(*keys, F.struct("entity_ord", "since", "entity").alias("f")))


def _thinned(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows known before all that ``order`` puts before them; the others never win a lookup, whenever it is.

    A row beaten in a part of its key is beaten in all of it: a crowded key is thinned in many small parts first."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("entity"), F.lit(4096)))
    for by in ([*keys, "_part"], keys):
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_best", F.min("since").over(before)).where(F.col("_best").isNull() | (F.col("since") < F.col("_best")))
    return rows.drop("_part", "_best")


def _options(pairs: DataFrame, claims: DataFrame, at: list[str], by: list[str]) -> DataFrame:
    """by, score and ``f``: the entities that can win for a text, before any query meets them."""
    met = pairs.join(claims, at).select(*by, "score", "f.*", (-F.col("score")).alias("_worse"))
    kept = _thinned(met, by, ["_worse", "entity_ord", "since"])
    return kept.select(*by, "score", F.struct("entity_ord", "since", "entity").alias("f"))


def fuzzy_matches(
    queries: DataFrame, index: DataFrame, threshold: float, catalogue_threshold: float
) -> DataFrame:
    """Best fuzzy venue per query.

    ``queries``: query_id, name_key, postal, ord, catalogue;  ``index``: entity, name_key, postal,
    since (the entity counts for later queries only), entity_ord (earliest entity wins ties).
    Postal codes must be equal or missing on one side.  What can win is decided once for every text, and for every text and
    postal code, so the similar names do not multiply the queries."""
    q = queries.select("query_id", F.col("name_key").alias("left_text"), F.col("postal").alias("zone"), "ord", "catalogue")
    e = index.select("entity", F.col("name_key").alias("right_text"), F.col("postal").alias("zone"), "since", "entity_ord")
    found = candidates(
        q.where("left_text <> ''").select(F.col("left_text").alias("text"), "zone"),
        e.where("right_text <> ''").select(F.col("right_text").alias("text"), "zone"),
    )
    scored = settle(
        found.pairs.withColumn("score", token_set_ratio_udf("left_text", "right_text")).where(
            F.col("score") >= threshold
        )
    )
    # names -> entities: reduce to those that can win for a (name, postal) before meeting the queries
    placed = _claims(e.where("zone is not null"), ["right_text", "zone"])
    homeless = _claims(e.where("zone is null"), ["right_text"])
    anywhere = _claims(e, ["right_text"])
    options = [
        # same postal code
        (q.where("zone is not null"), ["left_text", "zone"], _options(found.inside.join(scored, ["left_text", "right_text"]), placed, ["right_text", "zone"], ["left_text", "zone"])),
        # the venue has none
        (q.where("zone is not null"), ["left_text"], _options(scored, homeless, ["right_text"], ["left_text"])),
        # the sighting has none
        (q.where("zone is null"), ["left_text"], _options(scored, anywhere, ["right_text"], ["left_text"])),
    ]
    met = None
    for rows, at, option in options:
        one = rows.join(option, at).where(F.col("f.since") < F.col("ord")).select("query_id", "score", "f", "catalogue")
        met = one if met is None else met.union(one)
    best = met.groupBy("query_id").agg(
        F.min_by(
            F.struct("score", F.col("f.entity").alias("entity"), "catalogue"),
            F.struct((-F.col("score")).alias("s"), F.col("f.entity_ord").alias("o")),
        ).alias("b")
    )
    close = F.col("b.score") >= F.when(F.col("b.catalogue"), catalogue_threshold).otherwise(threshold)
    return best.where(close).select(
        "query_id", F.col("b.entity").alias("entity"), F.col("b.score").alias("score")
    )


def _resolve_creators(nodes: DataFrame, params: ScoringParams, fuzzy: bool) -> DataFrame:
    """(node columns, root, method, score) for rows that may create venues and stored venues."""
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.col("tier")).alias("method")
    links = follow_pointers(_exact_parents(nodes)).select("node", "root", method, F.lit(None).cast("double").alias("score"))
    members = settle(nodes.join(links, "node", "left").withColumn("root", F.coalesce("root", "node")))
    if not fuzzy:
        return members
    venue = members.groupBy("root").agg(
        F.min_by("postal", F.when(F.col("postal").isNotNull(), F.col("node"))).alias("postal"),
        F.min("node").alias("entity_ord"),
    )
    index = (
        members.groupBy("root", "name_key")
        .agg(F.min("node").alias("since"))
        .join(venue, "root")
        .select(F.col("root").alias("entity"), "name_key", "postal", "since", "entity_ord")
    )
    starts = members.where((F.col("node") == F.col("root")) & F.col("venue_id").isNull())
    found = fuzzy_matches(
        starts.select(F.col("node").alias("query_id"), "name_key", "postal", F.col("node").alias("ord"), "catalogue"),
        index,
        params.fuzzy_threshold,
        params.catalogue_threshold,
    )
    links = settle(
        found.select(F.col("query_id").alias("node"), F.col("entity").alias("parent"), "score")
    )
    chains = follow_pointers(links.select("node", "parent"))
    chains = chains.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    joined = members.drop("score").join(chains, "root", "left").join(
        links.select("node", "score", F.lit("fuzzy_name").alias("_fuzzy")), "node", "left"
    )
    return settle(joined.select(
        *[c for c in nodes.columns],
        F.coalesce("_top", "root").alias("root"),
        F.coalesce("_fuzzy", "method").alias("method"), "score",
    ))


#: Kinds of keys by which a known entity is looked up, and the tiers they stand for.
_ANYWHERE, _HOMELESS = 5, 6
_LOOKUPS = {_PLACE: "place_id", _NAME: "name_postal", _PHONE: "phone", _BOOKING: "booking_link", _ANYWHERE: "name_exact", _HOMELESS: "name_exact"}


def match_exact(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Tiers 1 to 5 of ``rows`` (node, keys, ord) against known entities.

    ``index``: entity, keys, since, entity_ord.  A key held by several entities belongs to the first
    one.  Returns (node, entity, method) for the rows that match.

    All tiers share one table of keys, in which an entity has one row for every key of its own."""
    name, posted = F.col("name_key"), F.col("postal").isNotNull()
    plain = (_PLACE, F.col("place_id")), (_NAME, F.when(posted & name.isNotNull(), F.concat_ws("\u0001", name, "postal"))), (_PHONE, F.col("phone")), (_BOOKING, F.col("booking"))
    at = ["kind", "key"]
    keys = _held(index.select("entity", "entity_ord", "since", *_KEYS), *plain, (_ANYWHERE, name), (_HOMELESS, F.when(~posted, name)))
    keys = keys.groupBy(*at, "entity", "entity_ord").agg(F.min("since").alias("since"))
    asked = _held(rows.select("node", "ord", *_KEYS), *plain, (_ANYWHERE, F.when(~posted, name)), (_HOMELESS, F.when(posted, name)))
    met = asked.join(_claims(materialise(keys), at), at).where(F.col("f.since") < F.col("ord"))
    best = F.min_by(F.struct("f.entity", "kind"), F.struct(F.least("kind", F.lit(_ANYWHERE)).alias("tier"), "f.entity_ord")).alias("b")
    label = F.element_at(F.create_map(*[F.lit(x) for kind in _LOOKUPS.items() for x in kind]), F.col("b.kind"))
    return met.groupBy("node").agg(best).select("node", F.col("b.entity").alias("entity"), label.alias("method"))


def _attach_only(
    pending: DataFrame, settled: DataFrame, params: ScoringParams, fuzzy: bool
) -> DataFrame:
    """Rows that must not create venues look for one, repeatedly: a row that attaches brings its
    own keys along, which may help a later one."""
    venues = settled.groupBy("root").agg(
        F.min_by("postal", F.when(F.col("postal").isNotNull(), F.col("node"))).alias("venue_postal"),
        F.min("node").alias("entity_ord"),
    )
    venues = settle(venues)
    done, sources = None, settled
    while True:
        index = sources.join(venues, "root").select(
            F.col("root").alias("entity"), "place_id", "name_key",
            F.col("venue_postal").alias("postal"), "phone", "booking", F.col("node").alias("since"),
            "entity_ord",
        )
        hits = match_exact(pending.withColumn("ord", F.col("node")), index).withColumn("score", F.lit(None).cast("double"))
        if fuzzy:
            hits = settle(hits)
            rest = settle(pending.join(hits, "node", "left_anti"))
            if not rest.isEmpty():
                near = fuzzy_matches(
                    rest.select(F.col("node").alias("query_id"), "name_key", "postal", F.col("node").alias("ord"), "catalogue"),
                    index.groupBy("entity", "name_key", "postal", "entity_ord").agg(F.min("since").alias("since")),
                    params.fuzzy_threshold,
                    params.catalogue_threshold,
                )
                hits = hits.union(
                    near.select(F.col("query_id").alias("node"), "entity", F.lit("fuzzy_name"), "score")
                )
        hits = settle(hits)
        if hits.isEmpty():
            return done
        new = settle(pending.join(hits.withColumnRenamed("entity", "root"), "node"))
        done = new if done is None else done.unionByName(new)
        sources = new  # the rest has already been compared with everything older
        pending = settle(pending.join(hits, "node", "left_anti"))
        if pending.isEmpty():
            return done


def resolve(
    sightings: DataFrame,
    known: DataFrame | None = None,
    next_id: int = 1,
    params: ScoringParams | None = None,
    fuzzy: bool = True,
    id_format: str = "v%05d",
) -> Resolution:
    """Assign every sighting of a run to a venue; see the module text for the rules.

    ``assignments`` carries all sighting columns plus venue_id, method, match_score, ``ord`` and
    the venue's kept name."""
    params = params or ScoringParams()
    # rows are stored with a number, so that of identical sightings always the same one leads its node
    rows = match_keys(sightings).select(*sightings.columns, "name_key", F.monotonically_increasing_id().alias("_row"))
    keyed = _plain_keys(with_ingest_order(store(rows, "sightings")))
    nodes = _nodes(keyed)
    if known is not None:
        nodes = nodes.unionByName(_known_nodes(known))
    nodes = _numbered(nodes)
    settled = _resolve_creators(nodes.where("creator"), params, fuzzy)
    waiting = nodes.where("not creator")
    members = settled
    if not waiting.isEmpty():
        attached = _attach_only(waiting, settled, params, fuzzy)
        if attached is not None:
            members = settled.unionByName(attached)

    starts = settled.where(F.col("node") == F.col("root")).select("root", "venue_id", "name")
    fresh = row_numbers(starts.where("venue_id is null").drop("venue_id"), [], [F.col("root").asc()], "n")
    fresh = fresh.withColumn(
        "venue_id", F.format_string(id_format, F.col("n") + F.lit(next_id - 1))
    )
    stored = starts.where("venue_id is not null").select("root", "venue_id", "name")
    ids = settle(
        fresh.select("root", "venue_id", F.col("name").alias("kept_name"), F.lit(True).alias("is_new"))
        .union(stored.select("root", "venue_id", "name", F.lit(False)))
    )
    by_node = members.where("lead is not null").select(
        _digest().alias("node"), "root", "method", "score", (F.col("node") == F.col("root")).alias("is_start"), "lead"
    ).join(ids, "root").drop("root")
    own_tier = (
        F.when(F.col("place_id").isNotNull(), "place_id")
        .when(F.col("postal").isNotNull(), "name_postal")
        .when(F.col("phone").isNotNull(), "phone")
        .when(F.col("booking").isNotNull(), "booking_link")
        .otherwise("name_exact")
    )
    leads = F.col("_row") == F.col("lead")
    assigned = keyed.withColumn("node", _digest()).join(by_node, "node", "left").select(
        *sightings.columns, "ord", "name_key", "venue_id",
        F.when(F.col("venue_id").isNull(), "none")
        .when(F.col("is_start") & F.col("is_new") & leads, "created")
        .when(leads, F.col("method"))
        .otherwise(own_tier)
        .alias("method"),
        F.when(leads, F.col("score")).alias("match_score"),
        "kept_name",
    )
    created = ids.where("is_new").select("venue_id", "kept_name")
    return Resolution(assigned, created, next_id + created.count())


def merge_log(assignments: DataFrame) -> DataFrame:
    """Audit rows: sightings attached by a weaker key under a name that is not the venue's own."""
    weak = F.col("method").isin("fuzzy_name", "phone", "booking_link")
    return assignments.where(weak & (F.col("name_key") != name_key(F.col("kept_name")))).select(
        "run_id",
        F.col("venue_id").alias("kept_venue_id"),
        "kept_name",
        F.col("name").alias("merged_name"),
        F.col("source_key").alias("merged_source"),
        "method",
        F.col("match_score").alias("score"),
        F.lit(False).alias("reviewed"),
    )


def match_stats(assignments: DataFrame) -> DataFrame:
    """One row per method with its count; created, skipped (none) and attached follow from it."""
    return assignments.groupBy("method").agg(F.count(F.lit(1)).alias("sightings"))


def known_keys(venues: DataFrame, names: DataFrame) -> DataFrame:
    """Key rows of stored venues for :func:`resolve`: one per (venue, name)."""
    order = F.regexp_extract("venue_id", r"(\d+)$", 1).try_cast("long")
    return (
        names.select("venue_id", name_key(F.col("alias")).alias("name_key"))
        .where("name_key <> ''")
        .distinct()
        .join(
            venues.select(
                "venue_id",
                F.col("postal_code").alias("postal"),
                F.col("google_place_id").alias("place_id"),
                "phone",
                F.col("booking_url").alias("booking"),
                order.alias("created"),
            ),
            "venue_id",
        )
    )

"""Enrichment by lookup: coordinates, nearest stations, regions, and distance search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.geo import EARTH_RADIUS_M, haversine_m
from placerank.session import materialise

METRES_PER_DEGREE = 2 * math.pi * EARTH_RADIUS_M / 360.0
#: Stations that may share a first cell, and the narrowest cell in degrees.
CROWD, LEAST_CELL = 32, 1e-6


def geocode(venues: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Fill missing coordinates by postal code; adds ``geocoded`` (true, false, null = not needed).

    ``gazetteer``: query_postal, result_postal, lat, lng, position — several answers per lookup; the
    one with the very postal code wins, else the first."""
    exact = (F.trim("result_postal") == F.col("query_postal")) & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    answers = gazetteer.groupBy("query_postal").agg(
        F.min_by(
            F.struct("lat", "lng"), F.struct((~F.coalesce(exact, F.lit(False))).alias("other"), "position")
        ).alias("hit")
    )
    missing = (F.col("lat").isNull() | F.col("lng").isNull()) & F.col("postal_code").isNotNull()
    joined = venues.join(
        answers.select(F.col("query_postal").alias("postal_code"), "hit"), "postal_code", "left"
    )
    found = F.col("hit.lat").isNotNull() & F.col("hit.lng").isNotNull()
    use = missing & found
    new = {
        "lat": F.when(use, F.col("hit.lat")).otherwise(F.col("lat")),
        "lng": F.when(use, F.col("hit.lng")).otherwise(F.col("lng")),
    }
    return joined.select(
        *[new.get(c, F.col(c)).alias(c) for c in venues.columns], F.when(missing, found).alias("geocoded")
    )


def nearest_station(places: DataFrame, stations: DataFrame, id_col: str = "venue_id") -> DataFrame:
    """(id, station, metres, lines) of the closest station; the first by name on equal distance.

    ``stations``: name, lat, lng, lines.  The same grid join for every size of the station table."""
    return nearest_by_grid(places, stations, id_col)


def _cells(degrees: float) -> tuple[Column, Column]:
    return F.floor(F.col("lat") / degrees), F.floor(F.col("lng") / degrees)


def _uncrowded(spots: DataFrame, width: float) -> float:
    """The widest of the cells ``width``, a quarter of it and so on in which at most ``CROWD`` spots share a cell."""
    while width > LEAST_CELL:
        y, x = _cells(width)
        most = spots.groupBy(y.alias("y"), x.alias("x")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= CROWD:
            break
        width /= 4
    return width


def nearest_by_grid(
    places: DataFrame, stations: DataFrame, id_col: str = "venue_id", first_cell: float = 0.01
) -> DataFrame:
    """Exact nearest neighbour for a large station table, by equi-joins on grid cells.

    Stations are written into their cell and its eight neighbours; a place meets those of its own
    cell.  A hit closer than one cell width is final (anything nearer would share a neighbouring
    cell); the rest try again with cells four times as wide.  Places at the same spot search once, and the first
    cells are so narrow that few stations share one.  Stations at the same spot count once,
    those without coordinates never; near the date line a station also stands on the other side of it."""
    here = places.where("lat is not null and lng is not null").select(id_col, "lat", "lng")
    spots = materialise(
        stations.where("lat is not null and lng is not null")
        .groupBy("lat", "lng")
        .agg(F.min_by(F.struct("name", "lines"), "name").alias("s"))
    )
    spot = ["lat", "lng"]
    pending, done, width = materialise(here.select(*spot).distinct()), None, _uncrowded(spots, first_cell)
    while True:
        whole_earth = width > 360
        y, x = _cells(width)
        ring = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        east, west = F.col("lng") > 180 - 2 * width, F.col("lng") < 2 * width - 180
        copies = spots.union(spots.where(east).withColumn("lng", F.col("lng") - 360)).union(spots.where(west).withColumn("lng", F.col("lng") + 360))
        spread = (spots if whole_earth else copies).select(
            F.col("lat").alias("slat"), F.col("lng").alias("slng"), "s", y.alias("y"), x.alias("x"), F.explode(ring).alias("d")
        ).select("slat", "slng", "s", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
        metres = haversine_m(F.col("lat"), F.col("lng"), F.col("slat"), F.col("slng"))
        near = pending.withColumns({"y": y, "x": x}).join(spread, ["y", "x"]).groupBy(*spot).agg(
            F.min(F.struct(metres.alias("metres"), F.col("s.name").alias("name"), F.col("s.lines").alias("lines"))).alias("b"),
        ).withColumn("_lat", F.abs("lat"))
        # a degree of longitude shrinks towards the poles
        sure = F.col("b.metres") <= F.lit(width * METRES_PER_DEGREE) * F.cos(F.radians(F.least(F.col("_lat") + width, F.lit(90.0))))
        hits = materialise((near if whole_earth else near.where(sure)).select(*spot, "b"))
        done = hits if done is None else done.union(hits)
        pending = materialise(pending.join(hits, spot, "left_anti"))
        if whole_earth or pending.isEmpty():
            break
        width *= 4
    found = here.join(done, spot).groupBy(id_col).agg(F.min("b").alias("b"))
    return found.select(id_col, F.col("b.name").alias("station"), F.col("b.metres").alias("metres"), F.col("b.lines").alias("lines"))


def near_me(places: DataFrame, lat: float, lng: float, radius_km: float | None) -> DataFrame:
    """Places with coordinates within the radius, with ``distance_km`` (sort by it to serve)."""
    rows = places.where("lat is not null and lng is not null")
    if radius_km is not None:
        # a box first: cheap, and pushed down to the scan
        dlat = radius_km * 1000.0 / METRES_PER_DEGREE * 1.001
        shrink = max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dlat))))
        rows = rows.where(F.col("lat").between(lat - dlat, lat + dlat))
        rows = rows.where(F.col("lng").between(lng - dlat / shrink, lng + dlat / shrink))
    km = haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) / 1000.0
    rows = rows.withColumn("distance_km", km)
    return rows if radius_km is None else rows.where(F.col("distance_km") <= radius_km)


def build_stations(exits: DataFrame, current: DataFrame) -> DataFrame:
    """Mean point of a station's exits; known lines carried over.

    ``exits``: name, lat, lng; ``current``: name, lines."""
    cleaned = F.regexp_replace(F.initcap(F.regexp_replace(F.trim("name"), r"(?i)\s+MRT STATION$", "")), "Harbourfront", "HarbourFront")
    points = exits.select(cleaned.alias("name"), "lat", "lng").where("name <> ''")
    means = points.groupBy("name").agg(F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lng"), 5).alias("lng"))
    lines = current.select(F.lower("name").alias("_key"), "lines")
    return means.join(lines, F.lower("name") == F.col("_key"), "left").select(
        "name", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), "lat", "lng"
    )

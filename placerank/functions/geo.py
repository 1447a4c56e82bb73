"""Distances and the postal gazetteer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import lookup
from placerank.functions.lexicons import POSTAL_SECTORS

EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def sector_region(postal: Column) -> Column:
    """STRUCT(district, region) of a six-digit postal code, both null when unknown."""
    districts = {s: d for d, _, sectors in POSTAL_SECTORS for s in sectors.split()}
    regions = {s: r for _, r, sectors in POSTAL_SECTORS for s in sectors.split()}
    sector = F.when(postal.rlike(r"^\d{6}$"), F.substring(postal, 1, 2))
    return F.struct(lookup(districts, sector).alias("district"), lookup(regions, sector).alias("region"))


def run_time(run_id: Column) -> Column:
    """Timestamp of a run id such as 20260901T000000Z; null for anything else."""
    return F.when(
        run_id.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(run_id, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    )

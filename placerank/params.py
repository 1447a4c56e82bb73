"""Tunable numbers and the small configuration tables (categories, weights, sources)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The weight components a category may use.
COMPONENTS = (
    "rating", "recommendations", "ambience", "service", "food", "value", "space",
    "kid_friendly", "parking", "weekend_open", "quiet", "keyword_match", "michelin",
)

# Default weights and group keywords every category starts from.
DEFAULT_WEIGHTS = {
    "rating": 0.30, "recommendations": 0.30, "keyword_match": 0.10, "food": 0.10, "service": 0.05,
    "value": 0.05, "ambience": 0.05, "space": 0.0, "kid_friendly": 0.0, "parking": 0.0,
    "weekend_open": 0.05, "quiet": 0.0,
}
GROUP_KEYWORDS = {
    "dating": ("romantic", "date night", "date", "anniversary", "cosy", "cozy", "intimate", "couple",
               "proposal", "valentine"),
    "family": ("family", "kids", "children", "elderly", "grandparents", "parents", "birthday",
               "reunion", "gathering", "toddler", "high chair"),
    "general": ("new", "newly opened", "just opened", "opening", "opened", "latest", "soft launch",
                "新开", "新店"),
}


@dataclass(frozen=True)
class ScoringParams:
    """Numbers of the scoring formula; the defaults are part of the semantics."""

    top_n: int = 15
    fuzzy_threshold: float = 88.0
    catalogue_threshold: float = 95.0
    per_pax: Mapping[int, float] = field(
        default_factory=lambda: {1: 15.0, 2: 35.0, 3: 80.0, 4: 160.0}
    )
    new_within_days: int = 30
    prior_reviews: float = 100.0
    prior_rating: float = 4.2
    half_life_months: float = 18.0
    stale_years: float = 4.0
    days_per_month: float = 30.4
    undated_weight: float = 0.5
    stale_weight: float = 0.05
    min_confidence: float = 0.5
    award_bonus: float = 0.03
    multi_source_bonus: float = 0.03
    multi_source_threshold: int = 3
    declining_penalty: float = 0.05
    hygiene_penalty: float = 0.10
    closed_penalty: float = 0.50
    buzz_bonus_max: float = 0.05
    personal_weight: float = 0.15


@dataclass(frozen=True)
class BuzzParams:
    window_months: int = 6
    half_life_days: float = 60.0
    undated_weight: float = 0.25
    trending_threshold: int = 5
    days_per_month: float = 30.4

    @property
    def window_days(self) -> int:
        return int(self.window_months * self.days_per_month)


@dataclass(frozen=True)
class Category:
    """One ranked list: who searches for it, how it weighs, what it excludes."""

    key: str
    display_name: str
    group: str = "general"
    party_size: int = 2
    queries: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    pool_from: tuple[str, ...] = ()
    digest_only: bool = False
    exclude_closed: bool = True
    open_weekends: bool = False
    requires_private_room: bool = False
    halal_only: bool = False
    max_price_level: int | None = None
    price_required: bool = False
    bill_range: tuple[float, float] | None = None
    price_levels: tuple[int, ...] | None = None
    awards: tuple[str, ...] | None = None
    opened_within_months: int | None = None

    def __post_init__(self) -> None:
        unknown = set(self.weights) - set(COMPONENTS)
        if unknown:
            raise ValueError(f"unknown weight components: {sorted(unknown)}")

    def merged_weights(self) -> dict[str, float]:
        return {**DEFAULT_WEIGHTS, **self.weights}

    def merged_keywords(self) -> list[str]:
        return list(dict.fromkeys([*GROUP_KEYWORDS.get(self.group, ()), *self.keywords]))


CATEGORY_SCHEMA = (
    "category_key string, display_name string, category_group string, party_size int, "
    "queries array<string>, keywords array<string>, pool array<string>, digest_only boolean, "
    "exclude_closed boolean, need_weekends boolean, need_private_room boolean, need_halal boolean, "
    "max_price_level int, price_required boolean, bill_low double, bill_high double, "
    "price_levels array<int>, awards array<string>, opened_within_months int"
)


def category_table(spark: SparkSession, categories: Iterable[Category]) -> DataFrame:
    """Configuration as a table: one row per category (tens of rows by construction)."""
    rows, seen = [], set()
    for c in categories:
        if c.key in seen:
            raise ValueError(f"duplicate category key: {c.key}")
        seen.add(c.key)
        low, high = c.bill_range or (None, None)
        rows.append((
            c.key, c.display_name, c.group, c.party_size, list(c.queries), c.merged_keywords(),
            [c.key, *c.pool_from], c.digest_only, c.exclude_closed, c.open_weekends,
            c.requires_private_room, c.halal_only, c.max_price_level, c.price_required, low, high,
            list(c.price_levels) if c.price_levels else None,
            list(c.awards) if c.awards else None, c.opened_within_months,
        ))
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)


def weight_table(spark: SparkSession, categories: Iterable[Category]) -> DataFrame:
    """(category_key, component, weight) with the weights of a category summing to one."""
    rows = []
    for c in categories:
        merged = c.merged_weights()
        total = sum(merged.values())
        rows += [(c.key, k, w / total if total > 0 else 0.0) for k, w in merged.items()]
    return spark.createDataFrame(rows, "category_key string, component string, weight double")


def source_table(spark: SparkSession, sources: Iterable[tuple]) -> DataFrame:
    """(source_key, source_name, kind, independent, query_driven, applies_to)."""
    return spark.createDataFrame(
        list(sources),
        "source_key string, source_name string, kind string, independent boolean, "
        "query_driven boolean, applies_to array<string>",
    )

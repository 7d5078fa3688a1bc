"""Wear, repair and priority measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rating under which a road is poor, least yearly loss, longest forecast, years a survey may lag.
POOR, LEAST_RATE, MOST_YEARS, AGES = 60, 0.1, 50, (2, 40)
# Shares of years to poor, cracking and flooding in the priority score.
SHARES = (0.45, 0.35, 0.2)
# What a road without a forecast and a flood score are said to be; percent of a road from which it counts as
# cracked; edges of depth bands in metres; high flood score.
NOTHING_LEFT = "Its rating is 0, so there is nothing left to count down."
OLD_SURFACE = "It was resurfaced in %d, after its %d inspection, so the rating describes the old surface."
OUT_OF_DATE = "Its rating is out of date (resurfaced after the last inspection)."
FLOOD_TEXTS = ("Not scored (outside the Helene zone)", "High flood score (Helene zone)", "Lower flood score (Helene zone)")
CRACK_PCT, DEPTH_EDGES, HIGH_FLOOD = 10, (0.3, 1, 2), 0.5


def years_to_poor(rating: Column, rate: Column) -> Column:
    """0 under 60; otherwise points left over the yearly loss, at most 50; null for a missing or zero rating."""
    years = F.least((rating - POOR) / F.greatest(rate, F.lit(LEAST_RATE)), F.lit(float(MOST_YEARS)))
    return F.when(rating.isNull() | (rating == 0) | rate.isNull(), None).when(rating < POOR, F.lit(0.0)).otherwise(years)


def wear_targets(rating: Column, survey_year: Column, rehab_year: Column, cracked: dict[str, Column]) -> dict[str, Column]:
    """What models learn: age at the survey, yearly loss, years to poor, and whether over CRACK_PCT of the road is cracked.

    ``cracked`` has moderate and high shares; a road whose high share was not surveyed has no crack target. A rating of 0
    is none, and a survey before the repair, or ages out of AGES, leave no loss.
    """
    age = survey_year - rehab_year
    rated = F.when(rating > 0, rating)
    rate = wear_rate(rated, age)
    share = F.coalesce(cracked["moderate"], F.lit(0)) + F.coalesce(cracked["high"], F.lit(0))
    crack = F.when(cracked["high"].isNotNull(), (share > CRACK_PCT).cast("double"))
    return {"age_at_survey": F.when(age >= 0, age), "y_rate": rate, "y_years_to_poor": years_to_poor(rated, rate), "y_crack": crack}


def wear_rate(rating: Column, age: Column) -> Column:
    """Points lost a year since the last repair, for ages 2 to 40; never negative, null without a rating."""
    return F.when(age.between(*AGES) & rating.isNotNull(), F.greatest((100 - rating) / age, F.lit(0.0)))


def repair_bucket(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years <= 0, "fix_now").when(years <= 1, "1y").when(years <= 5, "5y").otherwise("later")


def bucket_order(bucket: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ("fix_now", "1y", "5y", "later", "unknown"))), bucket).cast("int")


def tier(years: Column, crack: Column, flood: Column, in_zone: Column, cfg: dict[str, float]) -> Column:
    """1 (worst) to 5 by the first test that holds; a missing value fails its test."""

    def low(k: str) -> Column:
        return F.coalesce(years <= cfg[k], F.lit(False))

    def high(c: Column, k: str) -> Column:
        return F.coalesce(c >= cfg[k], F.lit(False))

    wet = F.coalesce(in_zone, F.lit(False)) & high(flood, "flood")
    return F.when(low("now") & (high(crack, "crack") | wet), 1).when(low("now"), 2).when(low("soon") | wet, 3).when(high(crack, "crack"), 4).otherwise(5)


def priority_score(years: Column, crack: Column, flood: Column, in_zone: Column) -> Column:
    wear = 1 - F.least(F.coalesce(years, F.lit(float(MOST_YEARS))), F.lit(float(MOST_YEARS))) / MOST_YEARS
    wet = F.when(in_zone, F.coalesce(flood, F.lit(0.0))).otherwise(0.0)
    return SHARES[0] * wear + SHARES[1] * F.coalesce(crack, F.lit(0.0)) + SHARES[2] * wet


def condition_score(mode: str, years: Column, crack: Column, flood: Column, in_zone: Column, cfg: dict[str, float]) -> Column:
    """0 (worst) to 1 (best) for one colour scale, null without a value; ``years_linear`` is the share of 35 years left, 0.05 at least.

    ``cfg`` has the crack and flood scores that count as worst (for flood only inside the zone).
    """
    one = F.lit(1.0)
    if mode == "years":
        return F.when(years.isNotNull(), F.sqrt(F.least(years, F.lit(30.0)) / 30))
    if mode == "years_linear":
        return F.when(years.isNotNull(), F.least(F.greatest(years / 35, F.lit(0.05)), one))
    if mode == "crack":
        return F.when(crack.isNotNull(), 1 - F.least(crack / cfg["crack"], one))
    return F.when(in_zone & flood.isNotNull(), 1 - F.least(F.sqrt(flood / cfg["flood"]), one))


def project_rating(rating: Column, rate: Column, years: int) -> Column:
    """Ratings of the next years on a straight line, never under 0."""
    return F.when(rating.isNotNull() & rate.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(years)), lambda t: F.greatest(rating - rate * t, F.lit(0.0))))


def crossing_year(rating: Column, rate: Column) -> Column:
    """Years until the straight line of ``project_rating`` reaches POOR; null where it falls nowhere or has passed."""
    return F.when((rate > 0) & (rating > POOR), (rating - POOR) / rate)


def no_estimate_reason(rating: Column, rehab_year: Column, survey_year: Column) -> Column:
    """Why a road has no forecast, as a sentence."""
    older = F.format_string(OLD_SURFACE, rehab_year.cast("int"), survey_year.cast("int"))
    return F.when(rating == 0, NOTHING_LEFT).when(rehab_year > survey_year, older).otherwise(OUT_OF_DATE)


def flood_rank(flood: Column, in_zone: Column) -> Column:
    high = F.coalesce(flood >= HIGH_FLOOD, F.lit(False))
    outside = ~F.coalesce(in_zone, F.lit(False))
    return F.when(outside, FLOOD_TEXTS[0]).when(high, FLOOD_TEXTS[1]).otherwise(FLOOD_TEXTS[2])


def depth_on_road(level: Column, road_level: Column, always_dry: Column) -> Column:
    """Centimetres of water over the road; 0 where always dry; null where the water's or the road's level is unknown."""
    return F.when(always_dry, F.lit(0.0)).when(road_level.isNull() | level.isNull(), None).otherwise(F.greatest((level - road_level) * 100, F.lit(0.0)))


def depth_band(depth_m: Column) -> Column:
    """Dry, or between which of DEPTH_EDGES, the lower one included; null without a depth."""
    a, b, c = DEPTH_EDGES
    wet = F.when(depth_m < a, f"under {a} m").when(depth_m < b, f"{a} to {b} m").when(depth_m < c, f"{b} to {c} m").otherwise(f"over {c} m")
    return F.when(depth_m.isNull(), None).when(depth_m <= 0, "dry").otherwise(wet)


def typical_miss(dist: Column, bands: list[tuple[float, float, float | None, bool]]) -> Column:
    """The median miss of the band (lo, hi] that holds a distance, 0 in the first; null in a band with too few marks.

    ``bands`` has lo, hi, median and too_few of the few distance bands.
    """
    out = F.lit(None).cast("double")
    for lo, hi, median, too_few in reversed(bands):
        inside = (dist > lo) & (dist <= hi) | (dist == 0) & F.lit(lo == 0)
        out = F.when(inside, F.lit(None if too_few else median).cast("double")).otherwise(out)
    return out


def guarded(a: Column, b: Column) -> Column:
    """a over b; null where b is null or zero."""
    return a / F.nullif(b, F.lit(0))


def best_value(**sources: Column) -> tuple[Column, Column]:
    """The first value there is, and the name of its source or ``none``."""
    name = F.lit("none")
    for k, c in reversed(list(sources.items())):
        name = F.when(c.isNotNull(), k).otherwise(name)
    return F.coalesce(*sources.values()), name


def exposure_years(window_start: Column, rehab_year: Column, end: Column) -> Column:
    """Years watched from the later of the window's start and 1 January after the repair; at least 0."""
    start = F.greatest(window_start, F.make_date(rehab_year + 1, F.lit(1), F.lit(1)))
    return F.greatest(F.datediff(end, start) / 365.25, F.lit(0.0))


def is_live(as_of: Column, now: Column) -> Column:
    """Whether ``as_of`` is now or up to an hour ago."""
    return (now >= as_of) & (now <= as_of + F.make_interval(hours=F.lit(1)))

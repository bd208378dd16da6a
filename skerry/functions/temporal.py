"""Dates, closures, seasons and the moon as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.schemas import Season, Zone

# A reference new moon (UTC) and the mean synodic month in days.
NEW_MOON = "2000-01-06 18:14:00"
SYNODIC_DAYS = 29.530588853
PHASES = ("new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent")
SPRING = 0.5


def fail(message: Column, kind: str) -> Column:
    return F.raise_error(message).cast(kind)


def scene_date(timestamp: Column) -> Column:
    """The local date of the written offset; a missing or invalid timestamp is an error."""
    whole = F.try_to_timestamp(F.regexp_replace(timestamp, "Z$", "+00:00"))
    day = F.when(whole.isNotNull(), F.to_date(F.substring(timestamp, 1, 10)))
    return F.coalesce(day, fail(F.concat(F.lit("scene timestamp is missing or invalid: "), F.coalesce(timestamp, F.lit("null"))), "date"))


def instant(timestamp: Column) -> Column:
    """The instant meant; a timestamp without an offset is in UTC (the session's zone)."""
    whole = F.try_to_timestamp(F.regexp_replace(timestamp, "Z$", "+00:00"))
    return F.coalesce(whole, fail(F.concat(F.lit("scene timestamp is missing or invalid: "), F.coalesce(timestamp, F.lit("null"))), "timestamp"))


def closure_dates(zone: Zone) -> tuple[date, date] | None:
    """First and last day of a zone's closure; a malformed one is an error that names the zone."""
    if not zone.closure:
        return None
    try:
        start, end = date.fromisoformat(zone.closure[0]), date.fromisoformat(zone.closure[1])
    except (TypeError, ValueError) as wrong:
        raise ValueError(f"zone {zone.id}: malformed closure {zone.closure!r}") from wrong
    return start, end


def closure_active(zone: Zone, day: Column) -> Column:
    dates = closure_dates(zone)
    return F.lit(False) if dates is None else day.between(F.lit(dates[0]), F.lit(dates[1]))


def month_day(value: str | None, which: str) -> int:
    """An MM-DD bound as month * 100 + day, checked against a leap year."""
    try:
        month, day = (int(x) for x in str(value).split("-"))
        date(2000, month, day)
    except ValueError as wrong:
        raise ValueError(f"season {which} must be a valid MM-DD date, got {value!r}") from wrong
    return month * 100 + day


def in_season(day: Column, season: Season) -> Column:
    """Whether a date lies in a yearly window, which may run over the year's end."""
    start, end = month_day(season.start, "start"), month_day(season.end, "end")
    now = F.month(day) * 100 + F.dayofmonth(day)
    return now.between(start, end) if start <= end else (now >= start) | (now <= end)


def phase(when: Column) -> Column:
    """Place in the lunar cycle: 0 new moon, 0.5 full moon. Takes timestamps with or without zone."""
    days = _days(when)
    return F.pmod(days, F.lit(SYNODIC_DAYS)) / F.lit(SYNODIC_DAYS)


def _days(when: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(NEW_MOON).cast("timestamp_ntz"), when.cast("timestamp_ntz")) / F.lit(86400e6)


def illumination(turn: Column) -> Column:
    return (F.lit(1.0) - F.cos(F.lit(2.0) * F.pi() * turn)) / 2


def spring_index(turn: Column) -> Column:
    return (F.cos(F.lit(4.0) * F.pi() * turn) + 1) / 2


def phase_name(turn: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PHASES)), F.pmod(F.floor(turn * 8 + F.lit(0.5)), F.lit(8)).cast("int") + 1)


def suitability(season: Column, light: Column, spring: Column, dark_at: float) -> Column:
    dark, tide = light <= F.lit(dark_at), spring >= F.lit(SPRING)
    return F.when(~season, "out_of_season").when(dark & tide, "high").when(dark | tide, "moderate").otherwise("low")


ROLE = "ranks days and zones for observation; it is no indicator against a vessel and no part of any score"
SCOPE = "the fishery works from shore and small craft, which the radar cannot see; the signal is about where to look, not who was seen"
CROSS_CHECK = "times of high water and of darkness come from the authority's own tables for the estuary"


def conditions(scenes, config, timestamp: str = "timestamp"):
    """Scenes with their environmental context: season, moon, tide tendency, suitability and why."""
    ts = F.col(timestamp)
    turn, light, tide = F.col("_turn"), F.col("_light"), F.col("_tide")
    rows = scenes.withColumn("_turn", phase(instant(ts))).withColumn("_light", illumination(turn)).withColumn("_tide", spring_index(turn))
    rows = rows.withColumn("in_season", in_season(scene_date(ts), config.season)).withColumn("moon_phase", phase_name(turn)).withColumn(
        "suitability", suitability(F.col("in_season"), light, tide, config.dark_illumination)
    )
    window = f"{config.season.start} to {config.season.end}"
    percent = F.concat(F.bround(light * 100, 0).cast("int").cast("string"), F.lit("%"))
    why = (
        F.when(F.col("suitability") == "out_of_season", F.lit(f"outside the season ({window}): the moon raises no priority while the fishery is closed"))
        .when(F.col("suitability") == "high", F.concat("moon_phase", F.lit(": dark night ("), percent, F.lit(" lit) with spring tides, in season")))
        .when(
            F.col("suitability") == "moderate",
            F.concat("moon_phase", F.lit(", in season: "), F.when(light <= config.dark_illumination, "a dark night").otherwise("spring tides"), F.lit(" only"))
        )
        .otherwise(F.concat("moon_phase", F.lit(": bright night ("), percent, F.lit(" lit) near neap tides")))
    )
    rows = rows.withColumns({
        "season_window": F.lit(window), "moon_illumination": F.round(light, 3), "darkness_favourability": F.round(1 - light, 3),
        "spring_tide_tendency": F.round(tide, 3), "rationale": why
    })
    rows = rows.withColumns({k: F.lit(v) for k, v in (("role", ROLE), ("sensor_scope", SCOPE), ("cross_check_required", CROSS_CHECK))})
    return rows.drop("_turn", "_light", "_tide")

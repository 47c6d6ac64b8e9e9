"""Intervals, visibility and clocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENT = ("active", "superseded", "expired")
HISTORICAL = ("active", "archived", "superseded", "expired")


def within(start: Column, end: Column, at: Column) -> Column:
    """Whether the half-open interval holds ``at``; a null end is unbounded, and so is a null start."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return (end2.isNull() | start1.isNull() | (start1 < end2)) & (end1.isNull() | start2.isNull() | (start2 < end1))


def visible(valid_as_of: Column, known_as_of: Column | None = None, historical: bool = False) -> Column:
    """The bitemporal predicate over ``valid_*``, ``recorded_*``, ``expires_at`` and ``status``; a null status is active.

    A historical read ignores when a fact ended. Other reads take facts in force, and of those not active any more only
    the ones with an end.
    """
    status = F.coalesce(F.col("status"), F.lit("active"))
    known = within(F.col("recorded_from"), F.col("recorded_to"), known_as_of) if known_as_of is not None else F.lit(True)
    if historical:
        return (F.col("valid_from").isNull() | (F.col("valid_from") <= valid_as_of)) & known & status.isin(*HISTORICAL)
    in_force = within(F.col("valid_from"), F.col("valid_to"), valid_as_of)
    ended = (status == "active") | F.col("valid_to").isNotNull()
    return in_force & known & status.isin(*CURRENT) & ended & (F.col("expires_at").isNull() | (F.col("expires_at") > valid_as_of))


def drop_reason(valid_as_of: Column) -> Column:
    """Why a current read leaves a row out; null if it does not."""
    status = F.coalesce(F.col("status"), F.lit("active"))
    return (
        F.when(F.col("valid_from") > valid_as_of, "not_yet_valid")
        .when(F.col("valid_to") <= valid_as_of, "no_longer_valid")
        .when(~status.isin(*CURRENT), "status")
        .when((status != "active") & F.col("valid_to").isNull(), "open_but_inactive")
        .when(F.col("expires_at") <= valid_as_of, "expired")
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Days, with fractions; timestamps without a zone count as UTC."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def recency(age_days: Column, scale: float = 30.0) -> Column:
    return 1.0 / (1.0 + F.greatest(age_days, F.lit(0.0)) / scale)


def half_life(age_days: Column, half_life_days: Column | float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def age_label(at: Column, now: Column) -> Column:
    """Hours up to two days, days up to a year, else the date."""
    hours = F.floor(days_between(now, at) * 24)
    return F.when(hours < 48, F.concat(hours.cast("string"), F.lit("h"))).when(hours < 365 * 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("d"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def expiry(scope: Column, importance: Column, observed_at: Column, valid_to: Column, short: Column) -> Column:
    """When a temporal fact expires: 3, 7 or 14 days by importance, a day if short-lived, never past ``valid_to``."""
    days = F.when(importance < 0.4, 3).when(importance <= 0.7, 7).otherwise(14)
    ttl = F.when(short, F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(days))
    return F.when(scope == "permanent", F.lit(None)).otherwise(F.least(observed_at + ttl, valid_to))

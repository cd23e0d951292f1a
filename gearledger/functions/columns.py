"""Scalar rental rules as Column expressions (no Python UDFs)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the business rules.
LATE_FEE_FACTOR = 1.5
EARTH_RADIUS_KM = 6371
NEAR_KM, MIDDLE_KM, FAR_KM = 5, 10, 20
NEAR_FEE, MIDDLE_FEE, FAR_FEE = 20000, 50000, 70000
PAYMENT_TERM_DAYS = 7

SECONDS_PER_DAY = 86400
# months_between counts a partial month in 31sts, so one month is 31 days of seconds.
SECONDS_PER_MONTH = 31 * SECONDS_PER_DAY
SECONDS_PER_YEAR = 12 * SECONDS_PER_MONTH
# Seconds late that cost one daily price.
SECONDS_PER_LATE_FEE = int(SECONDS_PER_DAY / LATE_FEE_FACTOR)

# A stored amount has ten digits, two of them decimals.
MONEY_LIMIT = 10**8


def clock(as_of: str | dt.datetime) -> Column:
    """The caller's clock as a zone-free timestamp literal."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def dec(value: str | int, precision: int, scale: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({precision},{scale})")


def money(column: Column) -> Column:
    """Round half away from zero to two decimals, as an assignment to a money column.

    The type is wider than a stored amount: one amount that does not fit must not stop a job
    over all of them. Where it would be stored, ``too_large`` turns it into a refusal.
    """
    return column.cast("decimal(20,2)")


def too_large(*amounts: Column) -> Column:
    """True if any amount has more digits than a stored one may have."""
    over = F.lit(False)
    for amount in amounts:
        over = over | F.coalesce(F.abs(amount) >= MONEY_LIMIT, F.lit(False))
    return over


def stored(amount: Column) -> Column:
    """The type of a stored amount, for amounts that passed ``too_large``."""
    return amount.cast("decimal(10,2)")


def line_total(quantity: Column, days: Column, price: Column) -> Column:
    return money(quantity.cast("decimal(10,0)") * days.cast("decimal(10,0)") * price)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def equipment_value(price: Column, rate: Column, purchased: Column, now: Column) -> Column:
    """Straight-line value: price - price * rate * years, floored at zero, two decimals.

    Elapsed time is the month difference counted in whole seconds, so the single division
    happens in DECIMAL and a half cent rounds the same way on every engine.
    """
    elapsed = F.round(F.months_between(now, purchased, False) * SECONDS_PER_MONTH)
    worn = (
        price.cast("decimal(10,2)")
        * rate.cast("decimal(5,2)")
        * elapsed.cast("decimal(12,0)")
        / dec(SECONDS_PER_YEAR, 8, 0)
    )
    value = price.cast("decimal(10,2)") - worn
    return F.when(value < 0, dec(0, 10, 2)).otherwise(money(value))


def unit_deposit(
    price: Column, rate: Column, purchased: Column, deposit_rate: Column, now: Column
) -> Column:
    """Deposit for one unit: rounded value times deposit rate; no rate means no deposit."""
    share = F.coalesce(deposit_rate, dec(0, 5, 2))
    return F.when(share == 0, dec(0, 10, 2)).otherwise(
        money(equipment_value(price, rate, purchased, now) * share)
    )


def late_fee(due: Column, last_return: Column, daily_base: Column) -> Column:
    """Unrounded late fee: fractional days late * daily price of all items * 1.5."""
    late = seconds_between(due, last_return)
    fee = (
        late.cast("decimal(10,0)")
        * F.coalesce(daily_base, F.lit(0)).cast("decimal(20,2)")
        / dec(SECONDS_PER_LATE_FEE, 5, 0)
    ).cast("decimal(30,8)")
    return F.when(late > 0, fee).otherwise(dec(0, 30, 8))


def damage_fee(condition: Column, percent: Column, quantity: Column, value: Column) -> Column:
    """Good costs nothing, lost the whole value, anything else the damaged share."""
    whole = value * F.coalesce(quantity, F.lit(1)).cast("decimal(5,0)")
    share = F.coalesce(percent, dec(0, 5, 2))
    return (
        F.when(condition == "GOOD", dec(0, 10, 2))
        .when(condition == "LOST", money(whole))
        .when(share == 0, dec(0, 10, 2))
        .otherwise(money(whole * share * dec("0.01", 3, 2)))
    )


def percent_of(amount: Column, rate: Column) -> Column:
    return money(amount * rate * dec("0.01", 3, 2))


def floor_zero(amount: Column) -> Column:
    return F.when(amount < 0, dec(0, 10, 2)).otherwise(amount)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines, two decimals; NULL when a coordinate is missing."""

    def angle(degrees: Column) -> Column:
        return degrees.cast("double") * math.pi / 180

    cosine = F.cos(angle(lat1)) * F.cos(angle(lat2)) * F.cos(angle(lon2 - lon1)) + F.sin(
        angle(lat1)
    ) * F.sin(angle(lat2))
    # least/greatest skip NULL, so test the coordinates before clamping.
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    clamped = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))
    return F.when(known, money(EARTH_RADIUS_KM * F.acos(clamped)))


def distance_fee(km: Column) -> Column:
    """Fee band of a distance; NULL beyond the last band."""
    return (
        F.when(km < NEAR_KM, dec(NEAR_FEE, 10, 2))
        .when(km < MIDDLE_KM, dec(MIDDLE_FEE, 10, 2))
        .when(km <= FAR_KM, dec(FAR_FEE, 10, 2))
    )


def code_text(prefix: str, number: Column, pad: int) -> Column:
    """Prefix and zero-padded number; a longer number is kept whole, never cut."""
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(digits, F.greatest(F.lit(pad), F.length(digits)), F.lit("0"))
    )


def said(column: Column) -> Column:
    """Text for concatenation: NULL joins as nothing."""
    return F.coalesce(column.cast("string"), F.lit(""))

"""Single-precision scalar functions as columns.

Every step rounds to 32 bits, as the results depend on it: a quotient of floats
is a double in Spark, so it is cast after each division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantisation range, and the scale of each feature.
SCALE = 10000
SENTINEL = -10000
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0

# Risk by merchant category; any other code has the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def quotient(num: Column, den: Column | float) -> Column:
    return (f32(num) / f32(den)).cast("float")


def quantize(v: Column) -> Column:
    """Float to an integer of SCALE steps: negatives to SENTINEL, 1 or more to SCALE, else half up."""
    v = f32(v)
    return F.when(v < f32(0), SENTINEL).otherwise((F.least(v, f32(1)) * f32(SCALE) + f32(0.5)).cast("int"))


def ratio(num: Column, den: Column) -> Column:
    return F.when(f32(den) > f32(0), quotient(num, den)).otherwise(f32(0))


def iso_valid(ts: Column) -> Column:
    """Whether the first 19 characters are a timestamp of an hour, minute and second in range; what follows is ignored."""
    return F.coalesce(ts.rlike(ISO), F.lit(False))


def iso_part(ts: Column, at: int, n: int = 2) -> Column:
    return F.substring(ts, at, n).try_cast("int")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the Gregorian calendar; months and days out of
    range run on into later ones. Counted from March, a year's days before month k
    are (153 k + 2) / 5."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    leaps = F.floor(year / F.lit(4)) - F.floor(year / F.lit(100)) + F.floor(year / F.lit(400))
    month = m + F.when(m > 2, -3).otherwise(9)
    return (year * 365 + leaps + F.floor((month * 153 + 2) / F.lit(5)) + d - 719469).cast("long")


def iso_days(ts: Column) -> Column:
    return days_from_civil(iso_part(ts, 1, 4), iso_part(ts, 6), iso_part(ts, 9))


def iso_seconds(ts: Column) -> Column:
    return iso_days(ts) * 86400 + iso_part(ts, 12) * 3600 + iso_part(ts, 15) * 60 + iso_part(ts, 18)


def weekday(days: Column) -> Column:
    """0 on Mondays."""
    return F.pmod(days + 3, F.lit(7)).cast("int")


def truncated(num: Column, den: int) -> Column:
    """Integer quotient, towards zero."""
    return F.when(num < 0, -F.floor(-num / F.lit(den))).otherwise(F.floor(num / F.lit(den))).cast("long")


def minutes_between(seconds: Column, before: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), truncated(seconds - before, 60))


def hour_step(hour: Column) -> Column:
    return F.floor((hour * SCALE + 11) / F.lit(23)).cast("int")


def weekday_step(day: Column) -> Column:
    return F.floor((day * SCALE + 3) / F.lit(6)).cast("int")


def mcc_risk(code: Column) -> Column:
    known = F.create_map(*[x for k, v in MCC_RISK.items() for x in (F.lit(k), f32(v))])
    return F.coalesce(F.try_element_at(known, code), f32(DEFAULT_RISK))

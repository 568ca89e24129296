"""Number, date, lease, storey and coordinate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthframe import constants as K


def lease_months(text: Column) -> Column:
    """"NN years [MM months]" to months; NULL when malformed or months exceed 11."""
    pattern = r"^\s*(\d+)\s+years?(?:\s+(\d+)\s+months?)?\s*$"
    years = F.regexp_extract(text, pattern, 1).try_cast("int")
    months = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern) & (months <= 11), years * 12 + months)


def storey_midpoint(text: Column) -> Column:
    """"LO TO HI" to its mean; NULL when malformed or reversed."""
    pattern = r"^\s*(\d+)\s+TO\s+(\d+)\s*$"
    low = F.regexp_extract(text, pattern, 1).try_cast("int")
    high = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(text.rlike(pattern) & (high >= low), (low + high) / 2.0)


def storey_band(floor: Column) -> Column:
    start = F.lit(1) + F.lit(3) * F.greatest(F.lit(0), F.floor((floor - 1) / 3))

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(start), F.lit(" TO "), two(start + 2))


def coordinate_reason(lat: Column, lon: Column) -> Column:
    """NULL for a good point, else missing / invalid / outside_bounds."""
    blank = (F.trim(F.coalesce(lat, F.lit(""))) == "") | (F.trim(F.coalesce(lon, F.lit(""))) == "")
    y, x = lat.try_cast("double"), lon.try_cast("double")
    inside = y.between(*K.LAT_BOUNDS) & x.between(*K.LON_BOUNDS)
    return F.when(blank, "missing").when(y.isNull() | x.isNull(), "invalid").when(~inside, "outside_bounds")


def sniff_coordinate(text: Column) -> Column:
    """struct(latitude, longitude, order) of the first number pair inside the bounds."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)),
                          lambda x: x.cast("double"))
    half = F.floor(F.size(numbers) / 2).cast("int")
    pairs = F.when(half > 0, F.transform(
        F.sequence(F.lit(0), half - 1),
        lambda i: F.struct(F.element_at(numbers, (i * 2 + 1).cast("int")).alias("a"),
                           F.element_at(numbers, (i * 2 + 2).cast("int")).alias("b"))))

    def is_lat(c: Column) -> Column:
        return c.between(*K.LAT_BOUNDS)

    def is_lon(c: Column) -> Column:
        return c.between(*K.LON_BOUNDS)
    good = F.filter(pairs, lambda p: (is_lon(p["a"]) & is_lat(p["b"])) | (is_lat(p["a"]) & is_lon(p["b"])))
    first = F.try_element_at(good, F.lit(1))
    lon_first = is_lon(first["a"]) & is_lat(first["b"])
    return F.when(first.isNotNull(), F.struct(
        F.when(lon_first, first["b"]).otherwise(first["a"]).alias("latitude"),
        F.when(lon_first, first["a"]).otherwise(first["b"]).alias("longitude"),
        F.when(lon_first, "longitude_latitude").otherwise("latitude_longitude").alias("order")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    a = s1 * s1 + F.cos(a1) * F.cos(a2) * s2 * s2
    return F.lit(K.EARTH_DIAMETER_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_gap_to_horizon(start: Column, end: Column, years: Column) -> Column:
    """Calendar months between two dates, minus the horizon, without sign."""
    return F.abs(month_number(end) - month_number(start) - years * 12)


def parse_month(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))


def parse_utc(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def remaining_lease(given_years: Column, commence_year: Column, valuation_month: Column) -> Column:
    """Months left on a 99-year lease; NULL outside (0, 1188]."""
    months = F.coalesce(
        F.bround(given_years * 12).cast("int"),
        (F.lit(K.LEASE_TERM_MONTHS) - (month_number(valuation_month) - (commence_year * 12 + 1))).cast("int"))
    return F.when((months > 0) & (months <= K.LEASE_TERM_MONTHS), months)


def lease_band(months: Column) -> Column:
    out = None
    for limit, label in K.LEASE_BANDS:
        out = F.when(months < limit, label) if out is None else out.when(months < limit, label)
    return out.otherwise(K.LEASE_BAND_TOP)


def quartile_band(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(value <= q1, "Q1").when(value <= q2, "Q2").when(value <= q3, "Q3").otherwise("Q4")


def count_band(n: Column) -> Column:
    return F.when(n < 5, "<5").when(n < 20, "5-19").otherwise("20+")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """NULL stays NULL (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def unit_price(price: Column, area: Column) -> Column:
    return F.try_divide(price, F.nullif(area, F.lit(0.0)))


def month_angle(month: Column) -> tuple[Column, Column]:
    turn = month * F.lit(2 * math.pi) / 12
    return F.sin(turn), F.cos(turn)


def annuity(principal: Column, annual_rate: Column, years: Column) -> Column:
    """Fixed-rate monthly payment; straight division at zero rate, 0 for no loan."""
    periods = (years * 12).cast("double")
    rate = annual_rate.cast("double") / 12
    p = principal.cast("double")
    compound = F.try_divide(p * rate, F.lit(1.0) - F.pow(F.lit(1.0) + rate, -periods))
    return F.when((p == 0) | (periods <= 0), F.lit(0.0)).when(rate == 0, F.try_divide(p, periods)).otherwise(compound)


def exact_mean(column: str, places: int = 2) -> Column:
    """Mean through an exact decimal sum, so the result does not depend on row order."""
    return (F.sum(F.col(column).cast(f"decimal(18,{places})")).cast("double") / F.count(column))

"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mean days per calendar month used for annual totals.
DAYS_PER_MONTH = [31.0, 28.25, 31.0, 30.0, 31.0, 30.0, 31.0, 31.0, 30.0, 31.0, 30.0, 31.0]


def bin_left(x: Column, start: float, width: float, n: int, include_lowest: bool = False) -> Column:
    """Left edge of the right-closed bin holding `x`; null outside and on the lowest edge."""
    b = F.ceil((x - F.lit(float(start))) / F.lit(float(width))) - 1
    if include_lowest:
        b = F.when(x == F.lit(float(start)), F.lit(0)).otherwise(b)
    return F.when((b >= 0) & (b < n), F.lit(float(start)) + b * F.lit(float(width)))


def bin_coordinates(
    lat: Column, lon: Column, depth: Column, include_lowest: bool = False
) -> dict[str, Column]:
    """The 1 degree x 1 degree x 5 m grid."""
    return {
        "lat": bin_left(lat, -90, 1, 180, include_lowest),
        "lon": bin_left(lon, -180, 1, 360, include_lowest),
        "depth": bin_left(depth, 0, 5, 41, include_lowest),
    }


def presence(y: Column) -> Column:
    """Predicate: the target was observed and is not zero."""
    return y != F.lit(0.0)


def presence_label(y: Column) -> Column:
    """1 where the target is present, 0 where absent, null where unknown."""
    return F.when(y.isNotNull(), (y != F.lit(0.0)).cast("int"))


def sentinel_to_null(c: Column, value) -> Column:
    return F.nullif(c, F.lit(value))


def band_difference(a: Column, b: Column) -> Column:
    return a - b


def standard_error(sd: Column, n: int) -> Column:
    return sd / F.sqrt(F.lit(float(n)))


def log_forward(y: Column) -> Column:
    return F.log1p(y)


def log_inverse(y: Column) -> Column:
    return F.expm1(y)


def ln_or_minus_inf(x: Column) -> Column:
    """Natural log with ln(0) = -inf (Spark's ln(0) is null)."""
    return F.when(x == F.lit(0.0), F.lit(float("-inf"))).otherwise(F.ln(x))


def log10_plus_one(x: Column) -> Column:
    return F.log10(x + F.lit(1.0))


def month_of(c: Column, fmt: str | None = None) -> Column:
    """Month 1..12 of a date, a timestamp, or of text in the given pattern."""
    return F.month(F.to_date(c, fmt) if fmt else c)


def year_of(c: Column, fmt: str | None = None) -> Column:
    return F.year(F.to_date(c, fmt) if fmt else c)


def month_from_days(days: Column, origin: str = "0001-01-01") -> Column:
    """Month of a 'days since <origin>' time axis."""
    return F.month(F.date_add(F.lit(origin).cast("date"), days.cast("int")))


def days_in_month(month: Column) -> Column:
    """Mean number of days of month 1..12."""
    days = F.array(*[F.lit(d) for d in DAYS_PER_MONTH])
    return F.get(days, month.cast("int") - 1)


def target_id(name: Column) -> Column:
    """Target name usable as a path or partition value."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def abbreviate_species(name: Column) -> Column:
    """'Emiliania huxleyi' -> 'E. huxleyi'; one word stays as it is."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    first = F.upper(F.substring(F.get(words, F.lit(0)), 1, 1))
    return F.when(F.size(words) <= 1, name).otherwise(F.concat(first, F.lit(". "), rest))

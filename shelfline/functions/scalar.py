"""Column helpers with the rounding and null rules that all reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, digits: int) -> Column:
    """top / bottom rounded half to even; 0 where the bottom is not positive."""
    return F.coalesce(ratio_or_null(top, bottom, digits), F.lit(0.0))


def ratio_or_null(top: Column, bottom: Column, digits: int) -> Column:
    return F.when(bottom > 0, F.bround(top / bottom, digits))


def money(cents: Column) -> Column:
    return cents / F.lit(100.0)


def week_ending_sunday(day: Column) -> Column:
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def normalised_name(name: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "")


def age_bucket(days: Column) -> Column:
    """Right-closed buckets."""
    return F.when(days <= 7, "0-7").when(days <= 14, "8-14").when(days <= 30, "15-30").otherwise("30+")


AGE_BUCKETS = ("0-7", "8-14", "15-30", "30+")


def parsed_int(text: Column) -> Column:
    """Integers with thousands commas and decimals, half to even; blank, nan, none and - are null."""
    clean = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~F.lower(clean).isin("", "nan", "none", "-"), F.bround(clean.try_cast("double"), 0).cast("long"))


def parsed_date(text: Column) -> Column:
    """The first thing in a text that looks like a date: day, month, year with / or -, month first where only that fits, or
    year first. Two-digit years count with / only, from 69 on in the last century."""
    token = F.regexp_extract(text, r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}", 0)
    piece = lambda pattern, i: F.regexp_extract(token, pattern, i).try_cast("int")

    def made(pattern: str, year: int, month: int, day: int) -> Column:
        y = piece(pattern, year)
        y = F.when(F.length(F.regexp_extract(token, pattern, year)) == 2, y + F.when(y >= 69, 1900).otherwise(2000)).otherwise(y)
        parts = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), *(F.lpad(piece(pattern, i).cast("string"), 2, "0") for i in (month, day)))
        return F.when(y.isNotNull(), F.try_to_date(parts, "yyyy-MM-dd"))

    slashed, dashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    return F.coalesce(made(slashed, 3, 2, 1), made(dashed, 3, 2, 1), made(r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3, 2, 1), made(slashed, 3, 1, 2), made(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3))


#: Normal quantiles by level, one table for order levels and one for forecast bands.
Z_ORDERS = {0.90: 1.2816, 0.95: 1.6449, 0.975: 1.9600, 0.99: 2.3263}
Z_BANDS = {0.80: 0.84, 0.90: 1.28, 0.95: 1.645, 0.975: 1.96, 0.99: 2.33}


def z_score(level: Column, table: dict[float, float]) -> Column:
    """The table's quantile for a level rounded to three digits; levels that it doesn't have, and null, count as 0.95."""
    found = F.lit(table[0.95])
    for known, z in table.items():
        found = F.when(F.bround(level, 3) == known, z).otherwise(found)
    return found

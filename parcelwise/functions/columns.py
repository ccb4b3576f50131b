"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Whitespace as Python's str.strip and str.split see it; Java's \s is ASCII only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
    "       　"
)
SPACE = r"(?U)[\s\x1c-\x1f]"

MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]
# A time of day with fraction and zone after a date; it does not change the date as written.
CLOCK = r"(?:(?:T|\s+)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """One double division of two exact numbers."""
    return numerator.cast("double") / denominator.cast("double")


def at_least_one(column: Column) -> Column:
    return F.greatest(column, F.lit(1).cast("bigint"))


def yes(condition: Column) -> Column:
    """0/1 flag; unknown counts as no."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def money(column: Column) -> Column:
    """Amounts as whole ten-thousandths, so that sums do not depend on row order."""
    return F.round(column * 10000).cast("bigint")


def from_money(column: Column) -> Column:
    return ratio(column, F.lit(10000))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), f"{SPACE}+"), lambda t: t != "")


def blank_to_null(column: Column) -> Column:
    return F.nullif(strip(column), F.lit(""))


def parse_date(column: Column) -> Column:
    """Date from text in mixed forms, null when none fits.

    Year first; else month first, and day first only where the month is impossible; or
    with the month's name. A time, fraction or zone may follow and is dropped.
    """
    # Bound as a lambda variable, so that the text is computed once for all forms.
    return F.transform(F.array(strip(column.cast("string"))), _date_of)[0]


def _date_of(text: Column) -> Column:
    def found(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(text, "(?i)" + pattern + CLOCK, i), F.lit(""))
        number = part(month).cast("int")
        if named:
            name = F.lower(part(month))
            places = [F.array_position(F.lit(m), name) for m in (MONTHS, [m[:3] for m in MONTHS])]
            number = F.greatest(*places).cast("int")
        clock = [F.lit(0), F.lit(0), F.lit(0)]
        return F.try_make_timestamp(part(year).cast("int"), number, part(day).cast("int"), *clock).cast("date")

    two_first = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})"
    return F.coalesce(
        found(r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", 1, 3, 4),
        found(r"^(\d{4})(\d{2})(\d{2})", 1, 2, 3),
        found(two_first, 4, 1, 3),
        found(two_first, 4, 3, 1),
        found(r"^([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})", 3, 1, 2, named=True),
        found(r"^(\d{1,2})[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4})", 3, 2, 1, named=True),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares as the largest number in Spark; missing values must not."""
    floats = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def sigmoid(column: Column) -> Column:
    bounded = F.greatest(F.least(-column, F.lit(50.0)), F.lit(-50.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(bounded))


def fixed_text(column: Column, digits: int) -> Column:
    """A double with `digits` decimals: its exact binary value is rounded, ties to even.

    Below 1024 the value is a whole number of small powers of two, so whole-number
    arithmetic decides; larger values are rounded on their shortest decimals.
    """
    x = column.cast("double")
    size = F.abs(x)
    bits = F.when(size < 0.25, 64).when(size < 1, 62).otherwise(53)
    units = F.floor(F.when(size < 1024, size) * F.pow(F.lit(2.0), bits)).cast("bigint")
    scaled = (units.cast("decimal(20,0)") * F.lit(10**digits)).cast("decimal(38,0)")
    one = F.pow(F.lit(2.0), bits - 30).cast("bigint").cast("decimal(12,0)") * F.lit(2**30).cast("decimal(10,0)")
    one = one.cast("decimal(20,0)")
    whole = F.floor(scaled / one).cast("bigint")
    rest = (scaled - (whole.cast("decimal(20,0)") * one).cast("decimal(38,0)")).cast("decimal(38,0)")
    up = (rest * 2 > one) | ((rest * 2 == one) & (whole % 2 == 1))
    near = (whole + F.when(up, 1).otherwise(0)).cast("decimal(20,0)") / F.lit(10**digits)
    signed = F.when(x < 0, -near).otherwise(near).cast(f"decimal(30,{digits})")
    exact = signed.cast("string")
    return F.when(F.abs(x) < 1024, exact).otherwise(F.format_string(f"%.{digits}f", F.bround(x, digits)))


def percent_text(column: Column, digits: int = 1) -> Column:
    return F.concat(fixed_text(column.cast("double") * 100, digits), F.lit("%"))


def yes_no(column: Column) -> Column:
    return F.when(yes(column.cast("double") != 0) == 1, "Yes").otherwise("No")


def or_na(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("N/A"))

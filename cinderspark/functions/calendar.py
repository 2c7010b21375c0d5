"""Calendar expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month ranges of the observation seasons, both ends included.
SEASONS = {"temperature": (2, 6), "reflectance": (3, 5), "reflectance_complete": (1, 6)}


def day_number(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(day)


def day_of_year_text(day: Column) -> Column:
    return F.lpad(F.dayofyear(day).cast("string"), 3, "0")


def date_from_day_of_year(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)


def month_starts(year: Column, first: int, last: int) -> Column:
    """Array of first days of the months of a season."""
    return F.sequence(
        F.make_date(year, F.lit(first), F.lit(1)), F.make_date(year, F.lit(last), F.lit(1)), F.expr("interval 1 month")
    )


def season_days(year: Column, first: int, last: int) -> Column:
    """Array of every day from the first day of ``first`` to the last day of ``last``."""
    return F.sequence(
        F.make_date(year, F.lit(first), F.lit(1)),
        F.last_day(F.make_date(year, F.lit(last), F.lit(1))),
        F.expr("interval 1 day"),
    )


def season_label(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when(month.between(3, 6), "Dry").when(month.between(7, 9), "Wet").otherwise("Post-monsoon")
    )

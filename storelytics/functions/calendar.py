"""Calendar keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_week(moment: Column) -> Column:
    """Week key year*100 + week, weeks starting on Sunday and counted from the year's first Sunday.

    Days before that Sunday belong to the last week of the year before, so everything follows from
    the Sunday that opens the day's week.
    """
    day = F.to_date(moment)
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    return (F.year(sunday) * 100 + F.ceil(F.dayofyear(sunday) / 7)).cast("int")


def month_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")

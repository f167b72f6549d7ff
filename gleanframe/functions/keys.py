"""Spelling of reference keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.timestamps import trim_space

#: Fixed value: the sentinel written in place of a post id when nothing was posted.
DRY_RUN = "DRYRUN"


def real_key(c: Column) -> Column:
    """``c`` without outer white space; null for null, empty and sentinel keys."""
    k = trim_space(c)
    return F.when((k != "") & (k != DRY_RUN), k)


def month_number(ts: Column) -> Column:
    """Months since year 0 of a timestamp, as int."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_text(m: Column) -> Column:
    """``yyyy-MM`` of a month number."""
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"))

"""Text and number helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


#: White space as Unicode has it, which is what ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` takes only U+0020); only the ends are looked at."""
    return F.btrim(col(c), F.lit(WHITE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named: Spark repeats it in the branches of a CASE."""
    return F.transform(F.array(value), use)[0]


def words(c: Column | str) -> Column:
    """The number of white-space separated words."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def has(c: Column | str, pattern: str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(pattern)


def mround(c: Column | str, digits: int = 2) -> Column:
    """Half-even rounding of a decimal, the same in every engine."""
    return F.bround(col(c).cast("decimal(12,3)"), digits).cast("decimal(10,2)")


def lit_list(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def ordered(value: Column | str, *order: str) -> Column:
    """An aggregate: the non-null values, in order."""
    pairs = F.collect_list(F.when(col(value).isNotNull(), F.struct(*order, col(value).alias("value"))))
    return F.transform(F.array_sort(pairs), lambda p: p["value"])

"""Exact answers from values known only within bounds; dates, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_bounds(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Between which bounds a - b lies; null if a bound is missing. Decimals stay exact."""
    return F.struct((lo_a - hi_b).alias("low"), (hi_a - lo_b).alias("high"))


def order_of(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """before, after or same where that is certain, else null."""
    return F.when(hi_a < lo_b, "before").when(lo_a > hi_b, "after").when((lo_a == hi_a) & (lo_b == hi_b) & (lo_a == lo_b), "same")


def elapsed_months(a: Column, b: Column) -> Column:
    """Calendar months from the month of a to the month of b."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def is_full_month(start: Column, end: Column) -> Column:
    """Whether [start, end] are the first and last day of one month."""
    return (F.trunc(start, "MM") == start) & (F.last_day(start) == end)


def local_midnight_after(ts: Column, zone: str) -> Column:
    """The next midnight of a time zone after an instant."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1).cast("timestamp"), zone)


def at_least(distinct: Column, complete: Column) -> Column:
    """A count as text that says so where it is only a lower bound."""
    return F.when(complete, distinct.cast("string")).otherwise(F.concat(F.lit("at least "), distinct.cast("string")))


def named_uuid(name: Column, namespace: bytes = bytes.fromhex("6ba7b8119dad11d180b400c04fd430c8")) -> Column:
    """The version-5 UUID of a name in a namespace (fixed value: that of URLs)."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def priced(units: Column, price: Column) -> Column:
    """Units times a price a million, in whole micro-units, rounded up."""
    return F.ceil(units.cast("decimal(20,0)") * price.cast("decimal(18,6)"))

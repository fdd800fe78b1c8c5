"""Instants as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: No end, as a number that sorts after every instant.
NO_END = 2**63 - 1
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a naive (UTC) timestamp, in a session of any time zone; null for null."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(ts.cast("timestamp"))
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * DAY_US + seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")

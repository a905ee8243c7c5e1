"""Time arithmetic on TIMESTAMP_NTZ columns.

Everything here is independent of the session time zone: ``date_trunc`` and
``unix_micros`` go through TIMESTAMP and would not be.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def micros(c) -> Column:
    """Microseconds since 1970-01-01 as an exact bigint.

    In a UTC session a cast does it. Elsewhere the cast would shift or merge
    local times around clock changes, so the parts are added up instead.
    """
    c = _col(c)
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC:
        return F.unix_micros(c.cast("timestamp"))
    second = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return (F.unix_date(c.cast("date")).cast("bigint") * F.lit(DAY_US)
            + F.hour(c).cast("bigint") * F.lit(HOUR_US)
            + F.minute(c).cast("bigint") * F.lit(60_000_000) + second)


def hours(n: int) -> Column:
    """Interval literal of ``n`` hours."""
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def hour_floor(c) -> Column:
    """Truncate to the start of the hour, staying TIMESTAMP_NTZ."""
    c = _col(c)
    return c.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(c))


def floor_div(x: Column, n: int) -> Column:
    """Floor of an integer quotient, right for negative ``x`` too."""
    return ((x - F.pmod(x, F.lit(n).cast("bigint"))) / F.lit(n)).cast("bigint")


def ceil_div(x: Column, n: int) -> Column:
    return -floor_div(-x, n)


def hour_boundaries(start, end) -> Column:
    """Number of full-hour marks crossed from ``start`` to ``end`` (signed)."""
    return floor_div(micros(end), HOUR_US) - floor_div(micros(start), HOUR_US)

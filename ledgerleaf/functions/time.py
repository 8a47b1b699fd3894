"""Time without a session's zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), c)
    return (days * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000 + (seconds * 1_000_000).cast("long")


def effective_ns(epoch: Column, nanos: Column, priority_ms: Column) -> Column:
    """A transaction's effective time: seconds, nanoseconds and a priority in milliseconds on one scale."""
    wide = "decimal(38,0)"
    return (epoch.cast(wide) * 1_000_000_000 + nanos.cast(wide) + priority_ms.cast(wide) * 1_000_000).cast(wide)


def age_us(ts: str | Column, now_us: int | Column) -> Column:
    return (now_us if isinstance(now_us, Column) else F.lit(now_us)) - epoch_us(ts)


def iso_name(ts: str | Column) -> Column:
    """ISO date and time with ``_`` for ``:``, as in names of log files."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH_mm_ss")

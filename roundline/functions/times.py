"""Time texts and seconds from the start of a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds of ``S``, ``M:SS`` or ``H:MM:SS``; anything else is null."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(F.trim(p).rlike(r"^[+-]?\d+$"), F.trim(p).try_cast("bigint")))
    whole = F.forall(parts, lambda p: p.isNotNull())
    value = F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, parts[0] * 60 + F.get(parts, F.lit(1))).when(F.size(parts) == 3, parts[0] * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2)))
    return F.when(whole, value).cast("double")


def mss(seconds: Column) -> Column:
    """``M:SS``, cut to whole seconds, minutes without bound."""
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d", (s / 60).cast("bigint"), s % 60)


def mss_hundredths(seconds: Column) -> Column:
    """``M:SS.ss``: whole minutes and seconds with two decimals."""
    m = F.floor(seconds / 60)
    return F.concat(m.cast("string"), F.lit(":"), F.lpad(F.format_string("%.2f", seconds - m * 60), 5, "0"))


def hms(seconds: Column, pattern: str = "%d:%02d:%02d") -> Column:
    """Hours, minutes and seconds of the half-even rounded seconds."""
    s = F.bround(seconds, 0).cast("bigint")
    return F.format_string(pattern, (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def stride_step(fps: Column | float, scan_fps: Column | float) -> Column:
    """Frames between two samples: at least 1, rounded half to even."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(F.lit(fps) / F.lit(scan_fps), 0).cast("bigint"))

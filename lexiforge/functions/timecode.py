"""Time stamps of transcripts, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(stamp: Column) -> Column:
    """``H:M:S(.f)``, ``M:S`` or a number as seconds; 0.0 for anything else."""
    p = F.split(F.trim(stamp), ":")
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    n = F.size(p)
    value = F.when(n == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(n == 2, at(1) * 60 + at(2)).when(n == 1, at(1))
    return F.coalesce(value, F.lit(0.0))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, milliseconds rounded."""
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long"), seconds % 60)


def stamp(seconds: Column, separator: str = ",") -> Column:
    """Subtitle stamp, milliseconds cut off."""
    whole = F.floor(seconds).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"),
                           whole % 60, F.floor((seconds - whole) * 1000).cast("long"))


def duration(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``; seconds rounded half to even."""
    t = F.bround(seconds, 0).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor((t % 3600) / 60).cast("long"), t % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def year_of(date: Column) -> Column:
    """The first four characters."""
    return F.substring(date, 1, 4)


def shifted(start: Column, sample: Column, rate: int = 16000) -> Column:
    """a segment's time moved by the sample at which its piece starts."""
    return start + sample / rate

"""Clock strings, durations and recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def m_ss(seconds: Column) -> Column:
    """Minutes without bound, two-digit seconds: 75 -> 1:15."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def parse_m_ss(c: Column) -> Column:
    """Seconds of m:ss; null if it isn't one."""
    m, s = F.regexp_extract(c, r"^(\d+):(\d{1,2})$", 1), F.regexp_extract(c, r"^(\d+):(\d{1,2})$", 2)
    return F.when(m != "", m.try_cast("long") * 60 + s.try_cast("long"))


def h_mm_ss(seconds: Column) -> Column:
    """With an hour part only where there is one."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def hh_mm_ss(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; null is 00:00:00."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h = F.floor(s / 3600).cast("long")
    return F.concat(F.when(h < 100, two(h)).otherwise(h.cast("string")), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def cue_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of a subtitle cue (mark '.' for VTT); hours don't wrap at a day."""
    ms = F.floor(seconds * 1000 + 1e-6).cast("long")
    return F.concat(hh_mm_ss(F.floor(ms / 1000)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_cue_time(c: Column) -> Column:
    """Seconds of H:MM:SS.mmm or MM:SS.mmm with either mark; null if it is neither."""
    rx = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(c, rx, i).try_cast("double"), F.lit(0.0))
    milli = F.rpad(F.regexp_extract(c, rx, 4), 3, "0").try_cast("double")
    return F.when(c.rlike(rx), part(1) * 3600 + part(2) * 60 + part(3) + milli / 1000)


def iso_duration(c: Column) -> Column:
    """Seconds of PT#H#M#S; null if it isn't one."""
    rx = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, rx, i).try_cast("long"), F.lit(0))
    return F.when(c.rlike(rx), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def years_before(published: Column, as_of: Column) -> Column:
    """Years of 365 days."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(1e6 * 365 * 86400)


def recency_boosted(similarity: Column, published: Column, source_type: Column, as_of: Column) -> Column:
    """The similarity's size times 1 plus 0.10 within a year or 0.05 within two, plus 0.05 for youtube, at most 1. Without a date only the kind counts."""
    y = years_before(published, as_of)
    boost = F.when(y <= 1, 0.10).when(y <= 2, 0.05).otherwise(0.0) + F.when(source_type == "youtube", 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.abs(similarity) * (1.0 + boost))

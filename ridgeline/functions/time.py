"""Dates and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import fixed


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn")


def time_of_day(ts: Column) -> Column:
    """Null by day, when the hour says nothing."""
    h = F.hour(ts)
    return F.when((h < 6) | (h >= 21), "night").when(h < 9, "early morning").when(h >= 18, "evening")


def filename_datetime(name: Column) -> Column:
    """The moment that a file name carries, midnight if it has only a date; null if there is none or the calendar has no such day."""
    part = lambda i: F.regexp_extract(name, fixed.FILENAME_DATE, i)
    two = lambda i: F.when(part(i) == "", "00").otherwise(part(i))
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6))
    return F.when(part(1) != "", text).try_cast("timestamp_ntz")


#: Year, sign, month, day, hour and minute, seconds.
EXIF_FORM = r"^(\d{4})([:-])(\d{2})[:-](\d{2}) (\d{2}:\d{2})(:\d{2})?$"


def exif_datetime(raw: Column) -> Column:
    """One of three written forms; NULs and white space at either end are cut, year zero is null."""
    clean = F.regexp_replace(raw, r"^[\s\x00]+|[\s\x00]+$", "")
    shaped = F.regexp_replace(clean, EXIF_FORM, "$1-$3-$4 $5$6")
    same = F.substring(clean, 5, 1) == F.substring(clean, 8, 1)
    return F.when(clean.rlike(EXIF_FORM) & same & ~clean.startswith("0000"), shaped).try_cast("timestamp_ntz")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds between two zoneless moments, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def gap_label(seconds: Column) -> Column:
    """Tenths of hours below two days, tenths of days below sixty, else whole days; exact halves are rounded up."""
    tenths = lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    whole = lambda unit: F.round(seconds / unit).cast("bigint")
    return F.when(seconds < 48 * 3600, F.concat(tenths(whole(360.0)), F.lit("h"))).when(seconds < 60 * 86400, F.concat(tenths(whole(8640.0)), F.lit(" days"))).otherwise(F.concat(whole(86400.0).cast("string"), F.lit(" days")))


def iso_text(ts: Column) -> Column:
    """ISO form of a zoneless moment; microseconds only if there are any."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == 0, "").otherwise(F.date_format(ts, ".SSSSSS")))


def span_days(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 86400


def date_range(start: Column, end: Column) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.when(start.isNull(), "no date").when(day(start) == day(end), day(start)).otherwise(F.concat(day(start), F.lit(" to "), day(end)))

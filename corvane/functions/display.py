"""How values are shown, and the re-extraction rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_key(key: Column, most: int = 16) -> Column:
    """The first and last `most / 2` characters of a longer key, three dots between."""
    half = most // 2
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.substring(key, 1, half), F.lit("..."), F.right(key, F.lit(half))))


def size_text(size: Column) -> Column:
    mb = F.format_string("%.1f MB", size / F.lit(1024 * 1024))
    kb = F.concat(F.shiftright(size.cast("long"), 10).cast("string"), F.lit(" KB"))
    return F.when(size.isNull(), F.lit(None)).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb).otherwise(mb)


def date_text(seconds: Column) -> Column:
    return F.when(seconds == 0, "—").otherwise(F.date_format(F.timestamp_seconds(seconds), "MMM d yyyy"))


def count_text(n: Column, one: str, several: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(several))


def relative_time(seconds: Column, now: Column) -> Column:
    """Seconds, minutes, hours or days ago; times ahead of now count as now."""
    ago = F.greatest(now - seconds, F.lit(0)).cast("long")
    unit = lambda n, u: F.concat(F.floor(ago / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(ago < 60, unit(1, "s")).when(ago < 3600, unit(60, "m")).when(ago < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def hex_decode(text: Column) -> Column:
    """binary; null unless the text has an even number of hexadecimal digits."""
    return F.when((F.length(text) % 2 == 0) & text.rlike("^[0-9a-fA-F]*$"), F.unhex(text))


def needs_extraction(title: Column, description: Column, version: Column, cached_version: Column) -> Column:
    """Metadata is missing, or a version is known that isn't the cached one."""
    return title.isNull() | description.isNull() | (version.isNotNull() & ~version.eqNullSafe(cached_version))

"""Time functions: epoch grid, civil rendering, window identifiers, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(x: Column) -> Column:
    """RFC 3339 text as a timestamp; text without a zone is UTC (the session's zone must be UTC)."""
    return F.to_timestamp(x)


def iso(ts: Column, zulu: bool = True) -> Column:
    """The UTC spelling with Z or +00:00; microseconds only where there are any."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(base, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("Z" if zulu else "+00:00"))


def window_id(stop: Column) -> Column:
    """The identifier that a window's end gives it."""
    return F.date_format(stop, "'w'yyyyMMdd'T'HHmmss'Z'")


def span_seconds(start: Column, stop: Column) -> Column:
    """Seconds from start to stop, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(stop) - F.unix_micros(start)) / 1e6)


def next_floor(seconds: Column, floor: int) -> Column:
    """The first multiple of ``floor`` strictly after a time in seconds."""
    return (F.floor(seconds / floor) + 1) * floor


def civil(df: DataFrame, ts: str, zone: str, zones: DataFrame, home: str) -> DataFrame:
    """``local``: the civil time in the row's own zone if it is known, else in the home zone (no second try).

    ``zones``: the known zone names, one column ``zone``, a bounded list; unknown names would make the conversion fail.
    """
    known = F.broadcast(zones.select(F.col("zone").alias("_z")))
    ok = df.join(known, F.col(zone) == F.col("_z"), "left")
    return ok.withColumn("local", F.from_utc_timestamp(ts, F.coalesce("_z", F.lit(home)))).drop("_z")


def local_day(day: Column, zone: str) -> tuple[Column, Column]:
    """The UTC window [start, stop) of a civil day; a day of changed clocks has 23 or 25 hours."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def clamped(start: Column, stop: Column, offset_a: Column, offset_b: Column) -> tuple[Column, Column]:
    """Offsets within a span, clamped into it and lifted to absolute seconds."""
    a = F.greatest(F.lit(0.0), F.least(offset_a, stop - start))
    return start + a, start + F.greatest(a, F.least(offset_b, stop - start))

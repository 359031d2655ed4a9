"""Time text, frames and sample positions as column expressions. Times are BIGINT milliseconds unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SRT = r"^\s*(\d+):(\d+):(\d+)(?:,(\d{3}))?\s*$"


def parse_srt(text: Column) -> Column:
    """`h:m:s[,fff]` to milliseconds; null if it doesn't match."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _SRT, i), F.lit("")), F.lit("0")).cast("long")
    return F.when(text.rlike(_SRT), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def format_srt(ms: Column) -> Column:
    """`HH:MM:SS,mmm` with hours modulo 24."""
    return _clock(ms, ",", wrap=True)


def format_chapter(ms: Column) -> Column:
    """`hh:mm:ss.fff`."""
    return _clock(ms, ".", wrap=True)


def _clock(ms: Column, dot: str, wrap: bool) -> Column:
    whole = F.floor(ms / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(whole / 3600).cast("long")
    hours = hours % 24 if wrap else hours
    return F.concat(two(hours), F.lit(":"), two(F.floor(whole / 60).cast("long") % 60), F.lit(":"), two(whole % 60), F.lit(dot), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_flexible(text: Column) -> Column:
    """Milliseconds of `[[h:]m:]s[.f[f[f]]]`; one zero of a leading `000` is dropped; null if none fits.

    Parts have at most two digits, minutes and seconds are under 60 and hours under 24."""
    t = F.when(text.startswith("000"), F.substring(text, 2, 1 << 30)).otherwise(text)
    shape = r"^(?:(?:(\d{1,2}):)?(\d{1,2}):)?(\d{1,2})(?:\.(\d{1,3}))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, shape, i), F.lit("")), F.lit("0")).cast("long")
    frac = F.rpad(F.regexp_extract(t, shape, 4), 3, "0").cast("long")
    ok = t.rlike(shape) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    return F.when(ok, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + frac)


def chapter_time(text: Column) -> Column:
    """`hh:mm:ss.fff` to milliseconds, 0 where it can't be parsed."""
    return F.coalesce(parse_flexible(text), F.lit(0))


def trim_display(text: Column) -> Column:
    """A displayed time without its last four digits."""
    return F.regexp_replace(text, r"\d{4}$", "")


def frame_of(seconds: Column, fps: float) -> Column:
    """Frame number by half-even rounding."""
    return F.bround(seconds / (1.0 / fps), 0).cast("long")


def snap_up(ms: Column, fps: float) -> Column:
    """The first frame boundary at or after a time, in milliseconds."""
    return F.floor(F.ceil(ms * fps / 1000.0) * 1000.0 / fps).cast("long")


def snap_near(ms: Column, fps: float) -> Column:
    """The nearest frame boundary, half to even, in milliseconds."""
    return F.floor(F.bround(ms * fps / 1000.0, 0) * 1000.0 / fps).cast("long")


def pcm_bytes(seconds: Column, rate: int) -> Column:
    """Byte position of a time in 16-bit mono PCM, truncated to a sample."""
    return (seconds * rate).cast("long") * 2

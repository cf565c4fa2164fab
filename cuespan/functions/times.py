"""Time stamps as integer milliseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespan import constants as K

_STRICT = r"^(\d{2,}):(\d{2}):(\d{2}),(\d{3})$"
_LOOSE = r"^\s*(?:(\d{1,9}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*"


def _assemble(h: Column, m: Column, s: Column, ms: Column) -> Column:
    h, m, s, ms = (c.cast("bigint") for c in (h, m, s, ms))
    return F.when((m <= 59) & (s <= 59), ((h * 60 + m) * 60 + s) * 1000 + ms)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    return F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, 5)])


def srt_ms(stamp: Column) -> Column:
    """``HH:MM:SS,mmm`` only; anything else is null."""
    def parse(t: Column) -> Column:
        usable = (F.length(t) <= K.MAX_STAMP_CHARS) & t.rlike(_STRICT)
        return F.when(usable, bind(_parts(t, _STRICT), lambda p: F.when(
            F.length(p[0]) <= K.MAX_HOUR_DIGITS, _assemble(*[F.get(p, F.lit(i)) for i in range(4)]))))

    return bind(F.regexp_replace(stamp, r"(?U)^\s+|\s+$", ""), parse)


def loose_ms(stamp: Column, full_match: bool = False) -> Column:
    """Optional hours, comma or point, one to three digits of milliseconds."""
    pattern = _LOOSE + ("$" if full_match else "")

    def parse(t: Column) -> Column:
        def whole(p: Column) -> Column:
            h, m, s, ms = (F.get(p, F.lit(i)) for i in range(4))
            return _assemble(F.when(h == "", F.lit("0")).otherwise(h), m, s, F.rpad(ms, 3, "0"))

        return F.when((F.length(t) <= K.MAX_STAMP_CHARS) & t.rlike(pattern), bind(_parts(t, pattern), whole))

    return bind(stamp, parse)


def _split(ms: Column) -> tuple[Column, Column, Column, Column]:
    whole = F.bround(ms.cast("double")).cast("bigint")
    return (F.floor(whole / 3_600_000), F.floor(whole / 60_000) % 60,
            F.floor(whole / 1000) % 60, whole % 1000)


def fmt_srt(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_split(ms))


def fmt_vtt(ms: Column) -> Column:
    return F.when(ms.isNull(), F.lit("?")).otherwise(F.format_string("%02d:%02d:%02d.%03d", *_split(ms)))


def fmt_ass(ms: Column) -> Column:
    """Centiseconds are cut off, not rounded."""
    h, m, s, frac = _split(ms)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, F.floor(frac / 10))


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def duration_ms(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start)

"""SMPTE timecode and clock columns, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames_of_ms(ms: Column, rate_num: int, rate_den: int) -> Column:
    """The nearest frame of a time in milliseconds."""
    return F.floor((2 * ms * rate_num + 1000 * rate_den) / (2 * 1000 * rate_den)).cast("long")


def rounded_frames(ms: Column, fps: float) -> Column:
    """The nearest frame at a rate that may be a rounded decimal; halves go up."""
    return F.floor(ms.cast("double") / 1000.0 * F.lit(float(fps)) + 0.5).cast("long")


def timecode(frame: Column, nominal: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF of a frame number; with ``drop``, HH:MM:SS;FF of the 29.97 and 59.94 counts.

    Drop-frame numbering leaves out nominal/15 numbers at the start of every
    minute but each tenth. Hours have no bound.
    """
    if drop:
        skipped = nominal // 15
        ten = nominal * 600 - 9 * skipped
        one = nominal * 60 - skipped
        tens, rest = F.floor(frame / ten), frame % ten
        minutes = F.when(rest < nominal * 60, F.lit(0)).otherwise(F.floor((rest - nominal * 60) / one) + 1)
        frame = frame + skipped * (9 * tens + minutes)
    frame = frame.cast("long")
    part = lambda unit, size: (F.floor(frame / unit) % size if size else F.floor(frame / unit)).cast("int")
    return F.format_string(f"%02d:%02d:%02d{';' if drop else ':'}%02d", part(nominal * 3600, 0), part(nominal * 60, 60), part(nominal, 60), (frame % nominal).cast("int"))


def in_clock_window(ts: Column, begin: str, end: str) -> Column:
    """Whether a timestamp's clock lies in [begin, end), which may pass midnight; equal bounds are the whole day."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (begin, end))
    if a == b:
        return ts.isNotNull()
    return (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)

"""Edit decision lists as text rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.timecode import rounded_frames, timecode

#: Rates that are counted with dropped numbers.
DROP_RATES = (Fraction(30_000, 1001), Fraction(60_000, 1001))


def drop_frame(fps: float) -> bool:
    """Whether a rate is 29.97 or 59.94, however it was rounded."""
    return any(abs(fps - float(r)) < 0.01 for r in DROP_RATES)


def reels(cuts: DataFrame, list_id: str) -> DataFrame:
    """list_id, clip, reel: a name of eight capitals, digits and underscores at most for each clip.

    Clips in order of first use that would share a name get _2, _3 and so on
    behind it, within the eight characters.
    """
    base = F.upper(F.substring(F.regexp_replace("clip", "[^A-Za-z0-9_]", "_"), 1, 8))
    first = cuts.groupBy(list_id, "clip").agg(F.min("position").alias("first")).withColumn("base", F.when(base == "", "AX").otherwise(base))
    twins = Window.partitionBy(list_id, "base").orderBy("first", "clip")
    ranked = first.withColumn("k", F.row_number().over(twins))
    suffix = F.concat(F.lit("_"), F.col("k").cast("string"))
    named = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(F.expr("substr(base, 1, 8 - length(concat('_', k)))"), suffix))
    return ranked.select(list_id, "clip", named.alias("reel"))


def edl(cuts: DataFrame, list_id: str, *, fps: float = 25.0, title: str | None = None) -> DataFrame:
    """list_id, line_no, line of edit lists, from (list_id, position, clip, start_ms, end_ms).

    Lines 1 and 2 are the title (the list's id by default) and the counting
    mode, events follow. Times become frames first and the record side is a
    running sum of whole frames, so a list has no rounding drift and every
    event is as long in the record as in its source. A clip with a negative
    start, without length, or shorter than a frame is an error.
    """
    if fps <= 0:
        raise ValueError("a frame rate must be positive")
    drop, nominal = drop_frame(fps), round(fps)
    frame = lambda c: rounded_frames(F.col(c), fps)
    wrong = F.when(F.col("start_ms") < 0, "a clip starts before 0").when(F.col("end_ms") <= F.col("start_ms"), "a clip ends before it starts").when(frame("start_ms") == frame("end_ms"), "a clip is shorter than a frame")
    checked = cuts.withColumn("a", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(frame("start_ms"))).withColumn("b", frame("end_ms"))
    rows = checked.join(reels(cuts, list_id), [list_id, "clip"])
    order = Window.partitionBy(list_id).orderBy("position", "clip", "a")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("out", F.sum(F.col("b") - F.col("a")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("out") - (F.col("b") - F.col("a"))
    labels = [timecode(c, nominal, drop) for c in (F.col("a"), F.col("b"), begin, F.col("out"))]
    line = F.concat(F.lpad(F.col("n").cast("string"), 3, "0"), F.lit("  "), F.rpad("reel", 8, " "), F.lit("  V     C        "), F.concat_ws("  ", *labels))
    events = rows.select(list_id, (F.col("n") + 2).alias("line_no"), line.alias("line"))
    lists = cuts.select(list_id).distinct()
    name = F.lit(title) if title is not None else F.col(list_id).cast("string")
    head = lists.select(list_id, F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("TITLE: "), name).alias("line")), F.struct(F.lit(2).alias("line_no"), F.lit(f"FCM: {'DROP' if drop else 'NON-DROP'} FRAME").alias("line")))).alias("h")).select(list_id, "h.line_no", "h.line")
    return head.unionByName(events)

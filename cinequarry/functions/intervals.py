"""Half-open time intervals [start_ms, end_ms): relations, joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIONS = ("simultaneous", "before", "after", "during", "starts_within", "ends_within")


def holds(relation: str, left: tuple[Column, Column], right: tuple[Column, Column], max_gap_ms: int = 0) -> Column:
    """Whether the left interval stands in the relation to the right one; touching is not overlapping."""
    (ls, le), (rs, re) = left, right
    return {
        "simultaneous": (ls < re) & (le > rs),
        "before": (le <= rs) & (rs - le <= max_gap_ms),
        "after": (re <= ls) & (ls - re <= max_gap_ms),
        "during": (rs <= ls) & (le <= re),
        "starts_within": (rs <= ls) & (ls < re),
        "ends_within": (rs < le) & (le <= re),
    }[relation]


def holds_by(relation: Column, left: tuple[Column, Column], right: tuple[Column, Column], max_gap_ms: Column) -> Column:
    """holds() with the relation and the gap as columns; a row of an unknown relation is an error."""
    (le, rs), (re, ls) = (left[1], right[0]), (right[1], left[0])
    within = {"before": (le <= rs) & (rs - le <= max_gap_ms), "after": (re <= ls) & (ls - re <= max_gap_ms)}
    found = F.coalesce(*[F.when(relation == r, within.get(r, holds(r, left, right))) for r in RELATIONS])
    return F.when(relation.isin(*RELATIONS), found).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce(relation, F.lit("null")))).cast("boolean"))


def overlap_ms(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    return F.greatest(F.least(left[1], right[1]) - F.greatest(left[0], right[0]), F.lit(0))


def iou(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Intersection over union of two intervals; 0 where both are empty."""
    shared = overlap_ms(left, right)
    whole = (left[1] - left[0]) + (right[1] - right[0]) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def support_by(relation: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """support() with the relation as a column."""
    return F.when(relation.isin("before", "after"), support("before", left, right)).otherwise(support("during", left, right))


def support(relation: str, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Intervals that show the relation: both operands for before and after, else what they share."""
    pair = lambda s, e: F.struct(s.alias("start_ms"), e.alias("end_ms"))
    if relation in ("before", "after"):
        return F.array(pair(*left), pair(*right))
    return F.array(pair(F.greatest(left[0], right[0]), F.least(left[1], right[1])))


def _sides() -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Bounds of both sides of a pair as related() names them."""
    return (F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms"))


def _level(start: Column, end: Column) -> Column:
    """The power of two that an interval's length reaches: bins of that size hold it in two at most."""
    length = F.greatest(end - start, F.lit(1))
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)  # rounds down, also before 0


def _binned(rows: DataFrame, start: Column, end: Column, levels: Column, name: str) -> DataFrame:
    """A row for each of ``levels`` and each bin there that the interval touches, with its first bin."""
    out = rows.withColumn("__level", F.explode(levels))
    out = out.withColumn(name, _bin(start, F.col("__level")))
    return out.withColumn("__bin", F.explode(F.sequence(name, _bin(F.greatest(start, end), F.col("__level")))))


def related(left: DataFrame, right: DataFrame, key: str | list[str], relation: str | None = None, *, max_gap_ms: int = 0) -> DataFrame:
    """Pairs of rows of one key whose intervals stand in the relation.

    Both sides have start_ms and end_ms, and no other name in common but
    ``key``. Without a relation the left side's columns relation and
    max_gap_ms say it for each row. A plain equi-join on the key would meet
    every row with every other; instead rows meet in bins of time.

    Bins are of all powers of two. An interval belongs to the level of its
    length, where it touches two bins at most; the longer of two intervals
    waits at its own level, and the shorter one visits it there. A row visits
    only levels that the other side has (looked up first: 63 at most), so an
    interval of any length is written a logarithmic number of times, and a
    pair is made in the first bin that both touch.
    """
    if relation is None:
        pad = F.when(F.col("relation").isin("before", "after"), F.col("max_gap_ms")).otherwise(0)
        test = holds_by(F.col("relation"), *_sides(), F.col("max_gap_ms"))
    else:
        pad = F.lit(max_gap_ms if relation in ("before", "after") else 0)
        test = holds(relation, *_sides(), max_gap_ms)
    return _meeting(left, right, key, pad, test)


def near(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Pairs of rows of one key with at most the left side's pad_ms between their intervals, touching and overlapping ones included; else as related()."""
    (ls, le), (rs, re) = _sides()
    return _meeting(left, right, key, F.col("pad_ms"), (ls - F.col("pad_ms") <= F.greatest(rs, re)) & (rs <= F.greatest(ls, le) + F.col("pad_ms")))


def _meeting(left: DataFrame, right: DataFrame, key: str | list[str], pad: Column, test: Column) -> DataFrame:
    """Pairs of rows of one key that pass the test, which only holds within ``pad`` of each other."""
    keys = [key] if isinstance(key, str) else list(key)
    a = left.withColumnsRenamed({"start_ms": "left_start_ms", "end_ms": "left_end_ms"})
    b = right.withColumnsRenamed({"start_ms": "right_start_ms", "end_ms": "right_end_ms"})
    l, r = _sides()
    a = a.withColumns({"__from": l[0] - pad, "__to": F.greatest(*l) + pad}).withColumn("__own", _level(F.col("__from"), F.col("__to")))
    b = b.withColumn("__other", _level(*r))
    there = {side: sorted(x[0] for x in frame.select(c).distinct().where(F.col(c).isNotNull()).collect()) for side, frame, c in (("a", a, "__own"), ("b", b, "__other"))}
    listed = lambda found: F.array(*[F.lit(x) for x in found]).cast("array<int>")
    a_columns, b_columns = [*a.columns, "__level", "__bin", "__a"], [*b.columns, "__level", "__bin", "__b"]
    meet = [*keys, "__level", "__bin"]

    def met(a_levels: Column, b_levels: Column) -> DataFrame:
        own = _binned(a, F.col("__from"), F.col("__to"), a_levels, "__a").select(*a_columns)
        other = _binned(b, *r, b_levels, "__b").select(*b_columns)
        return own.join(other, meet).where(test & (F.col("__bin") == F.greatest("__a", "__b")))

    waits = met(F.array("__own"), F.filter(listed(there["a"]), lambda x: x >= F.col("__other")))  # the left one is as long or longer
    visits = met(F.filter(listed(there["b"]), lambda x: x > F.col("__own")), F.array("__other"))
    return waits.unionByName(visits).drop("__level", "__bin", "__a", "__b", "__from", "__to", "__own", "__other")


def islands(rows: DataFrame, keys: list[str], *, gap_ms: int = 0, stretch_ms: int = 86_400_000) -> DataFrame:
    """keys, start_ms, end_ms, parts: unions of intervals no more than ``gap_ms`` apart (0: touching merge).

    Intervals that start within one stretch of time are united first, then
    these unions of each key, so a key with very many intervals is sorted in
    many parts.
    """
    counted = rows.select(*keys, "start_ms", "end_ms", F.lit(1).cast("long").alias("parts"), F.floor(F.col("start_ms") / stretch_ms).alias("__stretch"))
    return _united(_united(counted, [*keys, "__stretch"], gap_ms), keys, gap_ms)


def _united(rows: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("__new", F.when(F.col("start_ms") <= reach + gap_ms, 0).otherwise(1))
    numbered = fresh.withColumn("__island", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("parts").alias("parts")).drop("__island")

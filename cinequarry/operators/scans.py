"""A library of roots and locations over many scans: each version whole, with the times at which each row held.

A location is (root, path); the file there is what its fingerprint and size
say, and files that say the same are one asset, wherever they lie. Rows are
never changed: a scan closes the rows that no longer hold and adds new ones,
so any earlier state can be read. A state is written as one version and
readers see all of it or none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.plans.broadcasts import checked, shuffled
from cinequarry.plans.scratch import settle, shares
from cinequarry.plans.versions import commit, read, versions

STATE = "root string, path string, absolute string, asset string, fingerprint string, size long, modified_ns long, present boolean, since long, until long"
#: Locations of a partition.
SHARE = 200_000
_FACTS = ("absolute", "asset", "fingerprint", "size", "modified_ns", "present")


def asset_of(fingerprint: Column, size: Column) -> Column:
    return F.concat_ws(":", fingerprint, size.cast("string"))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def current(state: DataFrame, at: int | None = None) -> DataFrame:
    """The locations of the latest version, or as they were at an earlier one."""
    return state.where("until IS NULL") if at is None else state.where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at)))


def apply_scan(state: DataFrame, scan: DataFrame, roots: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(state after the scan, its changes) of scanned files (root, path, absolute, fingerprint, size, modified_ns).

    ``roots`` (root) are those that were scanned: a location of theirs that the
    scan lacks is no longer present, others stay as they are. A location that
    comes back, is touched, moves its root or holds another file is a new row.
    Changes are (root, path, asset, change, affected): created (a file that no
    location had), added (a known one at a new place), moved (a known one
    none of whose places of before is left), replaced (another file),
    touched (another time), remounted (another absolute path), returned,
    missing or unchanged. affected says whether the asset is to be processed
    again: not for a place added in another root than the asset's own.
    """
    roots = checked(settle(roots.select("root").distinct()))
    old = settle(current(state))
    found = settle(scan.join(roots, "root", "left_semi"))
    parts = shares(state.sparkSession, old.count() + found.count(), SHARE)
    by_place = lambda d: d.repartition(parts, "root", "path")
    seen = settle(by_place(found).dropDuplicates(["root", "path"]).withColumn("asset", asset_of(F.col("fingerprint"), F.col("size"))))
    before = old.join(roots, "root", "left_semi").select("root", "path", *[F.col(c).alias(f"__{c}") for c in _FACTS], F.lit(True).alias("__was"))
    rows = by_place(seen.select("root", "path", *[c for c in _FACTS if c != "present"], F.lit(True).alias("__seen"))).join(shuffled(by_place(before)), ["root", "path"], "full_outer")

    # What was known of each scanned asset, in this root or anywhere, and whether an earlier row of this scan has it too.
    # Locations that the scan lacks need none of this: with their empty asset they would all meet in one task.
    known = old.groupBy("asset").agg(F.lit(True).alias("__known"), F.bool_or("present").alias("__live"), F.collect_set(F.when(F.col("present"), F.col("root"))).alias("__roots"))
    left = settle(seen.select("root", "path", "asset").join(shuffled(old.where("present").select("root", "path", "asset")), ["root", "path", "asset"], "left_semi").unionByName(old.where("present").join(roots, "root", "left_anti").select("root", "path", "asset"))).select("asset").distinct().withColumn("__left", F.lit(True))
    path = F.struct("path")
    firsts = seen.groupBy("asset", "root").agg(F.min(path).alias("first")).groupBy("asset").agg(F.min(F.struct("root", "first")).alias("__place"), F.map_from_entries(F.collect_list(F.struct("root", "first"))).alias("__paths"))
    of_asset = firsts.join(known, "asset", "left").join(left, "asset", "left")
    met = settle(rows)
    held = met.where("__seen").repartition(parts, "asset").join(shuffled(of_asset.repartition(parts, "asset")), "asset", "left")
    held = held.withColumns({"__live_here": F.array_contains("__roots", F.col("root")), "__again": path > F.col("__paths")[F.col("root")], "__first": F.struct(F.col("root"), path.alias("first")) == F.col("__place")}).drop("__roots", "__paths", "__place")
    rows = held.unionByName(met.where("__seen IS NULL"), allowMissingColumns=True)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    change = (
        F.when(~flag("__seen") & flag("__present"), "missing")
        .when(~flag("__seen"), "unchanged")
        .when(~flag("__was") & ~flag("__known") & flag("__first"), "created")
        .when(~flag("__was") & flag("__known") & ~flag("__left"), "moved")
        .when(~flag("__was"), "added")
        .when(F.col("asset") != F.col("__asset"), "replaced")
        .when(~flag("__present"), "returned")
        .when(F.col("modified_ns") != F.col("__modified_ns"), "touched")
        .when(F.col("absolute") != F.col("__absolute"), "remounted")
        .otherwise("unchanged")
    )
    created = ~flag("__known") & flag("__first")
    fresh = ~flag("__was") & (flag("__live_here") | flag("__again") | (~flag("__live") & flag("__first")))
    revisited = flag("__was") & (~flag("__present") | (F.col("modified_ns") != F.col("__modified_ns")) | (F.col("absolute") != F.col("__absolute")))
    affected = flag("__seen") & (created | fresh | F.coalesce(revisited, F.lit(False)))
    judged = settle(rows.withColumns({"change": change, "affected": affected}))

    now = {c: F.when(flag("__seen"), F.col(c)).otherwise(F.col(f"__{c}")) for c in _FACTS if c != "present"} | {"present": flag("__seen")}
    moved = judged.where("change <> 'unchanged'")
    opened = moved.select("root", "path", *[v.alias(c) for c, v in now.items()], F.lit(version).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    ended = moved.where("__was").select("root", "path", F.lit(True).alias("__ended"))
    closed = by_place(state).join(shuffled(by_place(ended)), ["root", "path"], "left").withColumn("until", F.when(flag("__ended") & F.col("until").isNull(), F.lit(version).cast("long")).otherwise(F.col("until")))
    after = closed.drop("__ended").unionByName(opened)
    changes = judged.select("root", "path", F.coalesce(F.when(flag("__seen"), F.col("asset")), F.col("__asset")).alias("asset"), "change", "affected")
    return after, changes


def assets(state: DataFrame) -> DataFrame:
    """asset, fingerprint, size, present, first, missing_since, root, path of a state's assets: where each lies now, and since when it lies nowhere.

    Of the places of a present asset the first by root and path is shown.
    """
    rows = state.groupBy("asset").agg(
        F.min("fingerprint").alias("fingerprint"),
        F.min("size").alias("size"),
        F.coalesce(F.bool_or(F.col("until").isNull() & F.col("present")), F.lit(False)).alias("present"),
        F.min("since").alias("first"),
        F.max(F.when(F.col("present"), F.col("until"))).alias("last"),
        F.min(F.when(F.col("until").isNull() & F.col("present"), F.struct("root", "path"))).alias("place"),
    )
    return rows.select("asset", "fingerprint", "size", "present", "first", F.when(~F.col("present"), F.col("last")).alias("missing_since"), "place.root", "place.path")


def publish(state: DataFrame, path: str, version: int) -> DataFrame:
    """The state written as a version of the table at ``path``, and read from there."""
    spark = state.sparkSession
    name = f"state-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/{name}")
    commit(spark, path, version, {"state": name})
    return spark.read.schema(STATE).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame]:
    """(version, state) of the latest version at ``path``, or a given one; 0 and an empty state where there is none."""
    if version is None and not versions(spark, path):
        return 0, empty_state(spark)
    version, body = read(spark, path, version)
    return version, spark.read.schema(STATE).parquet(f"{path}/{body['state']}")


def scan_into(path: str, scan: DataFrame, roots: DataFrame) -> DataFrame:
    """Apply a scan to the library at ``path`` as its next version; the changes. Another scan at the same time is an error."""
    spark = scan.sparkSession
    version, state = load(spark, path)
    after, changes = apply_scan(state, scan, roots, version + 1)
    publish(after, path, version + 1)
    return changes

"""Reports over a library: what each asset has, tags with their use, collections, costs and the state of an index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_presence(artifacts: DataFrame, asset: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """asset, has_<kind> for each of ``kinds``, of the assets that have any artifact."""
    return artifacts.groupBy(asset).agg(*[F.bool_or(F.col(kind) == k).alias(f"has_{k}") for k in kinds])


def asset_cards(assets: DataFrame, asset: str, items: DataFrame, owner: str, *, latest: tuple[str, Sequence[str]], totals: Mapping[str, Column], places: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """``assets`` with their place, their latest item and totals over their items; an asset without items has a null and zeros.

    One scan and one shuffle of the items give the latest (its column, and
    those that it is the greatest by) and the totals, count included.
    """
    name, order = latest
    sums = items.groupBy(F.col(owner).alias("__owner")).agg(F.max_by(name, F.struct(*order)).alias("latest"), F.count("*").alias("items"), *[c.alias(n) for n, c in totals.items()])
    cards = assets if places is None else assets.join(F.broadcast(places), on, "left")
    joined = cards.join(sums, F.col(asset) == F.col("__owner"), "left").drop("__owner")
    return joined.withColumns({"items": F.coalesce("items", F.lit(0))} | {n: F.coalesce(F.col(n), F.lit(0)) for n in totals})


def canonical_tags(aliases: DataFrame, links: DataFrame) -> DataFrame:
    """tag, assets, aliases of canonical tags: aliases are (tag, alias), links (tag, asset).

    Each side is aggregated on its own, so aliases don't multiply assets.
    """
    named = aliases.groupBy("tag").agg(F.count_distinct("alias").alias("aliases"))
    used = links.groupBy("tag").agg(F.count_distinct("asset").alias("assets"))
    return named.join(used, "tag", "left").select("tag", F.coalesce("assets", F.lit(0)).alias("assets"), "aliases")


def unresolved_tags(links: DataFrame) -> DataFrame:
    """tag, n, assets, forms of raw tags without a canonical one (tag, asset, form): how often, on how many assets, and as what."""
    return links.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("asset").alias("assets"), F.array_sort(F.collect_set("form")).alias("forms"))


def collection_summary(collections: DataFrame, collection: str, items: DataFrame, owner: str, length: Column) -> DataFrame:
    """collection, shots, span of all collections; an empty one has zeros."""
    sums = items.groupBy(F.col(owner).alias("__owner")).agg(F.count("*").alias("n"), F.sum(length).alias("s"))
    return collections.join(sums, F.col(collection) == F.col("__owner"), "left").select(collection, F.coalesce("n", F.lit(0)).alias("shots"), F.coalesce("s", F.lit(0.0)).alias("span"))


def costs(ledger: DataFrame, at: str, cost: str, *, by: Sequence[str] = (), month: bool = False) -> DataFrame:
    """day or month, ``by``, cost, n of a ledger: sums by the date's prefix and, if asked, by further columns."""
    period = F.date_format(at, "yyyy-MM" if month else "yyyy-MM-dd").alias("month" if month else "day")
    return ledger.groupBy(period, *by).agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))


def index_health(documents: DataFrame, text: str, source: str, size: str) -> DataFrame:
    """One row: assets, sources, empty (without text) and chars of what is indexed."""
    bare = F.col(text).isNull() | (F.col(text) == "")
    return documents.agg(F.count("*").alias("assets"), F.count_distinct(source).alias("sources"), F.count_if(bare).alias("empty"), F.sum(size).alias("chars"))

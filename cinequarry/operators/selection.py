"""Diverse selection from short ranked pools, paging and context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR_MS, SAME_ASSET, SAME_SESSION = 5000, 0.25, 0.20
DIVERSITY = {"creative": 0.6}
POOL = (3, 30, 200)
PAGE, MOST_PAGE, WINDOW = 20, 100, 200


def pool_size(target: int) -> int:
    times, least, most = POOL
    return max(least, min(times * target, most))


def check_page(limit: int = 0, offset: int = 0) -> tuple[int, int]:
    """The limit and offset to use; what lies beyond the result window is an error."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    limit = min(limit or PAGE, MOST_PAGE)
    if limit + offset > WINDOW:
        raise ValueError(f"offset + limit may be {WINDOW} at most")
    return limit, offset


def diversify(pool: DataFrame, limit: int, diversity: float = 0.2) -> DataFrame:
    """Greedy choice a query from (query_id, id, asset, session, start_ms, score), with its place from 1.

    One pass in order of score and id: a shot within five seconds of a chosen
    one of its asset is left out; each chosen shot of its asset, or else of
    its session (null or empty: none), takes a share of the pool's best from its score; it is put
    behind the chosen ones that score as much, and the list is cut to the
    limit. Without diversity the order stays. The choice depends on its order,
    so each query's pool is one group; it is cut to the pool size first, so no
    group grows with the data.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    cut = pool.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= pool_size(limit))
    if diversity <= 0:
        return cut.where(F.col("__rank") <= limit).select("query_id", "id", "score", F.col("__rank").cast("long").alias("place"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("__rank").to_dict("records")
        scale = diversity / 0.2 * max([0.0, *(r["score"] for r in rows)])
        chosen: list[dict] = []
        for r in rows if scale > 0 else ():
            own = [c for c in chosen if c["asset"] == r["asset"]]
            if any(abs(c["start_ms"] - r["start_ms"]) <= NEAR_MS for c in own):
                continue
            kin = sum(c["asset"] != r["asset"] and pd.notna(r["session"]) and r["session"] != "" and c["session"] == r["session"] for c in chosen)
            score = max(0.0, r["score"] - scale * (SAME_ASSET * len(own) + SAME_SESSION * kin))
            place = sum(c["score"] >= score for c in chosen)
            chosen.insert(place, r | {"score": score})
            del chosen[limit:]
        return pd.DataFrame([(r["query_id"], r["id"], r["score"], i) for i, r in enumerate(chosen, 1)], columns=["query_id", "id", "score", "place"])

    kinds = dict(cut.dtypes)
    return cut.select("query_id", "id", "asset", "session", "start_ms", "score", "__rank").groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, place long")


def neighbours(rows: DataFrame, key: str, group: str, ordinal: str) -> DataFrame:
    """key, previous, next by ordinal in its group; ordinals may have gaps."""
    order = Window.partitionBy(group).orderBy(ordinal, key)
    return rows.select(key, F.lag(key).over(order).alias("previous"), F.lead(key).over(order).alias("next"))

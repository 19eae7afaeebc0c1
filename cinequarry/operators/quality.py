"""Quality of retrieval, event detection and speaker attribution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.intervals import iou, related
from cinequarry.plans.scratch import settle, shares

#: Pairs of a task that matches them, and turns of one that sweeps recordings.
MATCHED, SWEPT = 200_000, 20_000


def ranking(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision, recall, ndcg at k of results (query_id, id, rank) under grades (query_id, id, grade).

    Precision divides by k even for shorter lists; gain is 2 ** grade - 1.
    Queries without results count with zeros.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    discount = F.log2(F.col("rank") + 1)
    good = grades.where("grade > 0")
    hits = results.where(F.col("rank") <= k).join(good, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(gain / discount).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    best = good.withColumn("rank", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= k, gain / discount).otherwise(0.0)).alias("ideal"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ideal.join(hits, "query_id", "left").select("query_id", (n("hits") / k).alias("precision"), (n("hits") / F.col("relevant")).alias("recall"), (n("dcg") / F.col("ideal")).alias("ndcg"))


def interval_ranking(results: DataFrame, positives: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """query_id, precision, recall, ndcg at k where results (query_id, rank, asset, start_ms, end_ms) must meet positive intervals.

    A result is right when it overlaps an unused positive (query_id, id,
    asset, start_ms, end_ms, grade) of its asset by ``least`` IoU, the first
    one by id; grades under 1 count as 1. Every query with positives has a
    row. Which positive a result uses depends on those before it, so the first
    k results of a query are one group.
    """
    tag = lambda d: d.withColumn("__key", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("asset").cast("string")))
    r = tag(results.where(F.col("rank") <= k)).select("__key", "rank", "start_ms", "end_ms")
    p = tag(positives).select("__key", "query_id", F.col("id").alias("positive"), F.greatest("grade", F.lit(1)).alias("grade"), "start_ms", "end_ms")
    met = related(r, p, "__key", "simultaneous")
    a, b = (F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms"))
    pairs = met.where(iou(a, b) >= least).select("query_id", "rank", "positive", "grade")
    kind = dict(pairs.dtypes)["query_id"]

    def gain(frame: pd.DataFrame) -> pd.DataFrame:
        used, hits, dcg = set(), 0, 0.0
        for rank, own in frame.sort_values(["rank", "positive"]).groupby("rank", sort=True):
            free = own[~own["positive"].isin(used)]
            if len(free):
                used.add(free["positive"].iloc[0])
                hits += 1
                dcg += (2.0 ** int(free["grade"].iloc[0]) - 1) / np.log2(rank + 1)
        return pd.DataFrame({"query_id": [frame["query_id"].iloc[0]], "hits": [hits], "dcg": [dcg]})

    gained = pairs.groupBy("query_id").applyInPandas(gain, f"query_id {kind}, hits long, dcg double")
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    best = positives.withColumn("grade", F.greatest("grade", F.lit(1))).withColumn("place", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ideal.join(gained, "query_id", "left").select("query_id", (n("hits") / k).alias("precision"), (n("hits") / F.col("relevant")).alias("recall"), (n("dcg") / F.col("ideal")).alias("ndcg"))


def false_positives(results: DataFrame, relevant: DataFrame, semantic: DataFrame, lexical: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, cause of the wrong ones among the first k results (query_id, id, rank).

    The cause is the signal whose own first k (query_id, id, rank) hold it,
    semantic before lexical; else blend, as only the fusion brought it up.
    """
    own = lambda d, name: d.where(F.col("rank") <= k).select("query_id", "id", F.lit(True).alias(name)).distinct()
    wrong = results.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_anti")
    both = wrong.join(own(semantic, "s"), ["query_id", "id"], "left").join(own(lexical, "l"), ["query_id", "id"], "left")
    return both.select("query_id", "id", F.when(F.col("s"), "semantic").when(F.col("l"), "lexical").otherwise("blend").alias("cause"))


def by_intent(scores: DataFrame, intents: DataFrame, columns: list[str]) -> DataFrame:
    """intent, queries and the mean of each column over all queries of an intent; a query without a score counts as 0, an empty intent as auto."""
    named = intents.select("query_id", F.coalesce(F.nullif(F.trim("intent"), F.lit("")), F.lit("auto")).alias("intent"))
    return named.join(scores, "query_id", "left").groupBy("intent").agg(F.count("*").alias("queries"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])


def mean_over(scores: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column over all ``queries`` (query_id); what has no score counts as 0."""
    return queries.select("query_id").join(scores, "query_id", "left").agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])


def expected_shots(expected: DataFrame, shots: DataFrame) -> DataFrame:
    """span, shot: the shot that overlaps an expected span (span, asset, start_ms, end_ms) most, by half of it at least.

    Equal overlaps go to the earlier shot, then the smaller id; a span without
    such a shot has a null.
    """
    own = shots.select("asset", F.col("id").alias("shot"), "start_ms", "end_ms")
    met = related(expected.select("asset", "span", "start_ms", "end_ms"), own, "asset", "simultaneous")
    shared = F.least("left_end_ms", "right_end_ms") - F.greatest("left_start_ms", "right_start_ms")
    fit = met.withColumn("shared", shared).where(2 * F.col("shared") >= F.col("left_end_ms") - F.col("left_start_ms"))
    best = fit.groupBy("span").agg(F.min_by("shot", F.struct((-F.col("shared")).alias("s"), "right_start_ms", "shot")).alias("shot"))
    return expected.select("span").join(best, "span", "left")


def relevance_suite(results: DataFrame, judgments: DataFrame, queries: DataFrame, proof: DataFrame | None = None, *, recall_at: int = 20, precision_at: int = 10) -> DataFrame:
    """One row of a suite's measures over queries (query_id, expected_intent, intent, expected_empty).

    results (query_id, id, rank) under judgments (query_id, id, grade; 0: not
    relevant): recall and nDCG over queries that have relevant shots,
    precision with its fixed divisor over all, the share of empty results,
    whether emptiness and intent are as expected, hits of shots judged not
    relevant; and of ``proof`` (query_id, id, value, state, expected) how many
    expected states are met, and how many that claim support were expected to.
    """
    good = judgments.where("grade > 0")
    wide, narrow = ranking(results, good, recall_at), ranking(results, good, precision_at)
    found = results.where(F.col("rank") <= recall_at).select("query_id").distinct().withColumn("some", F.lit(True))
    per = queries.join(wide.select("query_id", "recall"), "query_id", "left").join(narrow.select("query_id", "precision", "ndcg"), "query_id", "left").join(found, "query_id", "left")
    empty = F.col("some").isNull()
    wrong = results.where(F.col("rank") <= recall_at).join(judgments.where("grade <= 0"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("not_relevant_hits"))
    sums = per.agg(
        F.avg("recall").alias("recall"),
        F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"),
        F.avg("ndcg").alias("ndcg"),
        F.avg(empty.cast("double")).alias("empty_rate"),
        F.avg((empty == F.coalesce("expected_empty", F.lit(False))).cast("double")).alias("empty_accuracy"),
        F.avg(F.col("intent").eqNullSafe(F.col("expected_intent")).cast("double")).alias("intent_accuracy"),
    ).crossJoin(wrong)  # one row each
    if proof is None:
        return sums
    claims = F.col("state").isin("confirmed", "possible")
    right = proof.agg(F.avg((F.col("state") == F.col("expected")).cast("double")).alias("evidence_correct"), F.avg(F.when(claims, F.col("expected").isin("confirmed", "possible").cast("double"))).alias("evidence_precision"))
    return sums.crossJoin(right)


def match_events(predicted: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, prediction, truth, iou: each prediction, in order, with the best truth still free.

    Pairs are made in shared time buckets and only where they reach the
    threshold. One-to-one matching in order is greedy, but pairs of spans that
    don't touch can't compete, so each run of overlapping spans is a group of
    its own.
    """
    tag = lambda d, name: d.select(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]).alias("__key"), F.struct(*keys).alias(f"__{name}"), F.col("id").alias(name), "start_ms", "end_ms")
    met = related(tag(predicted, "prediction"), tag(truth, "truth"), "__key", "simultaneous")
    p, t = (F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms"))
    pairs = settle(met.withColumn("iou", iou(p, t)).where(F.col("iou") >= least).withColumns({"start_ms": F.least(p[0], t[0]), "end_ms": F.greatest(p[1], t[1])}))
    order = Window.partitionBy("__key").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = pairs.withColumn("__new", F.when(F.col("start_ms") < reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    columns = ["__prediction", "prediction", "truth", "iou"]

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = last = None
        used, done = set(), False
        for batch in batches:  # in order of runs, then of predictions, the best truth first
            kept = []
            for i, (key, number, start, end, prediction, truth) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__key", "__run", "left_start_ms", "left_end_ms", "prediction", "truth")), strict=True)):
                if run != (key, number):
                    run, last, used = (key, number), None, set()
                if last != (start, end, prediction):
                    last, done = (start, end, prediction), False
                if not done and truth not in used:
                    used.add(truth)
                    done = True
                    kept.append(i)
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    parts = shares(pairs.sparkSession, pairs.count(), MATCHED)
    ordered = runs.repartition(parts, "__key", "__run").sortWithinPartitions("__key", "__run", "left_start_ms", "left_end_ms", "prediction", F.desc("iou"), "right_start_ms", "truth")
    found = ordered.mapInArrow(match, f"__prediction {types['__prediction']}, prediction {types['prediction']}, truth {types['truth']}, iou double")
    return found.select("__prediction.*", "prediction", "truth", "iou")


def event_scores(predicted: DataFrame, truth: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row: micro_f1, macro_f1, boundary_error_ms of match_events()' pairs.

    The macro mean is over keys with any match; the boundary error is the mean
    of both ends' distances over matched pairs.
    """
    n = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    every = n(predicted, "p").join(n(truth, "t"), keys, "full_outer").join(n(matches, "tp"), keys, "left").na.fill(0, ["p", "t", "tp"])
    own = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t")))
    sums = every.agg(F.coalesce(2 * F.sum("tp") / F.sum(F.col("p") + F.col("t")), F.lit(0.0)).alias("micro_f1"), F.coalesce(F.avg(own), F.lit(0.0)).alias("macro_f1"))
    ends = lambda d, name: d.select(F.col("id").alias(name), F.col("start_ms").alias(f"s_{name}"), F.col("end_ms").alias(f"e_{name}"))
    both = matches.join(ends(predicted, "prediction"), "prediction").join(ends(truth, "truth"), "truth")
    off = (F.abs(F.col("s_prediction") - F.col("s_truth")) + F.abs(F.col("e_prediction") - F.col("e_truth"))) / 2
    return sums.crossJoin(both.agg(F.coalesce(F.avg(off), F.lit(0.0)).alias("boundary_error_ms")))  # one row each


def f1(hits: Column, predicted: Column, actual: Column) -> Column:
    return F.when(predicted + actual > 0, 2 * hits / (predicted + actual)).otherwise(F.lit(0.0))


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """threshold, far, frr of scored trials (score, same): accepting what scores at least the threshold.

    Trials are first counted by score, so the running sums go over distinct
    scores; these meet in one task, rounded to 1e-4 there are 20,001 at most.
    """
    counts = scores.groupBy(F.round("score", 4).alias("threshold")).agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("d"))
    up = Window.orderBy("threshold")
    total = Window.partitionBy()
    below_same = F.sum("s").over(up.rowsBetween(Window.unboundedPreceding, -1))
    from_diff = F.sum("d").over(up.rowsBetween(0, Window.unboundedFollowing))
    return counts.select("threshold", (from_diff / F.greatest(F.sum("d").over(total), F.lit(1))).alias("far"), (F.coalesce(below_same, F.lit(0)) / F.greatest(F.sum("s").over(total), F.lit(1))).alias("frr"))


def equal_error(sweep: DataFrame) -> DataFrame:
    """threshold, eer where false acceptances and rejections are closest; the lowest such threshold."""
    gap = F.abs(F.col("far") - F.col("frr"))
    return sweep.agg(F.min_by("threshold", F.struct(gap, "threshold")).alias("threshold"), F.min_by((F.col("far") + F.col("frr")) / 2, F.struct(gap, "threshold")).alias("eer"))


def centroid(rows: DataFrame, key: str) -> DataFrame:
    """key, position, value: the unit mean of unit vectors (key, vector, duration_ms), weighted by duration."""
    each = rows.select(key, F.col("duration_ms").alias("w"), F.posexplode("vector").alias("position", "x"))
    sums = each.groupBy(key, "position").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(key)))
    return sums.select(key, "position", F.when(length > 0, F.col("s") / length).otherwise(F.lit(0.0)).alias("value"))


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, one a row and column at most, of the greatest total weight, by shortest augmenting paths."""
    n, m = weights.shape
    if n > m:
        return sorted((r, c) for c, r in best_assignment(weights.T))
    cost = weights.max(initial=0) - weights.astype(float)
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            step_to = 1 + int(np.argmin(np.where(done[1:], np.inf, least[1:])))
            step = least[step_to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = step_to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def diarization_error(reference: DataFrame, hypothesis: DataFrame, durations: DataFrame, *, frame_ms: int = 10, collar_ms: int = 250) -> DataFrame:
    """asset, der_with_overlap, der_without_overlap, speaker_count_error of turns (asset, speaker, start_ms, end_ms).

    Errors are counted over frames of ``frame_ms`` within ``durations``
    (asset, duration_ms), but for those within the collar of a reference
    boundary. Where turns of one side overlap, the one that starts last (and
    then ends last) holds the frame; the second rate leaves out what several
    reference turns share. Each reference speaker is matched with one of the
    hypothesis at most, for the most frames in common. Assets without a scored
    frame have no rates.

    Frames aren't made: a recording's turns are one group, swept once over
    their boundaries, for any number of speakers.
    """
    own = lambda d, side: d.where("end_ms > start_ms").select("asset", F.col("speaker").cast("string").alias("speaker"), F.floor(F.col("start_ms") / frame_ms).alias("a"), F.floor(F.col("end_ms") / frame_ms).alias("b"), F.lit(side).alias("side"))
    turns = own(reference, 0).unionByName(own(hypothesis, 1)).join(durations.select("asset", F.floor(F.col("duration_ms") / frame_ms).alias("frames")), "asset")
    collar = collar_ms // frame_ms

    def sweep(frame: pd.DataFrame) -> pd.DataFrame:
        total = int(frame["frames"].iloc[0])
        clipped = frame.assign(a=frame["a"].clip(0, total), b=frame["b"].clip(0, total)).sort_values(["a", "b", "speaker"])
        ref, hyp = clipped[clipped["side"] == 0], clipped[clipped["side"] == 1]
        raw = frame[frame["side"] == 0]
        near = np.concatenate([raw["a"].to_numpy(), raw["b"].to_numpy()]).astype(int)
        collars = np.stack([np.clip(near - collar, 0, total), np.clip(near + collar, 0, total)], 1)
        edges = np.unique(np.concatenate([[0, total], clipped["a"], clipped["b"], collars.reshape(-1)]).astype(int))
        starts, sizes = edges[:-1], np.diff(edges)
        names = [sorted(side["speaker"].unique()) for side in (ref, hyp)]

        def holders(side: pd.DataFrame, known: list[str]) -> np.ndarray:
            out = np.full(len(starts), -1)
            for s, a, b in zip(side["speaker"], np.searchsorted(edges, side["a"]), np.searchsorted(edges, side["b"]), strict=True):
                out[a:b] = known.index(s)
            return out

        def depth(spans: np.ndarray) -> np.ndarray:
            change = np.zeros(len(edges), int)
            np.add.at(change, np.searchsorted(edges, spans[:, 0]), 1)
            np.add.at(change, np.searchsorted(edges, spans[:, 1]), -1)
            return np.cumsum(change)[:-1]

        r, h = holders(ref, names[0]), holders(hyp, names[1])
        shared = np.zeros((len(names[0]), len(names[1])))
        both = (r >= 0) & (h >= 0)
        np.add.at(shared, (r[both], h[both]), sizes[both])
        match = np.full(len(names[0]) + 1, -2)  # the last for no speaker
        for x, y in best_assignment(shared) if shared.size else ():
            if shared[x, y]:
                match[x] = y
        wrong = np.where(r >= 0, match[r] != h, h >= 0)
        scored = depth(collars) == 0
        alone = scored & (depth(ref[["a", "b"]].to_numpy().astype(int)) <= 1)
        rates = [float((sizes * (wrong & k)).sum() / n) if (n := int((sizes * k).sum())) else (None if k is scored else 0.0) for k in (scored, alone)]
        present = [len(set(x[(x >= 0) & (sizes > 0)].tolist())) for x in (r, h)]
        if rates[0] is None:
            rates[1] = None
        return pd.DataFrame({"asset": [frame["asset"].iloc[0]], "der_with_overlap": [rates[0]], "der_without_overlap": [rates[1]], "speaker_count_error": [present[1] - present[0]]})

    kind = dict(turns.dtypes)["asset"]
    # A recording is a few short rows but some milliseconds' work: partitions go by their number, not by their bytes.
    turns = turns.where("frames > 0").repartition(shares(turns.sparkSession, reference.count(), SWEPT), "asset")
    return turns.groupBy("asset").applyInPandas(sweep, f"asset {kind}, der_with_overlap double, der_without_overlap double, speaker_count_error long")

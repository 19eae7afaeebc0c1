"""Evidence for claims, kept apart from scores, and the gate that asks for it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequarry.functions.text import pieces
from cinequarry.functions.vocabulary import READ_ROWS, described, mentioned
from cinequarry.plans.broadcasts import checked, shuffled

STRUCTURED = ("objects", "actions", "tags", "mood")


def observations(shots: DataFrame, key: str = "id") -> DataFrame:
    """key, source, value, denied: what each shot's fields name; its description may deny it.

    Computed once at index time, as it depends on no query: the vocabulary's
    concepts, plain words, terms of their own, and every two and three letters
    of scripts without blanks, so that a query's short term is found inside a
    sentence by an equality. One automaton reads each field once. A concept is
    denied where its first word stands in a denial, another plain word of
    three letters or more likewise.
    """
    fields = [key, "description", *STRUCTURED]
    schema = f"`{key}` {shots.schema[key].dataType.simpleString()}, source string, value string, denied boolean"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, READ_ROWS):
            owner, rows = [], []
            for i, (description, *listed) in enumerate(zip(*(batch.column(c).to_pylist() for c in fields[1:]), strict=True)):
                own = described(description or "")
                for source, values in zip(STRUCTURED, listed, strict=True):
                    own += [(source, v, False) for v in set().union(*(mentioned(v) for v in values or () if v))]
                owner += [i] * len(own)
                rows += own
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner, pa.int64())), *columns], names=[key, "source", "value", "denied"])

    return shots.select(*fields).mapInArrow(read, schema)


def evidence(candidates: DataFrame, needs: DataFrame, observed: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """query_id, id, need, value, state, sources of every need of every candidate (query_id, id).

    confirmed: a structured field says so; possible: only the description or
    the transcript does; contradicted: the description denies it; unknown:
    nothing does. For a must_not, an explicit denial leaves it unknown, never
    confirmed absent. sources are the fields that name the value, and
    transcript. ``spoken`` (id, value) are phrases found in speech.
    """
    pairs = candidates.select("query_id", "id").join(checked(needs.select("query_id", "need", "kind", "value").distinct()), "query_id")
    seen = observed.groupBy("id", "value").agg(
        F.bool_or(F.col("source") != "description").alias("structured"),
        F.bool_or((F.col("source") == "description") & ~F.col("denied")).alias("described"),
        F.bool_or((F.col("source") == "description") & F.col("denied")).alias("denied"),
        F.collect_set("source").alias("fields"),
    )
    found = pairs.join(shuffled(seen), ["id", "value"], "left")
    if spoken is not None:
        found = found.join(spoken.select("id", "value", F.lit(True).alias("said")).distinct(), ["id", "value"], "left")
    else:
        found = found.withColumn("said", F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    negated = F.col("need") == "must_not"
    state = (
        F.when(negated & flag("structured"), "confirmed")
        .when(negated & flag("described") & ~flag("denied"), "possible")
        .when(negated, "unknown")
        .when(flag("denied"), "contradicted")
        .when(flag("structured"), "confirmed")
        .when(flag("described") | ((F.col("kind") == "speech") & flag("said")), "possible")
        .otherwise("unknown")
    )
    said = F.when((F.col("kind") == "speech") & flag("said"), F.array(F.lit("transcript"))).otherwise(F.array().cast("array<string>"))
    sources = F.array_sort(F.concat(F.coalesce("fields", F.array().cast("array<string>")), said))
    return found.select("query_id", "id", "need", "value", state.alias("state"), sources.alias("sources"))


def gate(candidates: DataFrame, proof: DataFrame) -> DataFrame:
    """Candidates (query_id, id, score) that the evidence doesn't refute, with score * (0.5 + 0.5 * confirmed share of musts).

    Out go rows with a contradicted must, with a must that nothing supports,
    and with a must_not that is observed. A should neither counts nor refutes.
    """
    wanted, negated = F.col("need") == "must", F.col("need") == "must_not"
    judged = proof.groupBy("query_id", "id").agg(
        F.count_if(wanted & (F.col("state") == "contradicted")).alias("contradicted"),
        F.count_if(wanted & (F.col("state") == "unknown")).alias("unsupported"),
        F.count_if(negated & F.col("state").isin("confirmed", "possible")).alias("forbidden"),
        F.count_if(wanted & (F.col("state") == "confirmed")).alias("confirmed"),
        F.count_if(wanted).alias("total"),
    )
    kept = candidates.join(judged, ["query_id", "id"], "left").where("coalesce(contradicted, 0) = 0 AND coalesce(unsupported, 0) = 0 AND coalesce(forbidden, 0) = 0")
    factor = F.when(F.coalesce("total", F.lit(0)) > 0, 0.5 + 0.5 * F.col("confirmed") / F.col("total")).otherwise(F.lit(1.0))
    return kept.withColumn("score", F.col("score") * factor).select(*candidates.columns)

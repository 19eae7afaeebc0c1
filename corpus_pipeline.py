"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Every stage works on what its predecessor kept, written as Parquet and read
again; all but the last return the columns of documents. Null ids and texts,
empty, very long and repeated rows are those of the operators that the stages
call; an empty table passes through all stages, and further columns stay as
they are up to the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.llm import toxicity as toxic
from cinequarry.llm.common import small_batches
from cinequarry.llm.decontamination import decontaminate
from cinequarry.llm.exact_dedup import drop_copies
from cinequarry.llm.jaccard_join import keep_one
from cinequarry.llm.packing import pack_documents
from cinequarry.llm.queries import learned_toxicity, tokenizer_path
from cinequarry.plans.scratch import discard, settle, written

#: Documents that score this or more are rejected.
REJECTED = 0.7
#: Words whose ids a packing task keeps; it forgets them, and the tokenizer, as its worker serves the other stages too.
CACHE_WORDS = 150_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that leaves room for the others: executors serve all of them, one after the other."""

    @wraps(run)
    def with_small_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return with_small_batches


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = learned_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxic.score(docs, lexicon, column="__toxicity").where(F.col("__toxicity") < REJECTED).drop("__toxicity")


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(), cache_words=CACHE_WORDS, lasting=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Learned scores and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = written(spark)
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            own = [p for p in written(spark) if p not in before]
            docs = settle(docs)
            discard(spark, own)  # the stage's scratch tables; its result is written
    return docs

"""Lexical index and ranking: postings with positions, phrases, field-weighted BM25.

An index (operators/segments.py) is built from the rows once and kept up in
segments; all queries of a table of queries read it together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.text import CJK, chunks
from cinequarry.operators.segments import Index, Reading, open_index, refresh_index, row_postings, saturation, top_terms, write_index
from cinequarry.plans.broadcasts import checked
from cinequarry.plans.scratch import settle, shares

__all__ = ["Index", "Reading", "asset_fields", "bm25", "name_hints", "open_index", "phrases", "postings", "refresh_index", "search_index", "top", "top_index", "unit_score", "write_index"]

LEAST_IDF = 1e-6
HALF = 2.2  # score at which the normalised score is a half
#: Distinct query terms up to which they are a list in the plan; beyond, tokens meet them in a join.
LISTED_TERMS = 2_000


def postings(rows: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """key, field, token, tf, positions: a row per token that a field holds; keys are unique."""
    return row_postings(rows, key, fields).select(key, "field", "token", "tf", "positions")


#: Columns of an asset's index; its location is never filled.
ASSET_FIELDS = ("filename", "summary", "transcript", "scene_tags", "subjects", "mood_tags", "extra_tags", "location", "editorial_reason")


def asset_fields(present: Mapping[str, Column]) -> dict[str, Column]:
    """Token columns of ASSET_FIELDS, empty for those that aren't given, and always for the location."""
    none = F.array().cast("array<string>")
    return {name: F.flatten(chunks(present[name])) if name in present and name != "location" else none for name in ASSET_FIELDS}


def phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, place, token of queries (query_id, text): each run of a text is a phrase.

    A plain word is a phrase of one token; a run of a script without blanks is
    the phrase of its overlapping pairs, which must follow each other.
    """
    runs = queries.select("query_id", F.posexplode(chunks("text")).alias("phrase", "run"))
    return runs.select("query_id", "phrase", F.posexplode("run").alias("place", "token"))


def _weight_of(weights: Mapping[str, float] | None) -> Column:
    """Weight of the column field; those under zero count as zero, absent ones as 1."""
    pairs = [x for name, w in (weights or {}).items() for x in (F.lit(name), F.lit(max(0.0, float(w))))]
    return F.coalesce(F.create_map(*pairs)[F.col("field")], F.lit(1.0)) if pairs else F.lit(1.0)


def _idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))


def _part(idf: Column, f: Column, length: Column, mean: Column) -> Column:
    return idf * saturation(f, length, mean)


def search_index(index: Index, asked: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """query_id, key, score of every row that holds all phrases of a query (query_id, phrase, place, token).

    A phrase stands in one field, its tokens at consecutive positions. Each
    phrase is ranked like a term: by the rows that hold it and by how often.
    """
    key = index.key
    sizes = asked.groupBy("query_id", "phrase").agg(F.count("*").alias("tokens"))
    wanted = asked.join(sizes, ["query_id", "phrase"])
    # All that follows is by key: one shuffle of what the asked tokens have, in partitions of bounded size.
    found = index.postings.join(checked(wanted), "token").repartition(shares(index.spark, sum(s.rows for s in index.segments)), key)
    single = found.where("tokens = 1").select("query_id", "phrase", key, "field", F.col("tf").alias("hits"), "length")
    starts = found.where("tokens > 1").select("query_id", "phrase", "tokens", key, "field", "length", "place", F.explode("positions").alias("position"))
    whole = starts.groupBy("query_id", "phrase", "tokens", key, "field", "length", (F.col("position") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = tokens")
    several = whole.groupBy("query_id", "phrase", key, "field", "length").agg(F.count("*").alias("hits")).select("query_id", "phrase", key, "field", "hits", "length")
    hits = settle(single.unionByName(several).groupBy("query_id", "phrase", key).agg(F.sum(_weight_of(weights) * F.col("hits")).alias("f"), F.max("length").alias("length")))
    df = hits.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    needed = sizes.groupBy("query_id").agg(F.count("*").alias("needed"))
    n, mean = F.lit(index.n), F.lit(float(index.mean) or 1.0)
    scored = hits.join(checked(df), ["query_id", "phrase"])
    parts = scored.groupBy("query_id", key).agg(F.sum(_part(_idf(n, F.col("df")), F.col("f"), F.col("length"), mean)).alias("score"), F.count("*").alias("matched"))
    return parts.join(checked(needed), "query_id").where("matched = needed").select("query_id", key, "score")


def top_index(index: Index, asked: DataFrame, k: int, weights: Mapping[str, float] | None = None) -> tuple[DataFrame, Reading]:
    """(query_id, key, score, rank of the k best rows that hold all tokens of a query (query_id, token); what was read): see top_terms()."""
    found, reading = top_terms(index, asked, k, _part, _idf, lambda: _weight_of(weights))
    return top(found, index.key, k), reading


def bm25(rows: DataFrame, key: str, fields: Mapping[str, Column], terms: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """query_id, key, score of every row that holds all terms of a query (query_id, term), without an index.

    One scan: of its tokens each row keeps, before they are exploded, only
    those some query asks for, and its length; that small table is written
    once and gives the totals, the frequencies and the scores.
    """
    distinct = settle(terms.select("query_id", "term").distinct())
    names = [r["term"] for r in distinct.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    listed = F.array(*[F.lit(t) for t in names]) if 0 < len(names) <= LISTED_TERMS else None
    tokenised = rows.select(key, *[tokens.alias(f"__{name}") for name, tokens in fields.items()])  # apart, so that each text is split once
    length = sum((F.size(f"__{name}") for name in fields), F.lit(0))

    def keep(column: str) -> Column:
        if listed is None:
            return F.col(column)
        return F.when(F.arrays_overlap(column, listed), F.filter(column, lambda t: F.array_contains(listed, t))).otherwise(F.array().cast("array<string>"))

    own = F.filter(F.array(*[F.struct(F.lit(name).alias("field"), keep(f"__{name}").alias("tokens")) for name in fields]), lambda f: F.size(f["tokens"]) > 0)
    sized = settle(tokenised.select(key, length.alias("length"), own.alias("found")))
    totals = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = F.lit(int(totals["n"])), F.lit(float(totals["mean"] or 0.0) or 1.0)
    each = sized.select(key, "length", F.explode("found").alias("f")).select(key, "length", "f.field", F.explode("f.tokens").alias("term"))
    hits = each.groupBy(key, "length", "term").agg(F.sum(_weight_of(weights)).alias("f")).join(checked(distinct.select("term").distinct()), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    needed = distinct.groupBy("query_id").agg(F.count("*").alias("needed"))
    scored = hits.join(checked(df), "term").join(checked(distinct), "term")
    parts = scored.groupBy("query_id", key).agg(F.sum(_part(_idf(n, F.col("df")), F.col("f"), F.col("length"), mean)).alias("score"), F.count("*").alias("matched"))
    return parts.join(checked(needed), "query_id").where("matched = needed").select("query_id", key, "score")


def unit_score(score: Column) -> Column:
    """BM25 brought to [0, 1); what doesn't score is 0."""
    return F.when(score > 0, score / (score + HALF)).otherwise(F.lit(0.0))


def top(scores: DataFrame, key: str, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows a query, ties by key, with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


#: Letters of a file name at most.
NAME = 255


def name_hints(rows: DataFrame, key: str, path: str, terms: DataFrame) -> DataFrame:
    """query_id, key, score 1.0 of rows whose file name holds a term: plain terms as whole words, others anywhere.

    For these, a name (a few hundred letters at most) is written as its pieces
    of the lengths that the terms have, so that all meet by equality.
    """
    base = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    named = rows.select(key, base.alias("base"))
    plain = F.col("term").rlike("^[a-z0-9_]+$")
    whole = named.withColumn("term", F.explode(F.array_distinct(F.split("base", "[^a-z0-9_]+")))).join(checked(terms.where(plain)), "term").select("query_id", key)
    others = settle(terms.where(~plain).select("query_id", "term", F.char_length("term").alias("size")))
    sizes = sorted(r["size"] for r in others.where(F.col("size") <= NAME).select("size").distinct().collect())
    if sizes:
        cuts = F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.when(F.char_length("base") >= n, F.transform(F.sequence(F.lit(1), F.char_length("base") - n + 1), lambda i: F.substring("base", i, n))).otherwise(F.array().cast("array<string>"))))
        wide = named.where(F.col("base").rlike(f"[{CJK}]")).withColumn("term", F.explode(F.array_distinct(cuts))).join(checked(others.select("query_id", "term")), "term").select("query_id", key)
        whole = whole.unionByName(wide)
    return whole.distinct().select("query_id", key, F.lit(1.0).alias("score"))

"""Lexical, vector and fused retrieval; evidence; selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.functions.text import ascii_tokens, concepts, tag_key, with_features
from cinequarry.functions.pruning import pruned_nearest
from cinequarry.functions.vectors import nearest
from cinequarry.functions.vocabulary import VOCABULARY, compile_queries, named
from cinequarry.operators import fusion, lexical
from cinequarry.operators.evidence import evidence, gate, observations
from cinequarry.operators.selection import diversify
from cinequarry.plans.scratch import scratch_path, settle

from .common import registry, table

QUERIES, ORACLES, register = registry()

TERMS = [(1, "the"), (1, "and"), (2, "thing"), (3, "de"), (3, "la"), (4, "und"), (4, "der"), (5, "licensed")]
_TERMS = ", ".join(f"({q}::BIGINT, '{t}')" for q, t in TERMS)
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_TITLE, _BODY = "split_part(text, chr(10), 1)", "substr(text, length(split_part(text, chr(10), 1)) + 1)"


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "query_id long, term string")


def _title_and_body(docs: DataFrame) -> dict:
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return {"title": ascii_tokens(title), "body": ascii_tokens(F.substr(F.col("text"), F.char_length(title) + 1))}


def _bm25_sql(fields: list[tuple[str, float]], terms: str = _TERMS) -> str:
    tokens = ", ".join(f"{_TOK.format(sql)} AS t{i}" for i, (sql, _) in enumerate(fields))
    length = " + ".join(f"len(t{i})" for i in range(len(fields)))
    hits = " UNION ALL ".join(f"SELECT doc_id, d, unnest(t{i}) AS term, {w} AS w FROM docs" for i, (_, w) in enumerate(fields))
    return f"""terms(query_id, term) AS (VALUES {terms}),
        toks AS (SELECT doc_id, {tokens} FROM documents), docs AS (SELECT *, {length} AS d FROM toks),
        stats AS (SELECT count(*) AS n, avg(d) AS mean FROM docs),
        f AS (SELECT doc_id, d, term, sum(w) AS f FROM ({hits}) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, d, term),
        df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, stats),
        need AS (SELECT query_id, count(*) AS needed FROM terms GROUP BY query_id),
        lex AS (SELECT query_id, doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score
                FROM f JOIN terms USING (term) JOIN idf USING (term) JOIN need USING (query_id), stats
                GROUP BY query_id, doc_id, needed HAVING count(*) = needed)"""


@register(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY doc_id, token")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", {"body": ascii_tokens("text")}).select("doc_id", "token", "tf")


_POSITIONED = f"""tok AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS i, len(t) AS d FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)),
    phr(query_id, phrase, a, b) AS (VALUES (1::BIGINT, 0, 'of', 'the'), (2::BIGINT, 0, 'in', 'the'), (2::BIGINT, 1, 'de', 'la'), (3::BIGINT, 0, 'thing', NULL)),
    hit AS (SELECT p.query_id, p.phrase, x.doc_id, count(*) AS f FROM tok x JOIN phr p ON x.token = p.a LEFT JOIN tok y ON y.doc_id = x.doc_id AND y.i = x.i + 1 AND y.token = p.b WHERE p.b IS NULL OR y.i IS NOT NULL GROUP BY ALL)"""


@register(f"""WITH {_POSITIONED}, len AS (SELECT doc_id, len({_TOK.format('text')}) AS d FROM documents), st AS (SELECT count(*) AS n, avg(d) AS mean FROM len), df AS (SELECT query_id, phrase, count(*) AS df FROM hit GROUP BY ALL), need AS (SELECT query_id, count(*) AS needed FROM phr GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score, count(*) AS matched FROM hit JOIN df USING (query_id, phrase) JOIN len USING (doc_id), st GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score FROM s JOIN need USING (query_id) WHERE matched = needed""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of one and two words, all of which a document must hold, over a positional index that is written first."""
    asked = spark.createDataFrame([(1, 0, 0, "of"), (1, 0, 1, "the"), (2, 0, 0, "in"), (2, 0, 1, "the"), (2, 1, 0, "de"), (2, 1, 1, "la"), (3, 0, 0, "thing")], "query_id long, phrase int, place int, token string")
    index = lexical.write_index(table(spark, sf_dir, "documents"), "doc_id", {"body": ascii_tokens("text")}, scratch_path(spark))
    return lexical.search_index(index, asked).withColumn("score", F.round("score", 6))


@register(f"WITH {_bm25_sql([('text', 1.0)])} SELECT query_id, doc_id, round(score, 6) AS score FROM lex")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", {"body": ascii_tokens("text")}, _terms(spark)).withColumn("score", F.round("score", 6))


@register(f"""WITH {_bm25_sql([('text', 1.0)])}
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score / (score + 2.2), 6) AS score FROM lex)) WHERE rank <= 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lexical.bm25(table(spark, sf_dir, "documents"), "doc_id", {"body": ascii_tokens("text")}, _terms(spark))
    return lexical.top(scores.withColumn("score", F.round(lexical.unit_score(F.col("score")), 6)), "doc_id", 20)


@register(f"""WITH {_bm25_sql([('text', 1.0)])}
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score / (score + 2.2), 6) AS score FROM lex WHERE query_id > 1)) WHERE rank <= 20""")
def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written index of which only the blocks are read that can hold one of the first."""
    index = lexical.write_index(table(spark, sf_dir, "documents"), "doc_id", {"body": ascii_tokens("text")}, scratch_path(spark))
    asked = _terms(spark).where("query_id > 1").withColumnRenamed("term", "token")
    found, _ = lexical.top_index(index, asked, 60)  # more than are shown, as rounding makes ties
    return lexical.top(found.drop("rank").withColumn("score", F.round(lexical.unit_score(F.col("score")), 6)), "doc_id", 20)


@register(f"""WITH {_bm25_sql([(_TITLE, 2.5), (_BODY, 0.8)])} SELECT query_id, doc_id, round(score, 6) AS score FROM lex""")
def bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical.bm25(docs, "doc_id", _title_and_body(docs), _terms(spark), {"title": 2.5, "body": 0.8}).withColumn("score", F.round("score", 6))


_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT * FROM vec WHERE id % 20 = 0), cos AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM q, vec c WHERE q.id <> c.id)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated query set: those whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where("id % 20 = 0")


@register(f"WITH {_VEC} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos WHERE score > 0) WHERE rank <= 20")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(*_vectors(spark, sf_dir), k=20)


@register(f"WITH {_VEC} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos WHERE score > 0) WHERE rank <= 20")
def embedding_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, without comparing a query with the blocks that can't hold one of its neighbours."""
    return pruned_nearest(*_vectors(spark, sf_dir), k=20)[0]


@register(f"WITH {_VEC}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM cos WHERE score > 0) SELECT query_id, id, score FROM top WHERE rank <= 50 AND score >= 0.8 * best")
def embedding_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(*_vectors(spark, sf_dir), k=50)
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    return found.join(best, "query_id").where("score >= 0.8 * best").select("query_id", "id", "score")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits of the term queries, and neighbours of the vectors with the queries' ids; documents and vectors share ids."""
    docs = table(spark, sf_dir, "documents")
    lex = lexical.bm25(docs, "doc_id", {"body": ascii_tokens("text")}, _terms(spark)).select("query_id", F.col("doc_id").alias("id"), F.lit("lexical").alias("signal"), F.round(lexical.unit_score(F.col("score")), 6).alias("score"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.join(F.broadcast(_terms(spark).select(F.col("query_id").alias("id")).distinct()), "id", "left_semi")
    sem = nearest(rows, queries, k=200).select("query_id", "id", F.lit("semantic").alias("signal"), "score")
    return lex.unionByName(sem)


_CHANNELS = f"""{_bm25_sql([('text', 1.0)])},
    vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    cos AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM vec q, vec c WHERE q.id IN (SELECT query_id FROM terms) AND q.id <> c.id),
    ch AS (SELECT query_id, doc_id AS id, 'lexical' AS signal, round(score / (score + 2.2), 6) AS score FROM lex
           UNION ALL SELECT query_id, id, 'semantic', score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cos WHERE score > 0) WHERE r <= 200),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, id) AS rank FROM ch)"""


@register(f"WITH {_CHANNELS} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM rk GROUP BY query_id, id")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_channels(spark, sf_dir), "auto", None).withColumn("score", F.round("score", 9))


@register(f"WITH {_CHANNELS} SELECT query_id, id, round(sum(CASE signal WHEN 'lexical' THEN 0.2::DOUBLE ELSE 0.45::DOUBLE END / (60 + rank)), 9) AS score FROM rk GROUP BY query_id, id")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_channels(spark, sf_dir), "semantic", None).withColumn("score", F.round("score", 9))


@register(f"""WITH {_CHANNELS}, b AS (SELECT query_id, id, round(sum(CASE signal WHEN 'lexical' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * score), 8) AS score FROM ch GROUP BY query_id, id)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE score > 0) WHERE rank <= 20""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = fusion.weighted_blend(_channels(spark, sf_dir), {"lexical": 0.3, "semantic": 0.7}).withColumn("score", F.round("score", 8))
    return lexical.top(blended, "id", 20)


@register()
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection depends on its own order; tests hold this query against a plain restatement."""
    found = nearest(*_vectors(spark, sf_dir), k=200)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("asset"), (F.col("label") % 5).alias("session"), (F.col("vec_id") * 700).alias("start_ms"))
    return diversify(found.join(rows, "id"), 20)


@register()
def hashed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by hashed concept vectors of the documents whose id is divisible by 20 (FNV-1a is beyond SQL)."""
    rows = settle(with_features(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), concepts("text").alias("terms")), "terms", keep=["id"]))
    return nearest(rows, rows.where("id % 20 = 0"), k=10)


_SHOTS = r"""shots AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') || [lower(p_type)] AS seen FROM part)"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shots: the name describes and lists the objects, the type is a tag."""
    none = F.array().cast("array<string>")
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("description"), F.array(F.lower("p_type")).alias("tags"), F.split(name, " ").alias("objects"), none.alias("actions"), none.alias("mood"))


@register(f"""WITH {_SHOTS}, needs(query_id, need, value) AS (VALUES (1::BIGINT, 'must', 'ring'), (1::BIGINT, 'must_not', 'red'), (2::BIGINT, 'must', 'economy'), (2::BIGINT, 'should', 'bolt'), (3::BIGINT, 'must', 'nothing')),
    pairs AS (SELECT n.query_id, s.id, n.need, n.value, list_contains(s.seen, n.value) AS hit FROM shots s, needs n),
    st AS (SELECT *, CASE WHEN hit THEN 'confirmed' ELSE 'unknown' END AS state FROM pairs)
    SELECT query_id, id, round(0.5 + 0.5 * count(*) FILTER (WHERE need = 'must' AND state = 'confirmed') / count(*) FILTER (WHERE need = 'must'), 6) AS score
    FROM st GROUP BY query_id, id
    HAVING count(*) FILTER (WHERE need <> 'must_not' AND hit) > 0 AND count(*) FILTER (WHERE need = 'must' AND state = 'unknown') = 0 AND count(*) FILTER (WHERE need = 'must_not' AND state = 'confirmed') = 0""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the shots that name anything a query asks for; the gate then holds them to its musts."""
    shots = _shots(spark, sf_dir)
    needs = spark.createDataFrame([(1, "must", "object", "ring"), (1, "must_not", "object", "red"), (2, "must", "object", "economy"), (2, "should", "object", "bolt"), (3, "must", "object", "nothing")], "query_id long, need string, kind string, value string")
    observed = settle(observations(shots))
    wanted = needs.where("need <> 'must_not'").select("query_id", "value").distinct()
    candidates = observed.join(F.broadcast(wanted), "value").select("query_id", "id", F.lit(1.0).alias("score")).distinct()
    proof = evidence(candidates, needs, observed)
    return gate(candidates, proof).withColumn("score", F.round("score", 6))


def _sql(text: str) -> str:
    return text.replace("'", "''")


_NAMES = [(w, concept, kind) for kind, own in VOCABULARY.items() for concept, words in own.items() for w in words if w.isascii()]
_PLAIN, _PARTS = (", ".join(f"('{_sql(w)}', '{concept}', '{kind}')" for w, concept, kind in _NAMES if w.isalnum() == plain) for plain in (True, False))


@register(f"""SELECT d.doc_id, v.kind, v.concept FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'))) AS word FROM documents) d
    JOIN (VALUES {_PLAIN}) v(word, concept, kind) USING (word)
    UNION SELECT d.doc_id, v.kind, v.concept FROM documents d, (VALUES {_PARTS}) v(word, concept, kind) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')""")
def named_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "kind", "concept")


@register(r"""SELECT item_id, trim(regexp_replace(lower(trim(text)), '[\x00-/:-`{-\x7F]+', '_', 'g'), '_') AS tag FROM benchmark""")
def tag_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tag_key("text").alias("tag"))


@register()
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations as queries: what each asks for and how it is routed."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return compile_queries(turns)[0].select("query_id", "phrase", "intent")


@register(r"""SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM (SELECT doc_id, lower(source) AS base FROM documents) d, (VALUES (1::BIGINT, 'src0'), (2::BIGINT, 'src12')) q(query_id, term) WHERE list_contains(regexp_split_to_array(base, '[^a-z0-9_]+'), term)""")
def name_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/library/"), "source").alias("path"))
    return lexical.name_hints(paths, "doc_id", "path", spark.createDataFrame([(1, "src0"), (2, "src12")], "query_id long, term string"))

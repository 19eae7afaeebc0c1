"""The training-data queries and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .centroid_clustering import cluster_vectors
from .collocations import collocations
from .decontamination import contaminated_pairs
from .exact_dedup import exact_dedup
from .html_extraction import extract_main_text
from .jaccard_join import jaccard_groups
from .license_scan import license_scan
from .lm_scoring import score_documents
from .packing import pack_documents
from .pii import KINDS, default_field, find_spans
from .sharding import shard_by_bytes
from .substring_dedup import substring_dedup


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(_read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def learned_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """The lexicon of rows whose crc32(doc_id) mod 3 is not 1."""
    return toxicity.train(docs, labels, _remainder("doc_id", 3) != 1)


def _remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), learned_toxicity(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_read(spark, sf_dir, "documents"), _remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", _remainder("doc_id", 10) == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"), default_field())
    base = F.filter("spans", lambda s: s.base)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_collocations": op12_collocations,
    "op13_pii": op13_pii,
}

#: Words of a table's texts, lower-cased; unnested lists keep their order.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "SELECT DISTINCT {id}, s FROM (SELECT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM (SELECT {id}, " + _WORDS + " AS w FROM {table}))"



def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds one after the other; a centroid is a row for each component."""
    parts = [
        """WITH v AS MATERIALIZED (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS xs FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, xs FROM v QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
            SELECT vec_id, xs, c, d FROM (SELECT vec_id, v.xs, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.xs, m.xs)])::BIGINT AS d FROM v, c{i} m)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(xs) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT c, coalesce(m.xs, c{i}.xs) AS xs
                FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS xs FROM s{i} GROUP BY c) m USING (c))""")
    return ", ".join(parts) + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m.xs, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} m USING (c)"""


_SCORED_SQL = r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        f AS MATERIALIZED (
            SELECT lang, p, k, count(*) AS f FROM (
                SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS p FROM (
                    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k))
            GROUP BY lang, p, k HAVING count(*) >= 100),
        cuts AS (SELECT lang, p, k, f, unnest(range(1, k)) AS cut, string_split(p, ' ') AS w FROM f WHERE k >= 2),
        scored AS (
            SELECT cuts.lang, cuts.p, cuts.k, cuts.f AS a, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * cuts.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts JOIN n USING (lang)
            JOIN f l ON l.lang = cuts.lang AND l.p = array_to_string(cuts.w[1:cut], ' ') JOIN f r ON r.lang = cuts.lang AND r.p = array_to_string(cuts.w[cut+1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.p ORDER BY score, cut) = 1),
        inner_ AS (SELECT DISTINCT c.lang, c.f, array_to_string(c.w[i:i+m-1], ' ') AS p
                   FROM (SELECT lang, f, w, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, f, k, string_split(p, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k >= 3)) c)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
        FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.p = s.p AND 100 * i.f >= 100 * s.a)
        QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op12_collocations": _SCORED_SQL,
    "op3_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
             bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM bad),
             words AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_jaccard_join": f"""
        WITH RECURSIVE s AS MATERIALIZED ({_SHINGLES.format(id="doc_id", table="documents")}),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             l AS MATERIALIZED (
                SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (s) JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
                GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
             r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
    """,
    "op7_decontamination": f"""
        WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
             n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN b USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING 4 * count(*) >= 3 * n_item
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}

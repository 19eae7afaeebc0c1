"""Ingest: directory scans, content fingerprints, nested transcripts, vector blobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of each of the three samples of a file.
SAMPLE = 4 << 20
# The extensions of video sources.
MEDIA = ("mov", "mp4", "m4v", "mxf", "braw", "r3d", "ari", "crm", "dng", "nev", "insv")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """path, size, modified, extension, wanted of all files with content under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "size", "modified", extension.alias("extension"), extension.isin(*extensions).alias("wanted"))


def skipped_extensions(files: DataFrame, most: int = 20) -> DataFrame:
    """extension, n of unwanted files: the first kinds in path order; all others in one row with a null extension.

    Files without an extension are skipped too, but are no kind.
    """
    counts = files.where("NOT wanted AND extension <> ''").groupBy("extension").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    first = counts.orderBy("first").limit(most).select("extension", "n")
    rest = counts.join(first.select("extension"), "extension", "left_anti").agg(F.sum("n").alias("n")).where("n IS NOT NULL")
    return first.unionByName(rest.select(F.lit(None).cast("string").alias("extension"), "n"))


def sample_offsets(size: int, sample: int = SAMPLE) -> list[int]:
    """Where the samples at the head, middle and tail begin; small files have one."""
    return sorted({0, *(at for at in (size // 2 - sample // 2, size - sample) if size > sample and at > 0)})


def fingerprint(file, size: int, sample: int = SAMPLE) -> str:
    """sha256 over the size and the samples of an open file, which is read nowhere else."""
    digest = hashlib.sha256(f"{size}:".encode())
    for at in sample_offsets(size, sample):
        file.seek(at)
        digest.update(file.read(min(sample, size - at)))
    return digest.hexdigest()


def fingerprints(spark: SparkSession, root: str, known: DataFrame | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, size, modified, fingerprint; files whose size and time are as in ``known`` keep theirs unread.

    A task opens each file and reads its samples, 12 MiB at most, whatever its size.
    """
    files = scan(spark, root, extensions or MEDIA)
    if extensions is not None:
        files = files.where("wanted")
    fresh = files if known is None else files.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")

    def mark(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for b in batches:
            marks = []
            for path, size in zip(b["path"], b["size"], strict=True):
                system, place = FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    marks.append(fingerprint(file, size))
            yield b.assign(fingerprint=marks)

    out = fresh.select("path", "size", "modified").mapInPandas(mark, "path string, size long, modified timestamp, fingerprint string")
    if known is None:
        return out
    return out.unionByName(known.join(files.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi").select("path", "size", "modified", "fingerprint"))


def asset_key(mark: Column, size: Column, modified_ns: Column) -> Column:
    """Key of an asset that doesn't depend on its path."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(mark, zero, size.cast("string"), zero, modified_ns.cast("string")), 256)


def segments(transcripts: DataFrame, key: str, column: str, aligned: DataFrame | None = None) -> DataFrame:
    """key, ordinal, start_ms, end_ms, text of JSON segment lists: real spans with text, of assets without aligned words."""
    parsed = F.from_json(F.col(column), "array<struct<start_ms:long,end_ms:long,text:string>>")
    rows = transcripts.select(key, F.posexplode(parsed).alias("ordinal", "s")).select(key, "ordinal", "s.*").where("end_ms > start_ms AND text IS NOT NULL")
    return rows if aligned is None else rows.join(aligned.select(key).distinct(), key, "left_anti")


def vectors_of_blobs(rows: DataFrame, key: str, blob: str) -> DataFrame:
    """key, vector of little-endian float32 blobs; what isn't one, or isn't finite, gives null."""

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["blob"]:
                v = np.frombuffer(raw, "<f4") if raw is not None and len(raw) and len(raw) % 4 == 0 else None
                out.append(v if v is not None and np.isfinite(v).all() else None)
            yield pd.DataFrame({key: b[key], "vector": out})

    return rows.select(key, F.col(blob).alias("blob")).mapInPandas(decode, f"{key} {dict(rows.dtypes)[key]}, vector array<float>")


def blobs_of_vectors(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, blob: vectors as little-endian float32; null where a vector is null, empty or not finite."""

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.asarray(v, "<f4").tobytes() if v is not None and len(v) and np.isfinite(np.asarray(v, "<f4")).all() else None for v in b["vector"]]
            yield pd.DataFrame({key: b[key], "blob": out})

    return rows.select(key, F.col(vector).alias("vector")).mapInPandas(encode, f"{key} {dict(rows.dtypes)[key]}, blob binary")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """query, language, intent, asset, start_ms, end_ms of a labelled corpus: ground_truth.json beside its clips.

    A row an expected span; a query without any has one with nulls. Clips that
    the folder lacks are named by ``missing``.
    """
    expected = "array<struct<asset:string,start_ms:long,end_ms:long>>"
    schema = f"queries array<struct<query:string,language:string,intent:string,expected:{expected}>>"
    listed = spark.read.schema(schema).json(f"{root}/ground_truth.json", multiLine=True).select(F.explode("queries").alias("q")).select("q.query", "q.language", "q.intent", F.explode_outer("q.expected").alias("e")).select("query", "language", "intent", "e.*")
    clips = spark.read.format("binaryFile").load(f"{root}/clips").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("asset"), F.lit(True).alias("there"))
    return listed.join(clips, "asset", "left").select("query", "language", "intent", "asset", "start_ms", "end_ms", (F.col("asset").isNotNull() & F.col("there").isNull()).alias("missing"))


def live_references(references: DataFrame, now: Column) -> DataFrame:
    """Stored query images (id, created, ttl_ms, ...) that haven't expired; the newest of an id counts."""
    newest = references.groupBy("id").agg(F.max_by(F.struct(*[c for c in references.columns if c != "id"]), "created").alias("r")).select("id", "r.*")
    return newest.where(F.unix_millis("created") + F.col("ttl_ms") > F.unix_millis(now))


def stale_embeddings(texts: DataFrame, stored: DataFrame, key: str, model: str) -> DataFrame:
    """Rows (key, text) whose text's hash under this model isn't stored, with that hash."""
    hashed = texts.withColumn("text_hash", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).withColumn("model", F.lit(model))
    return hashed.join(stored.select(key, "text_hash", "model"), [key, "text_hash", "model"], "left_anti")

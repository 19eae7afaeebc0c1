"""Versions of a table or index: a manifest names what belongs to one, and is moved into place whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """(the file system of a path, what makes its paths)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda p: jvm.org.apache.hadoop.fs.Path(p)


def size_of(spark: SparkSession, path: str) -> int:
    fs, at = files(spark, path)
    return int(fs.getContentSummary(at(path)).getLength())


def _file(path: str, version: int) -> str:
    return f"{path}/manifest-{version:08d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """All versions at a path, oldest first."""
    fs, at = files(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def commit(spark: SparkSession, path: str, version: int, body: dict) -> None:
    """Write a version's manifest aside and move it into place; a version that is there already is another writer's."""
    fs, at = files(spark, path)
    aside = f"{path}/.{uuid.uuid4().hex}"
    out = fs.create(at(aside), False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    if fs.exists(at(_file(path, version))) or not fs.rename(at(aside), at(_file(path, version))):
        fs.delete(at(aside), False)
        raise RuntimeError(f"version {version} of {path} was written by another writer")


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest) of the latest version, or of a given one."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise FileNotFoundError(f"no {'version' if version is None else f'version {version}'} at {path}")
    version = there[-1] if version is None else version
    return version, json.loads(spark.read.text(_file(path, version), wholetext=True).first()[0])


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Delete the manifests of versions before one."""
    fs, at = files(spark, path)
    for version in versions(spark, path):
        if version < before:
            fs.delete(at(_file(path, version)), False)

"""Several tables that change together: versions named by one manifest, committed by one rename.

A store is a folder. Each commit writes its tables as Parquet into folders of their own and then a manifest with the
folder of every table, put in place by a rename that fails if that version is there. So a reader sees all tables of one
version, whatever is being written; a writer that dies before the rename leaves the last version as it was; and of two
writers of one version one is told so, and may try again on what the other wrote.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed the version in between."""


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(store: str, version: int) -> str:
    return f"{store}/manifests/{version:012d}.json"


def latest(spark: SparkSession, store: str) -> int:
    """The last committed version; 0 if there is none."""
    fs, folder = _fs(spark, f"{store}/manifests")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)


def tables(spark: SparkSession, store: str, version: int | None = None) -> dict[str, str]:
    """Table to folder of a version (the last by default), all of one commit."""
    version = latest(spark, store) if version is None else version
    if not version:
        return {}
    fs, path = _fs(spark, _manifest(store, version))
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version. What is read stays as it is, until that version is purged."""
    return spark.read.parquet(tables(spark, store, version)[table])


def commit(spark: SparkSession, store: str, changes: dict[str, DataFrame | None], base: int) -> int:
    """Writes the changed tables (None: dropped) on top of version `base` and returns the new version; all of them or none.

    Raises Conflict if `base` isn't the last version any more.
    """
    held, version = tables(spark, store, base), base + 1
    for name, df in changes.items():
        held.pop(name, None)
        if df is not None:
            held[name] = f"{store}/data/{name}-{version:012d}-{uuid.uuid4().hex}"
            df.write.parquet(held[name])
    fs, final = _fs(spark, _manifest(store, version))
    _, draft = _fs(spark, f"{store}/drafts/{uuid.uuid4().hex}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(held).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {store} is there already")
    return version


def purge(spark: SparkSession, store: str, keep: int) -> list[str]:
    """Deletes manifests and table folders that none of the last `keep` versions names; returns the folders, in order.

    Manifests go first, so nothing that is still named is ever missing. Folders of writers that died go too; don't purge
    while one is writing.
    """
    last = latest(spark, store)
    kept = {f for v in range(max(1, last - keep + 1), last + 1) if _fs(spark, _manifest(store, v))[0].exists(_fs(spark, _manifest(store, v))[1]) for f in tables(spark, store, v).values()}
    for v in range(1, last - keep + 1):
        fs, path = _fs(spark, _manifest(store, v))
        fs.delete(path, False)
    fs, data = _fs(spark, f"{store}/data")
    gone = sorted(s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in {f.rpartition("/")[2] for f in kept}) if fs.exists(data) else []
    for name in gone:
        fs.delete(_fs(spark, f"{store}/data/{name}")[1], True)
    return gone

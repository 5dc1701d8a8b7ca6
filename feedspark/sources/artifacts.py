"""Offline artifacts as Parquet tables in one folder.

Writes go to a sibling folder first and are then published by rename, so a failed job never leaves
a half-written artifact behind under the final name. A whole run writes to a folder of its own, and the pointer file CURRENT is
swapped to it in one step at the end, so that a reader never meets tables of two runs.
"""
from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_removed

ARTIFACTS = {
    "processed_articles": True,   # name -> required by the online phase?
    "base_embeddings": True,
    "article_embeddings": False,
    "interactions": True,
    "user_items": True,
    "user_profiles": True,
    "cf_mean": False,
    "cf_users": False,
    "cf_items": False,
    "evaluation_report": False,
}


def artifact_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, tmp: str, final: str) -> None:
    fs, src = _hadoop_fs(spark, tmp)
    _, dst = _hadoop_fs(spark, final)
    old = None
    if fs.exists(dst):  # the old artifact stays until the new one has its name
        old = dst.suffix(".__old")
        if fs.exists(old):
            fs.delete(old, True)
        if not fs.rename(dst, old):
            raise OSError(f"could not set aside {final}")
    try:
        done, cause = fs.rename(src, dst), None
    except Py4JJavaError as e:
        done, cause = False, e
    if not done:
        if old is not None:
            fs.rename(old, dst)
        raise OSError(f"could not publish {tmp} as {final}") from cause
    if old is not None:
        fs.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def write_table(df: DataFrame, root: str, name: str) -> str:
    final = artifact_path(root, name)
    tmp = final + ".__writing"
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(tmp)
    publish(df.sparkSession, tmp, final)
    return final


def write_observed(df: DataFrame, root: str, name: str, **aggregates: Column) -> dict:
    """``write_table``; returns the values of ``aggregates`` over its rows, observed while they are written."""
    seen = Observation()
    write_table(df.observe(seen, *[a.alias(k) for k, a in aggregates.items()]), root, name)
    return seen.get


def new_snapshot(root: str) -> str:
    """Folder of a run that nothing points to yet."""
    return os.path.join(root, "runs", uuid.uuid4().hex)


def publish_snapshot(spark: SparkSession, root: str, folder: str) -> None:
    """Make ``folder`` (of ``new_snapshot``) the set that readers of ``root`` get: one rename over the pointer file."""
    fs, final = _hadoop_fs(spark, os.path.join(root, "CURRENT"))
    _, tmp = _hadoop_fs(spark, os.path.join(root, f".CURRENT-{uuid.uuid4().hex}"))
    stream = fs.create(tmp, True)
    stream.write(bytearray(os.path.basename(folder).encode()))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(final), options)


def current(spark: SparkSession, root: str) -> str:
    """The folder that ``root`` points to; ``root`` itself without a pointer."""
    if not exists(spark, os.path.join(root, "CURRENT")):
        return root
    fs, p = _hadoop_fs(spark, os.path.join(root, "CURRENT"))
    stream = fs.open(p)
    name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return os.path.join(root, "runs", name.strip())


def prune_snapshots(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the current and the ``keep`` - 1 latest other runs; returns how many."""
    fs, p = _hadoop_fs(spark, os.path.join(root, "runs"))
    if not fs.exists(p):
        return 0
    now = os.path.basename(current(spark, root))
    others = sorted(((f.getModificationTime(), f.getPath()) for f in fs.listStatus(p) if f.getPath().getName() != now), key=lambda x: -x[0])
    for _, path in others[keep - 1:]:
        fs.delete(path, True)
    return len(others[keep - 1:])


def save_cf(model, spark: SparkSession, root: str) -> None:
    """A collaborative filter: its tables."""
    for name, table in model.tables().items():
        write_table(table, root, name)


def remove_cf(spark: SparkSession, root: str) -> None:
    for name in ("cf_mean", "cf_users", "cf_items"):
        remove(spark, artifact_path(root, name))


def load_cf(spark: SparkSession, root: str):
    """The saved collaborative filter, ready to predict; None when there is none."""
    from ..operators.cf_sgd import SgdModel
    paths = [artifact_path(current(spark, root), n) for n in ("cf_mean", "cf_users", "cf_items")]
    return SgdModel(*map(spark.read.parquet, paths)) if all(exists(spark, p) for p in paths) else None


def load_artifacts(spark: SparkSession, root: str) -> tuple[dict, bool]:
    """(artifacts, ok) of the current run: required tables missing or without a schema -> ok False; optional ones -> None. Other errors
    (no right to read, a store out of reach) are raised."""
    out, ok = {}, True
    folder = current(spark, root)
    for name, required in ARTIFACTS.items():
        path = artifact_path(folder, name)
        out[name] = None
        if exists(spark, path):
            try:
                out[name] = spark.read.parquet(path)
            except AnalysisException:  # a folder without a readable table
                pass
        ok = ok and (out[name] is not None or not required)
    return out, ok


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(artifact, path, present, rows): one row per known artifact; rows from Parquet metadata."""
    rows, folder = [], current(spark, root)
    for name in ARTIFACTS:
        path = artifact_path(folder, name)
        present = exists(spark, path)
        n = spark.read.parquet(path).count() if present else None
        rows.append((name, path, present, n))
    return spark.createDataFrame(rows, "artifact string, path string, present boolean, rows long")

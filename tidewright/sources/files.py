"""Small files and folders on any store that Spark can reach, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; where a local session has none, a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file so that readers see the old or the new one, whole: beside it first, then renamed over it."""
    system, where = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(part, where):  # some stores don't rename over a file
        system.delete(where, False)
        if not system.rename(part, where):
            raise OSError(f"could not write {path}")


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder, over a file that may be there. OSError if the store refuses."""
    system, where = _at(spark, old)
    _, to = _at(spark, new)
    if system.exists(to) and system.getFileStatus(to).isFile():
        system.delete(to, False)
    if system.exists(to) or not system.rename(where, to):
        raise OSError(f"could not rename {old} to {new}")


def replace(spark: SparkSession, part: str, where: str) -> None:
    """Put a folder in another's place. The old one goes last: if the store refuses, it is put back."""
    aside = f"{where}.old"
    recover(spark, where)
    if exists(spark, where):
        rename(spark, where, aside)
    try:
        rename(spark, part, where)
    except Exception:
        recover(spark, where)
        raise
    delete(spark, aside)


def recover(spark: SparkSession, where: str) -> None:
    """After a replacement that was broken off: the old folder comes back if there is none, else it goes."""
    aside = f"{where}.old"
    if exists(spark, aside):
        if exists(spark, where):
            delete(spark, aside)
        else:
            rename(spark, aside, where)


def copy(spark: SparkSession, old: str, new: str) -> None:
    write_text(spark, new, read_text(spark, old))


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)

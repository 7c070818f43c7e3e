"""Folders and files of the shared store, by Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file; one that is there already is replaced."""
    fs, p = _path(spark, target)
    fs.delete(p, False)
    if not fs.rename(_path(spark, source)[1], p):
        raise OSError(f"can't move {source}")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file, whole or not at all: under another name first."""
    fs, p = _path(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"can't write {path}")


def get(spark: SparkSession, path: str) -> bytes:
    fs, p = _path(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()

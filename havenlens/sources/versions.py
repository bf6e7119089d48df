"""Folders that hold versions of a table: whole ones are told by their success marker."""

from __future__ import annotations

from pyspark.sql import SparkSession


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions below a path, ascending; none if the path does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder)]
    return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("version=")
                  and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def claim(spark: SparkSession, path: str, name: str) -> int:
    """A number above those of all folders name=n below a path, claimed for the caller by a file that can be created once.

    Claims lie in a folder that Spark's readers skip. The file system must create files atomically, as HDFS does.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    claims = hadoop.Path(f"{path}/_claims")
    files = claims.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(claims)
    names = [s.getPath().getName() for folder in (claims, claims.getParent()) for s in files.listStatus(folder)]
    number = max((int(n.partition("=")[2]) for n in names if n.startswith(f"{name}=")), default=0) + 1
    while not files.createNewFile(hadoop.Path(claims, f"{name}={number}")):
        number += 1
    return number


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

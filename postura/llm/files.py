"""Files in the shared folder, from tasks: any place that Arrow's file systems reach."""

from __future__ import annotations

from pyspark.sql import SparkSession

from postura.llm.common import by_value
from postura.operators.ordered import staging_path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without is on Spark's default file system, as for Spark's own readers and writers."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return place.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, with its scheme."""
    return qualified(spark, staging_path(spark))


def file_system(path: str):
    """Arrow's file system for a path with a scheme, and the path there."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        raise ValueError(f"{path} names no file system: it would lie on this machine alone")
    return fs.FileSystem.from_uri(path)


by_value(__name__)

"""Making a finished piece of work visible in one step that only one writer can win.

The marker's text is written aside, then the marker appears under its name complete or not at all: by a hard link where folders are
local, by a rename that refuses an existing name elsewhere (HDFS and other stores that rename atomically).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession, functions as F

from tarnwatch.sources.files import _hadoop_path, folder_exists


def _already_there(error: Py4JJavaError) -> bool:
    return "FileAlreadyExistsException" in error.java_exception.getClass().getName()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file `path` with this text; False if it exists, whoever made it."""
    jvm, (target, fs) = spark._jvm, _hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    aside, _ = _hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    home = fs.resolvePath(target.getParent())
    try:
        if home.toUri().getScheme() == "file":
            folder = jvm.java.io.File(home.toUri().getPath())
            one, other = (jvm.java.io.File(folder, p.getName()).toPath() for p in (target, aside))
            jvm.java.nio.file.Files.createLink(one, other)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(aside, target, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as error:
        if _already_there(error):
            return False
        raise
    finally:
        fs.delete(aside, False)


def published(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of every marker of a folder, by name."""
    if not folder_exists(spark, folder):
        return []
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows)


def children(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of last change in milliseconds) of what lies in a folder."""
    path, fs = _hadoop_path(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

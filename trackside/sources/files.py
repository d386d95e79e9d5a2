"""The few file-system moves Spark has no DataFrame call for, on any Hadoop file system."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds anything but markers such as ``_SUCCESS``."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(target))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    fs, target = _at(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(target) or [])


def matches(spark: SparkSession, pattern: str) -> bool:
    return bool(matching(spark, pattern))


def delete_files(spark: SparkSession, paths: Iterable[str]) -> int:
    gone = 0
    for path in paths:
        fs, target = _at(spark, path)
        gone += bool(fs.delete(target, False))
    return gone


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a name that nothing has yet."""
    fs, old = _at(spark, source)
    _, new = _at(spark, target)
    if fs.exists(new) or not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def delete_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return bool(fs.delete(target, True))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none where it does not exist."""
    fs, target = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's content."""
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its content, complete from the first moment; False where it exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, target = _at(spark, path)
    _, draft = _at(spark, f"{target.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)
        return False

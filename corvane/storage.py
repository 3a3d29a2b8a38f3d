"""Small files on the storage that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def local(spark: SparkSession, path: str) -> str | None:
    """The path of a file of this machine, None for other storage."""
    whole = _system(spark, path).makeQualified(_path(spark, path)).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    system, at = _system(spark, path), _path(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    stream = _system(spark, path).create(_path(spark, path), True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: readers see the old text or the new one."""
    staged = f"{path}.{uuid.uuid4().hex}"
    _write(spark, staged, text)
    if here := local(spark, path):
        os.replace(local(spark, staged), here)
    else:
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        arguments = spark._gateway.new_array(options, 1)
        arguments[0] = options.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, staged), _path(spark, path), arguments)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if there is none of that name. Of several that try at once one succeeds.

    A file is written aside and then renamed, which fails where the name is taken; on a local disk it is linked.
    """
    staged = f"{path}.{uuid.uuid4().hex}"
    _write(spark, staged, text)
    system = _system(spark, path)
    try:
        if here := local(spark, path):
            try:
                os.link(local(spark, staged), here)
            except FileExistsError:
                return False
            return True
        return not system.exists(_path(spark, path)) and system.rename(_path(spark, staged), _path(spark, path))
    finally:
        if system.exists(_path(spark, staged)):
            system.delete(_path(spark, staged), False)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no folder."""
    system, at = _system(spark, folder), _path(spark, folder)
    if not system.exists(at):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)

"""A small shared record that is replaced as a whole: numbered files, each created only once.

The record with the highest number holds. To change it, the next number is created; if someone
else was first, the change is made again on top of theirs. Readers never see half a change.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# older records that are kept for readers that listed the folder just now
KEPT = 20
# file systems whose rename may replace a file, but which have links
LINKED = ("file",)
_TRIES = 1000


def path_of(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def files_of(spark: SparkSession, name: str):
    """The file system of a path."""
    return path_of(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    files_of(spark, name).delete(path_of(spark, name), True)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    files = files_of(spark, folder)
    if not files.exists(path_of(spark, folder)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path_of(spark, folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}.json"


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number, record) that holds now; (0, None) if there is none."""
    while True:
        numbers = _numbers(spark, folder)
        if not numbers:
            return 0, None
        try:
            stream = files_of(spark, folder).open(path_of(spark, _file(folder, numbers[-1])))
        except Py4JJavaError as error:  # became old and was deleted meanwhile
            if "FileNotFound" not in str(error.java_exception):
                raise
            continue
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)


def create(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Write the record with this number; False if that number exists already."""
    jvm = spark._jvm
    files = files_of(spark, folder)
    files.mkdirs(path_of(spark, folder))
    own = path_of(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = files.create(own, True)
    stream.write(json.dumps(record).encode("utf-8"))
    stream.close()
    target = path_of(spark, _file(folder, number))
    try:
        if files.getUri().getScheme() in LINKED:
            # a link is made atomically and never replaces a file
            plain = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(plain(target), plain(own))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE  # fails if the target exists
            conf = spark._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(own, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(own, False)
    return True


def update(spark: SparkSession, folder: str, change: Callable[[dict | None], dict | None]) -> dict | None:
    """Replace the record by ``change(record)`` and return what holds then.

    ``change`` may run several times, each time with the record that held last; it must not alter
    its argument. When it returns None, the record stays.
    """
    for _ in range(_TRIES):
        number, record = latest(spark, folder)
        new = change(record)
        if new is None:
            return record
        if create(spark, folder, number + 1, new):
            for old in _numbers(spark, folder)[: -KEPT - 1]:
                delete(spark, _file(folder, old))
            return new
        time.sleep(random.uniform(0, 0.05))
    raise RuntimeError(f"{folder} was changed by others all the time")

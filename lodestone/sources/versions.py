"""Tables that are replaced as a whole: a version is written beside the others, then a pointer is moved.

    folder/versions/<name>/   the rows of a version (Parquet)
    folder/current/<number>   the pointers; the largest number counts, its file holds the version's name

A pointer is a file that is created only if it isn't there. So readers see the old version or the new one, never a part: a run that
dies before its pointer leaves the old one, and of two runs that start from the same state one fails and can be tried again. Nothing
is renamed or overwritten, which object stores don't do as one step. What no pointer names any more is removed by ``cleaned``.

Rows that failed go to a table of their own by batch; a batch that is run again replaces what it has there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import quality
from lodestone.shared import remove

#: Characters of an error that are kept.
MOST_ERROR = 2000


class Conflict(RuntimeError):
    """Another run has published first."""


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, store = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, the one that counts last; a table has as many as it was published since it was cleaned."""
    numbers = sorted(int(n) for n in _names(spark, f"{folder}/current") if n.isdigit())
    rows = {}
    for number in numbers:
        path, store = _store(spark, f"{folder}/current/{number:012d}")
        stream = store.open(path)
        try:
            rows[number] = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    return [(n, rows[n]) for n in numbers]


def _point(spark: SparkSession, folder: str, number: int, version: str) -> None:
    path, store = _store(spark, f"{folder}/current/{number:012d}")
    try:
        stream = store.create(path, False)  # fails if it is there
    except Exception as e:
        raise Conflict(f"{folder} has been published as number {number} meanwhile") from e
    stream.write(bytearray(version.encode()))
    stream.close()


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The version that counts, or None before the first."""
    known = pointers(spark, folder)
    return spark.read.parquet(f"{folder}/versions/{known[-1][1]}") if known else None


def published(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Writes change(current version) as the next version and points to it. Conflict if another run came first."""
    known = pointers(spark, folder)
    number, version = (known[-1][0] + 1 if known else 1), uuid.uuid4().hex
    before = spark.read.parquet(f"{folder}/versions/{known[-1][1]}") if known else None
    change(before).write.parquet(f"{folder}/versions/{version}")
    _point(spark, folder, number, version)
    return spark.read.parquet(f"{folder}/versions/{version}")


def replaced_documents(spark: SparkSession, folder: str, rows: DataFrame, key: str) -> DataFrame:
    """Publishes rows in place of all that the current version has of their documents. The same rows again change nothing."""
    return published(spark, folder, lambda old: rows if old is None else quality.replaced(old, rows, key))


def cleaned(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Removes all but the last pointers and the versions that none of those names; how many versions went. No run may be under way."""
    known = pointers(spark, folder)
    kept = {version for _, version in known[-keep:]}
    for number, _ in known[:-keep]:
        remove(spark, f"{folder}/current/{number:012d}")
    gone = [n for n in _names(spark, f"{folder}/versions") if n not in kept]
    for name in gone:
        remove(spark, f"{folder}/versions/{name}")
    return len(gone)


def noted_failures(rows: DataFrame, folder: str, batch: str, key: Column, error: Column, step: str) -> DataFrame:
    """Adds the rows of a batch whose error isn't null to the table of failures; returns the others, as they are.

    The batch's folder is written anew each time, so a run that died or is repeated leaves no row twice.
    """
    failed = rows.where(error.isNotNull()).select(key.cast("string").alias("key"), F.substring(error, 1, MOST_ERROR).alias("error"), F.lit(step).alias("step"))
    failed.write.mode("overwrite").parquet(f"{folder}/batch={batch}/step={step}")
    return rows.where(error.isNull())


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """key, error, step and batch of all failures."""
    return spark.read.option("basePath", folder).schema("key string, error string, batch string, step string").parquet(folder)

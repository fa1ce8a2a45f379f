"""Small records of what a loop has finished, next to its tables, so that another driver can take over."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

NAME = "manifest"


def _place(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_manifest(spark: SparkSession, folder: str, number: int, record: dict) -> None:
    """Record that step ``number`` is complete. Its tables must have been written before.

    The file gets its name when it is complete, so a record is there as a whole or not at all.
    """
    draft, system = _place(spark, f"{folder}/{NAME}/draft-{number}")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    final, _ = _place(spark, f"{folder}/{NAME}/step-{number}")
    system.delete(final, False)
    if not system.rename(draft, final):
        raise OSError(f"{final} can't be written")


def read_manifests(spark: SparkSession, folder: str) -> list[dict]:
    """The records of all complete steps, in order."""
    base, system = _place(spark, f"{folder}/{NAME}")
    if not system.exists(base):
        raise ValueError(f"{folder} holds no loop that could be resumed")
    names = [s.getPath().getName() for s in system.listStatus(base)]
    numbers = sorted(int(n.removeprefix("step-")) for n in names if n.startswith("step-"))
    return [json.loads(spark.read.text(f"{folder}/{NAME}/step-{n}", wholetext=True).first()["value"]) for n in numbers]

"""Tables written between steps.

A step whose result is read several times, or whose lineage must end, is written
as Parquet below the folder named by ``spark.checkpoint.dir``. Written files
outlive the executors that made them, so a lost executor costs only its running
tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"

_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("open scratch scopes", default=())


@dataclass
class Scratch:
    """The folders made while a :func:`scratch_scope` was open."""

    folders: list[tuple[SparkSession, str]] = field(default_factory=list)

    def release(self) -> None:
        """Delete them. DataFrames that read them can't be used any more."""
        for spark, path in self.folders:
            drop_folder(spark, path)
        self.folders.clear()


@contextlib.contextmanager
def scratch_scope() -> Iterator[Scratch]:
    """Collect the folders of all tables written inside, so that they can be deleted when
    the results that read them have been used."""
    scope = Scratch()
    token = _OPEN.set((*_OPEN.get(), scope))
    try:
        yield scope
    finally:
        _OPEN.reset(token)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. A local folder is made only in local mode."""
    root = spark.conf.get(CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="ballast-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(CONF, root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _OPEN.get():
        scope.folders.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by this module through the file system that holds it."""
    if not path.startswith(scratch_root(spark) + "/"):
        raise ValueError(f"{path} is not below the scratch folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for table in tables:
        drop_folder(table.sparkSession, table.scratch_path)

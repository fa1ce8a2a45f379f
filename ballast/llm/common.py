"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows that are ever sent to all executors.
BROADCAST_ROWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A row is told apart by these two hashes of its id and text (96 bits), so that null and
#: repeated ids need no care. Rows that agree in both columns get the same result.
ROW_KEY = ["_h1", "_h2"]


def row_key(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns).alias("_h1"), F.hash(*columns).alias("_h2")]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Of texts that are ASCII throughout, :func:`lower` does that and takes less time."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it has at most ``rows`` rows.

    Larger tables are returned as they are and meet the other side in a shuffle join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct, so that added columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(columns: Iterable[str], name: str = "_row") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def open_shared(path: str):
    """A file of the shared folder, opened for reading inside a task through the file system that holds it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker have freed, which the allocators keep otherwise."""
    gc.collect()
    trim()


def trim() -> None:
    """The same without a search for garbage in cycles, which takes longer."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, between two calls of :func:`give_back`. Workers outlive their tasks, so that
    what one step leaves in them would otherwise add to what all later steps take."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return tidy

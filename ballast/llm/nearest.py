"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector is centred, scaled to length one, turned by a random rotation and kept as the signs of its coordinates
plus two scalars (Gao and Long 2024). The inner product of a query with the code, divided by the
code's own correction scalar, estimates the true one, with an error that a bound on the angle limits. A search has two passes
over the index:

1. Codes only: the k largest lower bounds of each query, over all chunks of the index, give a threshold.
2. In each chunk, vectors whose upper bound reaches the query's threshold are reranked by the exact inner product in double
   precision.

The index is a Parquet table of chunks in the shared folder; the first pass reads none of the vectors. Queries are taken in blocks
of bounded size, each block against all chunks. A block lies in the shared folder, where the tasks read it; the bounds that they
find are rows, of which Spark keeps the k largest per query. A task compares one slice of the block with one chunk at a time.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, neither do rows without an id.
Vectors of different lengths have no inner product: each length is indexed by itself, and a query meets the rows of its own length. A
query never meets rows that carry its own id. Ties go to the smaller id. Of rows that repeat a query's id the one with the
smallest vector asks; as candidates all rows count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.llm.common import open_shared
from ballast.plans.scratch import drop_folder, materialize, new_folder, release

#: Vectors per row of the index.
CHUNK = 2048
#: Queries, and bytes of their vectors, that a task holds at a time (about, as they are dealt by a hash), and queries that meet a chunk at a time.
QUERIES = 16_384
BLOCK_BYTES = 16 << 20
SLICE = 512
#: Width of the error bound, in standard deviations of the error of a random rotation.
EPSILON = 2.5

FOUND = "query_id long, rank int, vec_id long, score double"


@dataclass
class Geometry:
    centre: np.ndarray
    rotation: np.ndarray


@dataclass
class Index:
    """chunks (d, ids, codes, scalars, vectors) and the geometry of each vector length."""

    chunks: DataFrame
    geometry: dict[int, Geometry]

    def release(self) -> None:
        release(self.chunks)


@dataclass
class Slice:
    """Queries of one length as the passes need them, and the score below which a row can't be among their k nearest."""

    ids: np.ndarray
    vectors: np.ndarray
    turned: np.ndarray
    offset: np.ndarray
    norm: np.ndarray
    limit: np.ndarray


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) of the vectors that take part; v is array<double>."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def random_rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, d) if len(column) else np.zeros((0, d))


def by_length(batch: pd.DataFrame, most: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Pieces of at most ``most`` rows whose vectors have one length."""
    for d, rows in batch.groupby(batch["v"].map(len)):
        for at in range(0, len(rows), most):
            yield int(d), rows.iloc[at : at + most]


def mean_vectors(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean over all rows of each length, from one partial sum per piece."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in by_length(batch, len(batch)):
                yield pd.DataFrame({"d": d, "i": np.arange(d), "s": matrix(part["v"], d).sum(0), "n": len(part)})

    sums = rows.select("v").mapInPandas(add, "d int, i int, s double, n long").groupBy("d", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    means: dict[int, list[float]] = {}
    for r in sums.orderBy("d", "i").collect():
        means.setdefault(r.d, []).append(r.m)
    return {d: np.array(m) for d, m in means.items()}


def build_index(rows: DataFrame, seed: int = 11) -> Index | None:
    """Index every usable row of ``rows`` (id, v). None if there is none."""
    rows = usable(rows)
    geometry = {d: Geometry(centre, random_rotation(d, seed)) for d, centre in mean_vectors(rows).items()}
    if not geometry:
        return None

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in by_length(batch, CHUNK):
                v = matrix(part["v"], d)
                r = v - geometry[d].centre
                norm = np.linalg.norm(r, axis=1)
                turned = (r / np.where(norm > 0, norm, 1)[:, None]) @ geometry[d].rotation
                fit = np.abs(turned).sum(1) / np.sqrt(d)  # inner product of the unit vector with its code
                yield pd.DataFrame({
                    "d": [d], "ids": [part["id"].to_numpy(np.int64).tobytes()], "codes": [np.packbits(turned > 0, axis=1).tobytes()],
                    "scalars": [np.stack([norm, np.where(fit > 0, fit, 1)]).astype(np.float64).tobytes()], "vectors": [v.tobytes()],
                })

    chunks = rows.mapInPandas(encode, "d int, ids binary, codes binary, scalars binary, vectors binary")
    return Index(materialize(chunks, "index"), geometry)


def write_slices(block: DataFrame) -> DataFrame:
    """The queries of a block (id, v, limit) as slices in the shared folder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in by_length(batch, SLICE):
                yield pd.DataFrame({
                    "d": [d], "ids": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [matrix(part["v"], d).tobytes()],
                    "limits": [part["limit"].to_numpy(np.float64).tobytes()],
                })

    return materialize(block.select("id", "v", "limit").mapInPandas(cut, "d int, ids binary, vectors binary, limits binary"), "queries")


def read_slices(files: list[str], geometry: dict[int, Geometry]) -> dict[int, list[Slice]]:
    """The slices of a block by vector length, read by a task. Lengths that the index has no row of are left out."""
    from pyarrow import parquet

    slices: dict[int, list[Slice]] = {}
    for path in files:
        with open_shared(path) as f:
            for row in parquet.read_table(f).to_pylist():
                if row["d"] in geometry:
                    g, v = geometry[row["d"]], np.frombuffer(row["vectors"]).reshape(-1, row["d"])
                    turned = (v @ g.rotation).astype(np.float32)
                    made = Slice(np.frombuffer(row["ids"], np.int64), v, turned, v @ g.centre, np.linalg.norm(v, axis=1), np.frombuffer(row["limits"]).copy())
                    slices.setdefault(row["d"], []).append(made)
    return slices


def chunk_bounds(chunk, asked: list[Slice]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice its number, the ids of the chunk, estimates (queries, vectors) of the inner products, and how far off they can be."""
    ids, d = np.frombuffer(chunk.ids, np.int64), chunk.d
    signs = np.unpackbits(np.frombuffer(chunk.codes, np.uint8).reshape(len(ids), -1), axis=1)[:, :d]
    norm, fit = np.frombuffer(chunk.scalars).reshape(2, -1)
    code = ((signs.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))).T
    spread = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * EPSILON / np.sqrt(max(d - 1, 1))
    for i, s in enumerate(asked):
        estimate = (s.turned @ code) * (norm / fit) + s.offset[:, None]
        yield i, ids, estimate, s.norm[:, None] * spread + 1e-5 * (1 + np.abs(estimate))


def lower_bounds(files: list[str], geometry: dict[int, Geometry], k: int) -> Callable:
    """Pass over codes: (query_id, bound), the k largest lower bounds of each query in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = read_slices(files, geometry)
        best = {d: [np.full((len(s.ids), k), -np.inf) for s in asked] for d, asked in slices.items()}
        for batch in batches:
            for chunk in batch.itertuples():
                for i, ids, estimate, off in chunk_bounds(chunk, slices.get(chunk.d, [])):
                    low = np.where(slices[chunk.d][i].ids[:, None] == ids[None, :], -np.inf, estimate - off)
                    best[chunk.d][i] = np.partition(np.concatenate([best[chunk.d][i], low], axis=1), -k, axis=1)[:, -k:]
        for d, asked in slices.items():
            for s, bound in zip(asked, best[d], strict=True):
                at = np.isfinite(bound).ravel()
                yield pd.DataFrame({"query_id": np.repeat(s.ids, k)[at], "bound": bound.ravel()[at]})

    return run


def rerank(files: list[str], geometry: dict[int, Geometry], k: int) -> Callable:
    """Pass over vectors: (query_id, vec_id, score), the k nearest of each query in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = read_slices(files, geometry)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = {d: [none] * len(asked) for d, asked in slices.items()}
        for batch in batches:
            for chunk in batch.itertuples():
                d = chunk.d
                v = np.frombuffer(chunk.vectors).reshape(-1, d)
                for i, ids, estimate, off in chunk_bounds(chunk, slices.get(d, [])):
                    s = slices[d][i]
                    at, columns = np.nonzero((estimate + off >= s.limit[:, None]) & (s.ids[:, None] != ids[None, :]))
                    if not len(at):
                        continue
                    parts = [np.einsum("ij,ij->i", s.vectors[at[n : n + 65536]], v[columns[n : n + 65536]]) for n in range(0, len(at), 65536)]
                    rows, near, scores = (np.concatenate([x, y]) for x, y in zip(best[d][i], (at, ids[columns], np.concatenate(parts)), strict=True))
                    order = np.lexsort((near, -scores, rows))
                    rows, near, scores = rows[order], near[order], scores[order]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    # What is not among the k best of a task can't be among the k best of all, and its k-th best is a limit for later chunks.
                    rows, near, scores, place = (x[place < k] for x in (rows, near, scores, place))
                    last = place == k - 1
                    s.limit[rows[last]] = np.maximum(s.limit[rows[last]], scores[last])
                    best[d][i] = (rows, near, scores)
        for d, asked in slices.items():
            for s, (rows, near, scores) in zip(asked, best[d], strict=True):
                yield pd.DataFrame({"query_id": s.ids[rows], "vec_id": near, "score": scores})

    return run


def search(index: Index | None, queries: DataFrame, k: int = 20, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query (id, v), nearest first.

    Every block of queries adds its rows to one table in the shared folder.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], FOUND)
    rows = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("m")).first()
    blocks = max(1, -(-size.n // block), -(-8 * (size.m or 0) // BLOCK_BYTES))
    dealt, folder = new_folder(spark, "asked"), new_folder(spark, "nearest")
    rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("b").write.partitionBy("b").parquet(dealt)
    asked = spark.read.schema("id long, v array<double>, b int").parquet(dealt)
    for b in range(blocks):
        search_block(index, asked.where(F.col("b") == b).select("id", "v"), k).write.mode("append").parquet(folder)
    drop_folder(spark, dealt)
    return spark.read.schema(FOUND).parquet(folder)


def search_block(index: Index, block: DataFrame, k: int) -> DataFrame:
    """The result rows of one block of queries, from all chunks."""
    asked = write_slices(block.withColumn("limit", F.lit(float("-inf"))))
    low = index.chunks.select("d", "ids", "codes", "scalars").mapInPandas(lower_bounds(asked.inputFiles(), index.geometry, k), "query_id long, bound double")
    largest = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    # The k-th largest bound; a query with fewer has no limit.
    limits = low.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= k).where(F.col("rank") == k)
    limits = limits.select(F.col("query_id").alias("id"), F.col("bound").alias("limit"))
    limited = write_slices(block.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("-inf")))))
    release(asked)
    found = index.chunks.mapInPandas(rerank(limited.inputFiles(), index.geometry, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest other rows of every row of ``embeddings`` (vec_id, embedding) whose id is divisible by ``every``."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(build_index(rows), rows.where(F.col("id") % every == 0), k)

"""Exact duplicates by an extendible-hash index on shared files.

1. *Scan.* Tasks fold texts (A-Z to lower case) and hash them. In runs of bounded size each distinct text becomes one *entry*, which
   holds the bytes; its copies in the run only refer to it. So a text that a third of all rows share is one entry per run.
2. *Directory.* The leading bits of the hash name a bucket. The directory starts with as many bits as an even spread needs and doubles, one
   more bit a round, as long as a bucket holds more than ``BUCKET_BYTES``; only overfull buckets are split, the others keep their
   depth. Hashes whose entries alone would overfill a bucket can't be split: they get a chain of overflow pages.
3. *Owners.* Entries are dealt to tasks by ranges of buckets and read in the order of their hashes. Entries of one hash are
   chained: each is compared byte by byte with the texts of the chain and joins the one it equals, or becomes a new link.
   What is left of a chain of pages, one text per page, goes through the same step again until one page holds it.
   The result, written as a table in key order, is the index: bucket, hash, place in the chain, entry, and the text of each class.

Defined results: a null text is an empty one, and all empty texts are equal. Null ids come before all others, so they stay only
where no other id does. Rows that repeat both the largest id and the text: exactly one of them stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.common import at_most, packed, unpacked
from ballast.operators.iterate import iterate_until_empty
from ballast.plans.scratch import materialize

BUCKET_BYTES = 8 << 20
#: A run of the scan ends after so many rows or bytes of entries.
RUN_ROWS = 50_000
RUN_BYTES = 32 << 20
#: Least entries of an overflow page, so that pages of very long texts still get fewer from step to step.
PAGE_ENTRIES = 16
#: Texts travel and are stored compressed, each by itself.
LEVEL = 3
#: What an entry takes besides its text.
ENTRY_BYTES = 64
HASH_BITS = 64

SCANNED = "seq bigint, entry bigint, hash bigint, text_sha256 string, body binary"
RESOLVED = "low bigint, page bigint, hash bigint, place int, entry bigint, class bigint, body binary"


def scan(documents: DataFrame, hash_bits: int = HASH_BITS, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Every row of (id, text, ...) without its text, and with the columns of ``SCANNED``: a number of its own, the entry that holds its
    folded text, hash and digest of that, and its bytes if the entry is its own. Written out."""
    others = documents.drop("text")
    schema = T.StructType([*others.schema.fields, *T.StructType.fromDDL(SCANNED).fields])
    names, passed = schema.names, others.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 33
        seen: dict[int, list[tuple[int, bytes]]] = {}
        rows = held = 0
        for batch in batches:
            texts, out = batch.column("text"), ([], [], [], [], [])
            for i in range(batch.num_rows):
                body = (texts[i].as_py() or b"").lower()  # of bytes: A-Z only
                digest = hashlib.sha256(body)
                key = signed(int.from_bytes(digest.digest()[:8], "big") >> 64 - hash_bits << 64 - hash_bits)
                chain = seen.setdefault(key, [])
                entry = next((e for e, b in chain if b == body), None)
                new = entry is None
                if new:
                    entry = seq
                    chain.append((seq, body))
                    held += len(body)
                for column, value in zip(out, (seq, entry, key, digest.hexdigest(), zstandard.compress(body, LEVEL) if new else None), strict=True):
                    column.append(value)
                seq, rows = seq + 1, rows + 1
                if rows >= run_rows or held >= run_bytes:
                    seen, rows, held = {}, 0, 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names
            )

    rows = documents.select(F.col("text").cast("binary").alias("text"), *others.columns)
    return materialize(rows.mapInArrow(read, schema), "scanned")


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def bucket_low(depth: int) -> Column:
    """The least hash of the bucket that the first ``depth`` bits name."""
    if depth == 0:
        return F.lit(-(1 << 63)).cast("bigint")
    return F.shiftleft(F.shiftright("hash", 64 - depth), 64 - depth)


def page_count(bucket_bytes: int) -> Column:
    """Pages that the entries of a hash take, given their number (n) and bytes."""
    return F.least(F.ceil(F.col("bytes") / bucket_bytes), F.ceil(F.col("n") / PAGE_ENTRIES)).cast("bigint")


def build_directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """((depth, low) of every bucket, (hash, pages) of every chained hash) for entries (hash, size)."""
    hashes = entries.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.col("size") + ENTRY_BYTES).alias("bytes"))
    hashes = materialize(hashes.withColumn("pages", page_count(bucket_bytes)), "hashes")
    single = hashes.where("pages = 1").select("hash", "bytes")
    total = single.agg(F.sum("bytes")).first()[0] or 0
    start = max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    seed = single.selectExpr("hash", "bytes", "0 as depth", "0L as low")

    def double(rows: DataFrame, number: int, n_open: int) -> DataFrame:
        depth = start + number
        rows = rows.select("hash", "bytes", F.lit(depth).alias("depth"), bucket_low(depth).alias("low"))
        fill = rows.groupBy("low").agg(F.sum("bytes").alias("fill"), F.count("*").alias("n"))
        overfull = (F.col("fill") > bucket_bytes) & (F.col("n") > 1) & F.lit(depth < 64)
        return rows.join(fill, "low").select("hash", "bytes", "depth", "low", overfull.alias("open"))

    placed = iterate_until_empty(seed, double, max_rounds=None, label="directory").emitted
    return materialize(placed.select("depth", "low").distinct(), "directory"), hashes.where("pages > 1").select("hash", "pages")


def route(entries: DataFrame, directory: DataFrame, chained: DataFrame) -> DataFrame:
    """``entries`` with the bucket (low) and the page of each: a look-up for every depth that the directory has."""
    pages = at_most(chained.withColumnRenamed("pages", "_pages"))
    found = entries.join(pages, "hash", "left").withColumn("low", F.when(F.col("_pages").isNotNull(), F.col("hash")))
    for depth in sorted(r.depth for r in directory.select("depth").distinct().collect()):
        buckets = at_most(directory.where(F.col("depth") == depth).select(F.col("low").alias("_low")))
        at = F.when(F.col("low").isNull(), bucket_low(depth))
        found = found.withColumn("_at", at).join(buckets, F.col("_at") == F.col("_low"), "left")
        found = found.withColumn("low", F.coalesce("low", "_low")).drop("_at", "_low")
    page = F.when(F.col("_pages").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("entry"), F.col("_pages")))
    return found.withColumn("page", page.cast("bigint")).drop("_pages")


def resolve(routed: DataFrame) -> DataFrame:
    """The classes of entries (low, page, hash, entry, body): owner tasks read ranges of buckets in order. Written out."""
    names = T.StructType.fromDDL(RESOLVED).names

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for batch in batches:
            bodies, out = batch.column("body"), ([], [], [])
            keys = zip(*[batch.column(c).to_pylist() for c in ("low", "page", "hash", "entry")], strict=True)
            for i, (*key, entry) in enumerate(keys):
                if key != at:
                    at, chain = key, []
                packed_body = bodies[i].as_py()
                body = zstandard.decompress(packed_body)
                place = next((p for p, (_, b) in enumerate(chain) if b == body), len(chain))
                new = place == len(chain)
                if new:
                    chain.append((entry, body))
                for column, value in zip(out, (place, chain[place][0], packed_body if new else None), strict=True):
                    column.append(value)
            low, page, hashed, entry = (batch.column(c) for c in ("low", "page", "hash", "entry"))
            made = [low, page, hashed, pa.array(out[0], pa.int32()), entry, pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names)

    rows = routed.select("low", "page", "hash", "entry", "body").repartitionByRange("low", "page")
    rows = rows.sortWithinPartitions("low", "page", "hash", "entry")
    return materialize(rows.mapInArrow(own, RESOLVED), "index")


@dataclass
class HashIndex:
    """``rows``: as scanned; ``directory`` (depth, low); ``buckets``: columns of ``RESOLVED``; ``links``: (entry, class)."""

    rows: DataFrame
    directory: DataFrame
    buckets: DataFrame
    links: DataFrame


def build_index(
    documents: DataFrame,
    bucket_bytes: int = BUCKET_BYTES,
    hash_bits: int = HASH_BITS,
    run_rows: int = RUN_ROWS,
    run_bytes: int = RUN_BYTES,
) -> HashIndex:
    """Index the texts of (id, text, ...) and resolve their entries into classes of equal texts."""
    rows = scan(documents, hash_bits, run_rows, run_bytes)
    entries = rows.where("seq = entry").select("hash", "entry", F.octet_length("body").cast("bigint").alias("size"), "body")
    directory, chained = build_directory(entries.select("hash", "size"), bucket_bytes)
    buckets = resolve(route(entries, directory, chained))
    links = buckets.select("entry", "class")
    left = buckets.join(at_most(chained), "hash").where("entry = class").select("hash", "entry", "body", "pages")
    while not left.isEmpty():
        n = left.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.octet_length("body") + ENTRY_BYTES).alias("bytes"), F.max("pages").alias("before"))
        # Different texts of one hash don't merge, so the pages are halved at least.
        n = materialize(n.select("hash", F.least(page_count(bucket_bytes), F.expr("before div 2")).alias("pages")), "pages")
        paged = left.drop("pages").join(at_most(n), "hash")
        paged = paged.withColumns({"page": F.pmod(F.xxhash64("entry"), F.col("pages")), "low": F.col("hash")})
        merged = resolve(paged)
        onward = merged.select(F.col("entry").alias("class"), F.col("class").alias("_onward"))
        links = materialize(links.join(onward, "class", "left").select("entry", F.coalesce("_onward", "class").alias("class")), "links")
        left = merged.join(at_most(n), "hash").where("entry = class and pages > 1").select("hash", "entry", "body", "pages")
    return HashIndex(rows, directory, buckets, links)


def equal_texts(index: HashIndex) -> DataFrame:
    """The rows of the index without their bytes, and (keep_id, group_size, kept) of each.

    Copies are counted per entry first, so the joins never meet more rows of a key than a run of the scan has.
    """
    per_entry = index.rows.groupBy("entry").agg(F.count("*").alias("n"), F.max(F.struct("id", "seq")).alias("best"))
    classed = materialize(per_entry.join(index.links, "entry"), "classed")
    whole = classed.groupBy("class").agg(F.sum("n").alias("group_size"), F.max("best").alias("keep"))
    per_entry = classed.select("entry", "class").join(whole, "class").select("entry", "group_size", "keep")
    kept = F.col("seq") == F.col("keep.seq")
    return index.rows.drop("body", "hash").join(per_entry, "entry").withColumns({"keep_id": F.col("keep.id"), "kept": kept}).drop("keep", "entry")


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of equal texts: that of the largest doc_id."""
    rows = documents.select(F.col("doc_id").alias("id"), "text", packed(documents))
    return equal_texts(build_index(rows)).where("kept").select(*unpacked(documents.columns))


def document_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``documents``."""
    found = equal_texts(build_index(documents.select(F.col("doc_id").alias("id"), "text")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")

"""WARC archives with an index that is written first.

Records are dealt into archives of bounded size. Their offsets, lengths, URLs and digests follow from the rows alone, so
the index table is written before the archives, which are then written as text files, one per archive. Reading takes records
from the index, sorts their byte ranges per archive, joins ranges that touch or nearly touch into one read, and cuts the records out.

Payloads that repeat are stored once: of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
page_id is a response and the others are revisits that refer to it.

Defined results: a null html is an empty payload, a null url an empty target. Null ids come after all others in the
choice of the response; rows that repeat the smallest id and the payload are all responses. Rows that are equal in all
three columns are dealt to several archives, as many as their records fill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.llm.common import at_most
from ballast.plans.scratch import materialize, new_folder

REVISIT_BYTES = 100
#: Bytes of an archive, about; a gap between two records that is read rather than skipped; and the most of one read.
ARCHIVE_BYTES = 16 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 16 << 20
#: Two line ends close each record; they are written as the line separator of a text file.
END = "\r\n\r\n"
#: Fixed values of the format.
RESPONSE = "WARC/1.1\r\nWARC-Type: response\r\n"
REVISIT = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"


@dataclass
class Archive:
    """index (archive, offset, length, page_id, url, digest, record_type, refers_to) and the folder of the archives."""

    index: DataFrame
    folder: str


def line(name: str, value: Column) -> Column:
    """A header line; line ends inside a value would end it early, so they become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, payload_bytes, record_type, refers_to, header, payload) of (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    long = F.col("payload_bytes") >= REVISIT_BYTES
    copies = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(at_most(copies.select("digest", "least")), "digest", "left")
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("least")))
    stored = F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.when(again, F.lit(REVISIT)).otherwise(F.lit(RESPONSE)), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Payload-Length", F.col("payload_bytes")), F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("least").cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", stored), F.lit("\r\n"),
    )
    return rows.select("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", header.alias("header"), F.when(again, "").otherwise(F.col("payload")).alias("payload"))


def deal(made: DataFrame, archives: int, archive_bytes: int) -> DataFrame:
    """``made`` with the number of each record's archive.

    Records go by hash. Rows that agree in all columns agree in the hash, so they are counted, and one of them stands for
    all: its copies go in chunks of at most an archive to one archive after the other. That depends on
    counts alone, so index and archives get the same deal although each computes it for itself.
    """
    key, columns = ["tie", "tie2"], made.columns
    repeats = at_most(materialize(made.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), "warc-repeats"))
    alone = made.join(repeats, key, "left_anti").withColumn("_part", F.lit(0).cast("long"))
    some = made.join(repeats, key).groupBy(*key).agg(F.first(F.struct(*columns)).alias("_row"), F.first("_n").alias("_n"))
    some = some.withColumn("_chunk", F.greatest(F.lit(1), F.floor(F.lit(archive_bytes) / F.col("_row.size"))))
    some = some.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_chunk")))))
    # The chunks of a group leave its task before they become records.
    some = some.repartition(*key, "_part")
    copies = F.least("_chunk", F.col("_n") - F.col("_part") * F.col("_chunk"))
    some = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    dealt = alone.select(*columns, "_part").unionByName(some.select(*[F.col(f"_row.{c}").alias(c) for c in columns], "_part"))
    place = F.pmod(F.pmod("tie", F.lit(archives)) + F.col("_part"), F.lit(archives))
    return dealt.withColumn("archive", place.cast("int")).drop("_part")


def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of each archive in a batch as one compressed row."""
    for batch in batches:
        for archive, rows in batch.groupby("archive", sort=True):
            yield pd.DataFrame({
                "archive": [archive], "tie": [rows["tie"].to_numpy()], "tie2": [rows["tie2"].to_numpy()],
                "sizes": [[len(v) for v in rows["value"]]], "data": [zstandard.compress(b"".join(rows["value"]), 3)],
            })


def unbundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            data, ends = zstandard.decompress(row.data), np.cumsum(row.sizes)
            values = [bytes(data[e - n : e]) for n, e in zip(row.sizes, ends, strict=True)]
            yield pd.DataFrame({"archive": row.archive, "tie": row.tie, "tie2": row.tie2, "value": values})


def write_archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> Archive:
    """Write the index of ``pages`` (page_id, url, html), then the archives."""
    spark = pages.sparkSession
    made = records(pages)
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    made = made.withColumn("size", F.octet_length("header") + stored + len(END))
    taken = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("html", "url")]
    total = pages.agg(F.sum(taken[0] + taken[1] + 600)).first()[0] or 0
    archives = max(1, -(-int(total) // archive_bytes))
    # A record's place in its archive is the order by two hashes; equal rows are equal records, so their order is all the same.
    made = made.withColumn("tie", F.xxhash64("page_id", "url", "digest")).withColumn("tie2", F.hash("page_id", "url", "digest"))
    made = deal(made, archives, archive_bytes)
    order = ["tie", "tie2"]
    running = F.sum("size").over(Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    index = made.select(
        "archive", (running - F.col("size")).cast("long").alias("offset"), (F.col("size") - len(END)).cast("long").alias("length"),
        "page_id", "url", "digest", "payload_bytes", "record_type", "refers_to",
    )
    index = materialize(index, "warc-index")
    folder = new_folder(spark, "warc")
    # Records travel in compressed bundles, which are less than half as large as single records.
    raw = made.select("archive", *order, F.concat("header", "payload").cast("binary").alias("value"))
    bundles = raw.mapInPandas(bundle, "archive int, tie array<long>, tie2 array<int>, sizes array<int>, data binary")
    rows = bundles.repartition(archives, "archive").mapInPandas(unbundle, "archive int, tie long, tie2 int, value binary")
    text = rows.sortWithinPartitions("archive", *order).select("archive", F.col("value").cast("string").alias("value"))
    text.write.partitionBy("archive").option("lineSep", END).option("maxRecordsPerFile", 0).text(folder)
    return Archive(index, folder)


def plan_reads(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(begin, end, numbers of the ranges inside) of the reads that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if reads and offset - reads[-1][1] <= GAP_BYTES and end - reads[-1][0] <= READ_BYTES:
            begin, last, inside = reads[-1]
            reads[-1] = (begin, max(last, end), [*inside, i])
        else:
            reads.append((offset, end, [i]))
    return reads


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = payload[: int(fields["Content-Length"])]
    if len(payload) != int(fields["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    return fields, payload


def read_records(archive: Archive, selected: DataFrame) -> DataFrame:
    """Read the records of the index rows ``selected`` back from the archives.

    Returns (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to): what the records say, and for
    responses what their payloads are. The payload of a revisit is null. Archives are opened through the file
    system that holds the folder, one task for each range of an archive.
    """
    spark, folder = selected.sparkSession, archive.folder
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    files = files.select("path", F.regexp_extract("path", r"/archive=(\d+)/[^/]*$", 1).cast("int").alias("archive"))
    kind = selected.schema["page_id"].dataType.simpleString()
    wanted = selected.select("archive", "offset", "length", "page_id", "url", "refers_to").join(at_most(files), "archive")
    wanted = wanted.withColumn("slice", F.floor(F.col("offset") / READ_BYTES))

    def fetch(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        group = group.sort_values("offset", kind="stable").reset_index(drop=True)
        path = group["path"].iloc[0]
        system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        out = [None] * len(group)
        with system.open_input_file(name) as f:
            for begin, end, inside in plan_reads(list(zip(group["offset"].tolist(), group["length"].tolist(), strict=True))):
                data = f.read_at(end - begin, begin)
                for i in inside:
                    at = group["offset"].iloc[i] - begin
                    fields, payload = parse_record(data[at : at + group["length"].iloc[i]])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload does not agree with its digest")
                    size = int(fields["Payload-Length"]) if revisit else len(payload)
                    out[i] = (None if revisit else payload.decode("utf-8", "replace"), size, digest, fields["WARC-Type"])
        found = pd.DataFrame(out, columns=["payload", "payload_bytes", "payload_digest", "record_type"])
        return pd.concat([group[["page_id", "url", "refers_to"]], found], axis=1)

    return wanted.groupBy("archive", "slice").applyInPandas(
        fetch, f"page_id {kind}, url string, refers_to {kind}, payload string, payload_bytes long, payload_digest string, record_type string"
    )


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from the archives."""
    archive = write_archive(pages.select("page_id", "url", "html"))
    return read_records(archive, archive.index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

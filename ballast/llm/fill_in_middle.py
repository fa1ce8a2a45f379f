"""Fill-in-middle rewriting of texts that are kept in seekable compressed frames.

A text is written once as independent zstandard frames of ``FRAME_BYTES`` bytes each, with the units (a run of white space and the
word after it) and code points counted up to the end of each frame. Where to cut follows from the counts: only the frames that
hold a cut are decompressed to find its place. The rewritten text is streamed frame by frame into frames of its own, so that
neither it nor the text is ever whole in memory beside its compressed form, and both digests are taken from such streams.

Frames are cut at bytes, whatever characters or units they fall into: no unit or character is too long for them.

Defined results: a null text is an empty one, and an empty text stays plain with no units. A null id is drawn for as an empty one,
so rows that repeat an id are cut at the same draws, each in its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.common import packed
from ballast.plans.scratch import materialize

FRAME_BYTES = 64 << 10
#: Rows leave a task in batches of about so many bytes.
BATCH_BYTES = 16 << 20
LEVEL = 3

#: The marks, the seed, and the shares in percent of rewritten texts and, of those, of suffix-first ones.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

COUNTS = T.ArrayType(T.LongType())
FRAMES = (
    T.StructType().add("blob", T.BinaryType()).add("offsets", COUNTS).add("units", COUNTS).add("chars", COUNTS)
    .add("n", T.LongType()).add("frame_bytes", T.LongType())
)


@dataclass
class Frames:
    """Independent compressed frames and what has been counted up to the end of each.

    ``offsets``: bytes of ``blob``; ``units``: unit ends; ``chars``: code points; ``n``: units of the whole text, which is one
    more than the unit ends if the text ends with white space. All frames but the last hold ``frame_bytes`` bytes.
    """

    blob: bytes
    offsets: np.ndarray
    units: np.ndarray
    chars: np.ndarray
    n: int
    frame_bytes: int

    def frame(self, i: int) -> bytes:
        begin = int(self.offsets[i - 1]) if i else 0
        return zstandard.decompress(memoryview(self.blob)[begin : int(self.offsets[i])])

    def size(self) -> int:
        """Bytes of the text; decompresses the last frame."""
        last = len(self.offsets) - 1
        return last * self.frame_bytes + len(self.frame(last)) if last >= 0 else 0

    def unit_end(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k == 0:
            return 0, 0
        i = int(np.searchsorted(self.units, k))
        if i == len(self.units):
            return self.size(), int(self.chars[-1])
        raw = np.frombuffer(self.frame(i), np.uint8)
        at = int(unit_ends(raw, None)[k - 1 - (int(self.units[i - 1]) if i else 0)]) + 1
        return i * self.frame_bytes + at, (int(self.chars[i - 1]) if i else 0) + code_points(raw[:at])

    def stream(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``begin`` up to ``end``, frame by frame."""
        i = begin // self.frame_bytes
        while i < len(self.offsets) and (end is None or i * self.frame_bytes < end):
            raw, base = self.frame(i), i * self.frame_bytes
            yield raw[max(0, begin - base) : len(raw) if end is None else end - base]
            i += 1


def code_points(raw: np.ndarray) -> int:
    """Bytes that begin a character of UTF-8."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def unit_ends(raw: np.ndarray, following: int | None) -> np.ndarray:
    """Places of the last bytes of units, where white space, the end or ``following``, if it is white space, comes next."""
    space = SPACE[raw]
    after = np.append(space[1:], following is None or SPACE[following])
    return np.flatnonzero(~space & after)


class FrameWriter:
    """Cuts a stream of bytes into frames."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.waiting, self.compressor = frame_bytes, bytearray(), zstandard.ZstdCompressor(level=LEVEL)
        self.blob, self.offsets, self.units, self.chars, self.in_space = bytearray(), [], [], [], False

    def write(self, data: bytes) -> FrameWriter:
        view = memoryview(data)
        for begin in range(0, len(view), self.frame_bytes):
            self.waiting += view[begin : begin + self.frame_bytes]
            while len(self.waiting) > self.frame_bytes:
                self._cut(self.frame_bytes, self.waiting[self.frame_bytes])
        return self

    def _cut(self, size: int, following: int | None) -> None:
        raw = bytes(self.waiting[:size])
        del self.waiting[:size]
        seen = np.frombuffer(raw, np.uint8)
        self.blob += self.compressor.compress(raw)
        self.offsets.append(len(self.blob))
        self.units.append((self.units[-1] if self.units else 0) + len(unit_ends(seen, following)))
        self.chars.append((self.chars[-1] if self.chars else 0) + code_points(seen))
        self.in_space = bool(SPACE[seen[-1]])

    def close(self) -> Frames:
        if self.waiting:
            self._cut(len(self.waiting), None)
        n = (self.units[-1] if self.units else 0) + self.in_space
        counts = [np.array(x, np.int64) for x in (self.offsets, self.units, self.chars)]
        return Frames(bytes(self.blob), *counts, n, self.frame_bytes)


def find_marks(chunks: Iterable[bytes], marks: Iterable[bytes] = MARKS) -> dict[bytes, int]:
    """The place of the first of each mark in a stream, for those that occur."""
    found: dict[bytes, int] = {}
    left, keep, base = set(marks), max(map(len, marks)) - 1, 0
    tail = b""
    for chunk in chunks:
        data = tail + chunk
        for mark in list(left):
            if (at := data.find(mark)) >= 0:
                found[mark] = base + at
                left.discard(mark)
        tail = data[-keep:]
        base += len(data) - len(tail)
    return found


def draws(name: str, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that follow from the id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


@dataclass
class Rewritten:
    output: Frames
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def rewrite(text: Frames, name: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> Rewritten:
    """The text in prefix-suffix-middle or suffix-prefix-middle order, or as it is."""
    h1, h2, h3, h4 = draws(name, seed)
    out = FrameWriter(text.frame_bytes)

    def add(*parts: bytes | tuple[int, int | None]) -> Frames:
        for part in parts:
            for chunk in [part] if isinstance(part, bytes) else text.stream(*part):
                out.write(chunk)
        return out.close()

    if h3 % 100 >= fim_percent or not text.n or find_marks(text.stream()):
        return Rewritten(add((0, None)), "plain", None, None)
    first, second = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    (a, a_chars), (b, b_chars) = text.unit_end(first), text.unit_end(second)
    if h4 % 100 < spm_percent:
        return Rewritten(add(SUFFIX, (b, None), PREFIX, (0, a), MIDDLE, (a, b)), "spm", a_chars, b_chars - a_chars)
    return Rewritten(add(PREFIX, (0, a), SUFFIX, (b, None), MIDDLE, (a, b)), "psm", a_chars, b_chars - a_chars)


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The text behind an output, as a stream. Its parts hold no mark, so the first of each mark is the one put in."""
    if form == "plain":
        yield from output.stream()
        return
    at = find_marks(output.stream())
    begin = {m: p + len(m) for m, p in at.items()}
    end = dict(zip(order := sorted(at, key=at.get), [at[m] for m in order[1:]] + [None], strict=True))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(begin[mark], end[mark])


def sha256(chunks: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def frame_texts(documents: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(name, frames, _row) of every row: its doc_id as text, its text in frames, all its other columns. Written out."""
    others = documents.drop("text")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"), packed(others))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("frames", FRAMES), rows.schema["_row"]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done, made, size = batch.column("text"), 0, [], 0
            for i in range(batch.num_rows):
                f = FrameWriter(frame_bytes).write(texts[i].as_py() or b"").close()
                made.append(vars(f))
                size += len(f.blob)
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(done, len(made))
                    yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(made, frames_type()), part.column("_row")], ["name", "frames", "_row"])
                    done, made, size = i + 1, [], 0

    return materialize(rows.mapInArrow(write, schema), "frames")


def frames_type() -> pa.DataType:
    many = pa.list_(pa.int64())
    return pa.struct([("blob", pa.binary()), ("offsets", many), ("units", many), ("chars", many), ("n", pa.int64()), ("frame_bytes", pa.int64())])


def read_frames(value: dict) -> Frames:
    counts = [np.array(value[k], np.int64) for k in ("offsets", "units", "chars")]
    return Frames(value["blob"], *counts, value["n"], value["frame_bytes"])


RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string, output binary"


def rewrite_framed(
    framed: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, texts: bool = True
) -> DataFrame:
    """(_row, fim) of every row of :func:`frame_texts`; ``fim`` has the fields of ``RESULT``.

    ``output`` is null unless ``texts`` asks for it; the digests are taken from the frames in either case.
    """
    result = T.StructType.fromDDL(RESULT)
    schema = T.StructType([framed.schema["_row"], T.StructField("fim", result)])
    kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    kind = pa.struct([(f.name, kinds.get(f.name, pa.string())) for f in result.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, frames, done, made, size = batch.column("name"), batch.column("frames"), 0, [], 0
            for i in range(batch.num_rows):
                text = read_frames(frames[i].as_py())
                new = rewrite(text, names[i].as_py(), seed, fim_percent, spm_percent)
                output = b"".join(new.output.stream()) if texts else None
                made.append({
                    "n": text.n, "form": new.form, "prefix_chars": new.prefix_chars, "middle_chars": new.middle_chars,
                    "output_sha256": sha256(new.output.stream()), "restored_sha256": sha256(restore(new.output, new.form)), "output": output,
                })
                size += len(output or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("_row").slice(done, len(made)), pa.array(made, kind)], ["_row", "fim"])
                    done, made, size = i + 1, [], 0

    return framed.mapInArrow(run, schema)


def fill_in_middle(documents: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``documents`` with their texts rewritten, as training wants them; null texts become empty ones."""
    rows = rewrite_framed(frame_texts(documents), seed, fim_percent, spm_percent)
    return rows.select(*[F.col("fim.output").cast("string").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])


def document_rewrites(documents: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    framed = frame_texts(documents.select("doc_id", "text"))
    return rewrite_framed(framed, texts=False).select("_row.doc_id", "fim.*").drop("output")

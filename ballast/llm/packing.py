"""Packing documents into sequences of fixed length by the sum-of-squares rule.

A piece goes where the sum of squared counts of open bins per residual gap becomes smallest (Csirik et al. 2006): an
open bin with room, or a new one. Pieces are dealt by hash into groups of a bounded number of pieces, each of which one
task packs, longest first. What the groups leave underfull is dealt into fewer groups and
packed again as whole blocks, so that cutting the work costs next to no sequences.

Defined results: a null text is an empty one, which is one piece with the closing id alone. Rows that repeat an id are packed as
documents of their own, identical rows too.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import at_most, giving_back, trim
from ballast.plans.scratch import materialize

LENGTH = 2048
#: Pieces that one task packs, and underfull sequences that one task packs again.
GROUP = 50_000
#: Words whose ids a worker remembers.
REMEMBERED = 100_000
#: Bytes of texts, about, whose words are looked up together.
SLICE = 2_000_000


#: How the tokenizer that this module knows by heart parts lower-cased text into runs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for words of printable ASCII and Latin-1 letters, which are most.
PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
PLAIN_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Kinds of bytes of UTF-8: white space between words, letters, digits, other signs of plain words, what no plain word has.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: A-Z in lower case, and the first byte of Latin-1 letters, of which 0x80 to 0x9E may follow for capitals.
LOWER, LATIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), 0xC3


class Memory(dict):
    """Answers of a function of one word, asked for once each."""

    def __init__(self, answer: Callable[[str], bytes]):
        super().__init__()
        self.answer = answer

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.answer(word)
        return found

    def answers(self, words: pa.Array, most: int = REMEMBERED) -> list[bytes]:
        """The answer to each word. If then more than ``most`` are known, all but the first of these are forgotten."""
        asked = words.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.__getitem__, asked))
        if len(self) > most:
            self.clear()
            self.update(itertools.islice(zip(asked, found, strict=True), most))
        return found


class WordIds:
    """Ids of whole texts. The tokenizer never joins what white space parts, nor runs of letters with others, so the
    ids of a text are those of its words in a row. A plain word is parted into runs here, in :meth:`of_texts` all words of all
    its texts in one go over their bytes; each run is looked up once, and goes to the tokenizer's BPE
    model, which costs a third of a whole call. Other words, and all texts of a tokenizer built otherwise, go through the
    whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The state of a part is asked for, as the whole tokenizer's holds its vocabulary.
        normal, split = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.by_words = [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            (x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in split.get("pretokenizers", [])
        ] == [("Split", RUNS), ("ByteLevel", None)]
        marks = {x.content[:1] for x in self.tokenizer.get_added_tokens_decoder().values()}
        plain = "".join(re.escape(c) for c in PLAIN if c not in marks)
        self.plain = re.compile(f"[{plain}]*").fullmatch
        self.kinds = byte_kinds(marks)
        self.bytes = byte_letters()
        self.known = Memory(self.word)
        self.runs = Memory(self.run)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_words:
            return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many ids each text has. A null text has none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_words:
            found = id_lists([self(t) for t in texts.to_pylist()])
            return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())
        lengths = pc.binary_length(texts).to_numpy()
        at = np.concatenate([[0], np.cumsum(lengths)])
        if not at[-1]:
            return np.empty(0, "<u4"), lengths
        _, ends, data = texts.buffers()
        skipped = int(np.frombuffer(ends, np.int64)[texts.offset])
        low, begins, whole = self.parts(bytearray(memoryview(data)[skipped : skipped + int(at[-1])]), at[:-1])
        coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, at[-1])), pa.py_buffer(low)).dictionary_encode()
        parts, codes = pc.ascii_trim(coded.dictionary, " \n"), coded.indices.to_numpy()
        odd = np.zeros(len(parts), bool)
        odd[codes[whole]] = True
        place = np.empty(len(parts), np.int64)
        place[np.argsort(odd, kind="stable")] = np.arange(len(parts))
        each = self.runs.answers(parts.filter(pa.array(~odd)))
        if len(whole):
            each += self.known.answers(parts.filter(pa.array(odd)))
        found = id_lists(each).take(pa.array(place[codes]))
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy()[np.searchsorted(begins, at)])

    def parts(self, data: bytearray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``data``, UTF-8 of texts that begin at ``texts``, with its plain words in lower case, where in it parts begin, and which parts are
        other words. Parts are the runs of plain words and, whole, other words, each with the white space before it."""
        n, raw = len(data), np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(self.kinds), np.uint8)
        low = np.frombuffer(data.translate(LOWER) + b"\0\0", np.uint8)  # two more, to look past the end
        opens = np.zeros(n + 3, bool)
        opens[texts] = True
        latin = np.flatnonzero(raw == LATIN)
        after = low[latin + 1]
        kind[latin[(after == 0x97) | (after == 0xB7)]] = ODD  # signs for times and divided by
        low[latin[(after >= 0x80) & (after <= 0x9E)] + 1] += 0x20

        first = opens[:n].copy()
        first[1:] |= (kind[:-1] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        at = np.flatnonzero(raw == ord("'"))
        at = at[first[at] | (kind[at - 1] == SPACE)]
        at = at[~opens[at + 1]]
        a, b = low[at + 1], low[at + 2]
        two = np.isin(a, list(b"stmd"))
        three = (np.isin(a, list(b"rv")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~opens[at + 2]
        first[at[two | three] + 1] = False
        ends = np.concatenate([at[two] + 2, at[three] + 3])
        first[ends[ends < n]] = True

        inside = kind != SPACE
        if (kind == ODD).any():
            word = opens[:n] & inside
            word[1:] |= inside[1:] & ~inside[:-1]
            word = np.cumsum(word, dtype=np.int32)
            odd = np.zeros(int(word[-1]) + 1, bool)
            odd[word[kind == ODD]] = True
            inside &= odd[word]
            first[inside & ~opens[:n]] = False
            low[:n][inside] = raw[inside]
        else:
            inside[:] = False
        begins = np.flatnonzero(first)
        return low[:n], begins, np.flatnonzero(inside[np.append(begins[1:], n) - 1])

    def word(self, word: str) -> bytes:
        if not self.plain(word):
            return as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        return b"".join(map(self.runs.__getitem__, PLAIN_RUNS.findall(word.lower())))

    def run(self, run: str) -> bytes:
        letters = run if run.isascii() else run.encode().decode("latin-1").translate(self.bytes)
        return as_bytes([t.id for t in self.model.tokenize(letters)])


def id_lists(each: list[bytes]) -> pa.LargeListArray:
    ends = np.cumsum([0, *map(len, each)]) // 4
    return pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(each), "<u4"))


def as_bytes(ids: list[int]) -> bytes:
    return packer(len(ids))(*ids)


@functools.lru_cache(256)
def packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def byte_kinds(marks: set[str]) -> bytes:
    """The kind of each byte. Words with a letter of ``marks`` are not plain. What follows the first byte of a sequence counts as a letter."""
    kinds = bytearray([ODD]) * 256
    kinds[LATIN], kinds[0x80:0xC0] = LETTER, bytes([LETTER]) * 0x40
    for c in filter(str.isascii, PLAIN):
        kinds[ord(c)] = ODD if c in marks else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN
    kinds[ord(" ")] = kinds[ord("\n")] = SPACE
    return bytes(kinds)


def byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 stands for itself, the rest, in order, for what follows Latin-1."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = 0) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(tokenizer), np.array([closing], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch):
                ids, sizes = ids_of.of_texts(rows.column("text"))
                row, *made = cut_ids(ids, sizes, length, end)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), *map(pa.array, made)], names)
                del ids, sizes, row, made
                trim()

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows in a row with ``most`` bytes of text, or one row with more."""
    past = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(past):
        to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def cut_ids(ids: np.ndarray, sizes: np.ndarray, length: int, end: bytes) -> tuple[np.ndarray, ...]:
    """Row, piece, start, length and checksum of the pieces of rows with ``sizes`` ids each, and the closing id."""
    pieces = sizes // length + 1
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * length
    size = np.minimum(sizes[row] + 1 - start, length)
    last = start + size > sizes[row]
    begin = (np.cumsum(sizes) - sizes)[row] + start
    data, crc = memoryview(np.ascontiguousarray(ids)).cast("B"), np.empty(len(row), np.int64)
    for i, (b, n, closes) in enumerate(zip(begin.tolist(), size.tolist(), last.tolist(), strict=True)):
        crc[i] = zlib.crc32(end, zlib.crc32(data[4 * b : 4 * (b + n - 1)])) if closes else zlib.crc32(data[4 * b : 4 * (b + n)])
    return row, piece.astype(np.int32), start, size, crc


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, taken in the order given, and the fill of each bin.

    With N(g) open bins of gap g, a piece of size s in a bin of gap h changes the sum of squares by
    2 (N(h - s) - N(h) + 1), by 1 - 2 N(h) if it fills the bin, and by 2 N(length - s) + 1 in a new bin (by 0 if it fills that).
    Ties go to the smallest gap, and to an open bin before a new one.
    """
    count = np.zeros(length + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        gap = length
        if s < length:
            here = count[s:length]
            change = 2 * (count[0 : length - s] - here + 1)
            change[0] = 1 - 2 * here[0]
            change = np.where(here > 0, change, far)
            best = int(change.argmin())
            if change[best] <= 2 * count[length - s] + 1:
                gap = s + best
        if gap == length:
            b = len(fill)
            fill.append(0)
        else:
            b = waiting[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            count[gap - s] += 1
            waiting[gap - s].append(b)
    return bins, offsets, np.array(fill, np.int64)


def dealt(items: DataFrame, length: int, per_group: int, prefix: int) -> DataFrame:
    """(item, size) -> (item, bin, at, fill): groups dealt by a hash of the item, packed longest first."""
    groups = max(1, -(-items.count() // per_group))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], ascending=[False, True])
        bins, at, fill = sum_of_squares(frame["size"].to_numpy(), length)
        base = (prefix << 60) + (int(frame["g"].iloc[0]) << 24)
        return pd.DataFrame({"item": frame["item"].to_numpy(), "bin": base + bins, "at": at, "fill": fill[bins]})

    named = items.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)))
    return named.groupBy("g").applyInPandas(pack, "item long, bin long, at long, fill long")


def pack_pieces(cut: DataFrame, length: int = LENGTH, per_group: int = GROUP) -> DataFrame:
    """``cut`` (any columns, and length) with sequence_id and offset."""
    cut = materialize(cut.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    first = materialize(dealt(cut.select(F.col("_item").alias("item"), F.col("length").alias("size")), length, per_group, 0), "packed")
    under = first.where(F.col("fill") < length).groupBy("bin").agg(F.first("fill").alias("fill"))
    again = dealt(under.select(F.col("bin").alias("item"), F.col("fill").alias("size")), length, per_group, 1)
    moved = materialize(again.select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("at").alias("_shift")), "moved")
    placed = first.join(at_most(moved), "bin", "left").select(
        F.col("item").alias("_item"), F.coalesce("_to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("_shift", F.lit(0))).alias("offset")
    )
    return cut.join(placed, "_item").drop("_item")


def pack_documents(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    cut = pieces(documents.select("doc_id", "text"), tokenizer, length)
    return pack_pieces(cut, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Near duplicates by circulant MinHash.

A text is the set of its word shingles. One permutation spreads the shingles over a circle of 2^32
places, a second one, shifted by one place per coordinate, gives all coordinates of the signature
(Li and Li 2022), so two permutations stand for hundreds. Signatures are cut into bands; texts that agree
in a band are candidates and are confirmed on their full shingle sets.

How groups of any size stay cheap, without a limit on candidates:

1. Texts with equal sets collapse into one class first.
2. Star pass. In every bucket the class that shares most with others is the hub, and the others are compared
   with it alone. In a group of copies of one text that is the text itself, so the group becomes one
   component after as many comparisons as it has members.
3. Rest pass. Of classes that met the same hub and are still in different components, those pairs are compared that can be linked by what
   is known of both from the hub (see :func:`open_pairs`). After it every candidate pair is in one component, was compared, or
   provably isn't linked.

Defined results: a text without words has an empty set and is linked with nothing; with fewer words than a
shingle has, the whole sequence is its only shingle. Null ids have no part in the choice of the smallest id. Rows that
repeat an id and text are rows of the same class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.llm.common import LOWER, ROW_KEY, UPPER, at_most, giving_back, packed, row_key, unpacked
from ballast.llm.graph import components
from ballast.plans.scratch import materialize, release

#: 40 bands of 5: two texts at similarity 0.8 miss each other with a chance of 1.3e-7.
BANDS, ROWS = 40, 5
#: Shingles that are permuted at a time, and words whose hashes a worker remembers.
CHUNK = 2048
REMEMBERED = 300_000
SPACES = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans(UPPER, LOWER)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words_per_shingle: int):
        self.n = words_per_shingle
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = [w for w in SPACES.split((text or "").translate(FOLD)) if w]
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * A + h[i : len(h) - n + 1 + i]
        mixed *= B
        return np.unique(mixed ^ (mixed >> np.uint64(29)))


def scatter(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 2^32 places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least place, under the second permutation shifted by k, of any shingle."""
    placed = scatter((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(placed), CHUNK):
        np.minimum(least, scatter(placed[None, i : i + CHUNK] + shift, 0x7FEB352D, 0x846CA68B).min(1), out=least)
    return least


def bands_of(sign: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band; its number goes in, so that bands don't meet."""
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * B
    for column in sign.reshape(BANDS, ROWS).T.astype(np.uint64):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * A + column
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(id, text) -> (id, _h1, _h2, key, n_shingles, bands). Texts without words have a null key."""

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words_per_shingle)
        for batch in batches:
            out = {"key": [], "n_shingles": [], "bands": []}
            for text in batch["text"]:
                s = shingle(text)
                out["key"].append(set_key(s) if len(s) else None)
                out["n_shingles"].append(len(s))
                out["bands"].append(bands_of(signature(s)) if len(s) else None)
            yield pd.DataFrame({"id": batch["id"], "_h1": batch["_h1"], "_h2": batch["_h2"], **out})

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", *row_key("id", "text"), "text")
    return rows.mapInPandas(run, f"id {kind}, _h1 long, _h2 int, key binary, n_shingles long, bands array<long>")


def shingle_sets(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(text, ...) -> (key, shingles)."""

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words_per_shingle)
        for batch in batches:
            sets = [shingle(t) for t in batch["text"]]
            yield pd.DataFrame({"key": [set_key(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return rows.select("text").mapInPandas(run, "key binary, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the sizes na, nb and the number of shared shingles, ``rest`` (those of a that b lacks) and
    ``linked``: do they share ``percent`` hundredths of their union?"""
    side = lambda n: sets.select(F.col("key").alias(n), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.array_except("sa", "sb").alias("rest"))
    both = both.withColumn("shared", F.col("na") - F.size("rest"))
    return both.withColumn("linked", F.col("shared") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def open_pairs(star: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that were compared with the same hub, are in different components, and can still be linked.

    ``star`` has the comparisons of a with its hub b. With i shingles shared with the hub and a rest r each, two classes share at most
    min(i) + |common part of the rests|. So either min(i) alone is enough for a link, which limits the size of the partner,
    or the rests have a shingle in common, and then even one of their first ones, in order of frequency: a class must share at least
    ``k`` of its rest, whatever its partner, and of two sets that share k shingles the first |r| - k + 1 of each already meet. As the
    rare ones come first, common shingles stand near the end, where too little follows for a link.
    At least one of the two is outside the hub's own component, so members of a large component are never paired with each other.
    """
    named = lambda k, n: label.select(F.col("node").alias(k), F.col("label").alias(n))
    hubs = star.select("b", F.col("nb")).distinct()
    spokes = star.select(F.col("b").alias("hub"), F.col("a").alias("key"), F.col("na").alias("size"), F.col("shared").alias("i"), "rest")
    itself = hubs.select(F.col("b").alias("hub"), F.col("b").alias("key"), F.col("nb").alias("size"), F.col("nb").alias("i"), F.array().cast("array<long>").alias("rest"))
    rows = spokes.unionByName(itself).join(named("key", "own"), "key", "left").join(named("hub", "centre"), "hub", "left")
    rows = rows.withColumn("own", F.coalesce("own", "key")).withColumn("centre", F.coalesce("centre", "hub"))
    rows = rows.withColumn("outside", F.col("own") != F.col("centre"))
    open_hubs = rows.where("outside").select("hub").distinct()
    # The most that a partner's size can be if the hub's shingles are to do, and the least that it can be at all.
    rows = rows.withColumn("cap", F.expr(f"i * {100 + percent} div {percent} - size")).withColumn("least", F.expr(f"(size * {percent} + 99) div 100"))
    rows = materialize(rows.join(open_hubs, "hub", "left_semi"), "spokes")

    right = lambda *c: rows.select("hub", F.col("key").alias("b"), F.col("own").alias("other"), *c)
    left = rows.where("outside").select("hub", F.col("key").alias("a"), "own", "size", "cap", "least")
    fits = left.where("least <= cap").withColumn("partner", F.explode(F.sequence("least", F.least("cap", F.expr(f"size * 100 div {percent}")))))
    by_size = fits.join(right(F.col("size").alias("partner"), F.col("cap").alias("room")), ["hub", "partner"]).where("own <> other and size <= room")

    needed = F.greatest(F.lit(1), F.expr(f"((size + least) * {percent} + {99 + percent}) div {100 + percent} - i"))
    tokens = rows.select("hub", "key", "own", "outside", "size", "i", F.size("rest").alias("r"), (F.size("rest") - needed + 1).alias("first"), F.explode("rest").alias("token"))
    seen = tokens.groupBy("hub", "token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("hub", "key").orderBy("df", "token"))
    heads = tokens.join(seen, ["hub", "token"]).withColumn("place", place).where("place <= first and df > 1")
    # What two rests share from their first common shingle on is no more than what comes behind it in either of them.
    heads = materialize(heads.select("hub", "token", "key", "own", "outside", "size", "i", (F.col("r") - F.col("place") + 1).alias("on")), "heads")
    partners = heads.select("hub", "token", F.col("key").alias("b"), F.col("own").alias("other"), F.col("size").alias("size2"), F.col("i").alias("i2"), F.col("on").alias("on2"))
    enough = f"own <> other and (least(i, i2) + least(on, on2)) * {100 + percent} >= (size + size2) * {percent}"
    by_token = heads.where("outside").withColumnRenamed("key", "a").join(partners, ["hub", "token"]).where(enough)
    found = by_size.select("a", "b").unionByName(by_token.select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_classes(rows: DataFrame, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, text) -> (id, n_shingles, component_id, component, _h1, _h2, first): one row per row, with the smallest id reachable.

    ``component`` is the key of the class that has it, ``first`` marks the rows with that id, of one class only where several classes have it, and all rows without words.
    """
    done = materialize(sketch(rows, words_per_shingle), "sketch")
    classes = materialize(
        done.where("key is not null").groupBy("key").agg(F.min("id").alias("least_id"), F.first("bands").alias("bands")), "classes"
    )
    buckets = materialize(classes.select("key", F.explode("bands").alias("bucket")), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = materialize(buckets.join(shared, "bucket"), "members")
    release(buckets)

    wanted = members.select("key").distinct().join(classes.select("key", "least_id"), "key").select("key", "least_id")
    wanted = materialize(wanted, "wanted")
    ids = at_most(wanted.select("least_id").distinct())
    found = rows.join(ids, rows["id"].eqNullSafe(ids["least_id"]), "left_semi")
    sets = shingle_sets(found, words_per_shingle).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    sets = materialize(sets, "sets")

    weight = members.groupBy("key").agg(F.sum("m").alias("w"))
    hubs = members.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("w", "key")).alias("h"))
    star = members.join(hubs, "bucket").select(F.col("key").alias("a"), F.col("h.key").alias("b")).where("a <> b").distinct()
    star = materialize(star, "pairs")
    star = materialize(compared(star, sets, percent), "star")
    links = star.where("linked").select("a", "b")
    first = components(links)
    late = compared(open_pairs(star, first, percent), sets, percent).where("linked").select("a", "b")
    label = components(links.unionByName(materialize(late, "late")))

    named = classes.select("key", "least_id").join(label.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "least_id", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min(F.struct(F.isnull("least_id"), "least_id", "key")).alias("m"))
    named = named.join(least, "label").select("key", F.col("m.least_id").alias("component_id"), F.col("m.key").alias("component"))
    joined = done.select("id", *ROW_KEY, "key", "n_shingles").join(materialize(named, "named"), "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    first = alone | (F.col("key") == F.col("component")) & F.col("id").eqNullSafe(F.col("component_id"))
    return joined.select("id", "n_shingles", component.alias("component_id"), "component", *ROW_KEY, first.alias("first"))


def drop_near_duplicates(documents: DataFrame, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id. Rows without words all stay."""
    found = materialize(near_duplicate_classes(documents.select(F.col("doc_id").alias("id"), "text"), words_per_shingle, percent), "classified")
    with_words = found.where("n_shingles > 0")
    # A component's first class can hold one id in several texts that differ in case or white space only.
    firsts = with_words.where("first").select("component", F.struct(*ROW_KEY).alias("k"))
    best = firsts.groupBy("component").agg(F.min("k").alias("best"), F.max("k").alias("last")).where("best <> last")
    other = firsts.join(at_most(best.select("component", "best")), "component").where("k <> best").select("k.*")
    gone = materialize(with_words.where(~F.col("first")).select(*ROW_KEY).unionByName(other).distinct(), "gone")
    rows = documents.select(packed(documents), *row_key("doc_id", "text")).join(at_most(gone), ROW_KEY, "left_anti")
    repeated = with_words.where("first").groupBy(*ROW_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*ROW_KEY)
    if not repeated.isEmpty():
        again = at_most(repeated)
        once = rows.join(again, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
        rows = rows.join(again, ROW_KEY, "left_anti").unionByName(once)
    return rows.select(*unpacked(documents.columns))


def document_duplicates(documents: DataFrame, words_per_shingle: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``."""
    found = near_duplicate_classes(documents.select(F.col("doc_id").alias("id"), "text"), words_per_shingle, percent)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )

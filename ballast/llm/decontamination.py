"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (term, document, position) for every occurrence in the training
texts of a term of the test items. It is written once to the shared folder. Every window of an item is
looked up by its two rarest terms: their posting lists are shifted by the terms' places in the item and intersected,
which leaves the documents and diagonals where the window can occur. The remaining terms are then
checked on those diagonals only, and matches are maximal runs of agreeing words. Proximity matches, in which words have
moved or one is missing, come from the same lists with room around the diagonals.

Everything is DataFrame functions. Terms are looked up by a broadcast table only if a count shows that
the items' vocabulary is small; otherwise the same joins are shuffle joins.

Defined results: null and empty texts have no words and no postings; items without words match nothing; an item shorter
than a window is one window. Items with equal texts are looked up once and all named. Items without an id are
matched (they count as hits and as items) but can't be named in a list. Documents that repeat id and text
get the same result in every row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.llm.common import ROW_KEY, ascii_lower, at_most, packed, row_key, unpacked
from ballast.plans.scratch import materialize, release

#: Everything but digits, lower-case letters and characters beyond ASCII parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; an empty list for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


@dataclass
class PositionalIndex:
    """postings (term, _h1, _h2, pos) and frequency (term, tf) of the terms that were asked for; ``stored`` is what is written:
    the postings and, if a column to ``name`` the rows by was given, one row for each row, with its name and at ``pos`` its
    number of words."""

    stored: DataFrame
    frequency: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.stored.where(F.col("term") != "").drop("_name")

    def sizes(self) -> DataFrame:
        """(_name, _h1, _h2, n_words) of every row."""
        return self.stored.where(F.col("term") == "").select("_name", *ROW_KEY, F.col("pos").cast("long").alias("n_words"))

    def release(self) -> None:
        release(self.stored, self.frequency)


@dataclass
class Items:
    """ids (tid, item_id), terms (tid, size, ipos, term) of distinct texts."""

    ids: DataFrame
    terms: DataFrame


def read_items(items: DataFrame) -> Items:
    """(item_id, text) as distinct word lists and the ids that carry them."""
    lists = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("tid", F.xxhash64("w"))
    lists = materialize(lists, "items")
    texts = lists.dropDuplicates(["tid"]).select("tid", F.size("w").alias("size"), F.posexplode("w").alias("ipos", "term"))
    return Items(lists.select("tid", "item_id").distinct(), materialize(texts, "terms"))


def build_index(rows: DataFrame, terms: DataFrame, name: str | None = None) -> PositionalIndex:
    """Postings of ``terms`` (term) in ``rows`` (_h1, _h2, text), which ``name`` names.

    With a name, the empty word, which no text has, stands behind the last word of each row, so that words are parted once.
    """
    listed, asked = words(F.col("text")), terms.distinct()
    if name is None:
        tokens = rows.select(*ROW_KEY, F.posexplode(listed).alias("pos", "term"))
    else:
        listed = F.concat(listed, F.array(F.lit("")))
        tokens = rows.select(*ROW_KEY, F.col(name).alias("_name"), F.posexplode(listed).alias("pos", "term"))
        tokens = tokens.withColumn("_name", F.when(F.col("term") == "", F.col("_name")))
        asked = asked.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    stored = materialize(tokens.join(at_most(asked), "term"), "postings")
    frequency = stored.where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("tf"))
    return PositionalIndex(stored, materialize(frequency, "frequency"))


def anchors(items: Items, index: PositionalIndex, window: int) -> DataFrame:
    """(tid, size, p1, t1, p2, t2): places and terms of the two rarest words of each window.

    Windows with a term that occurs nowhere are left out, and neighbours with the same anchors are one row.
    A window of one word has no second anchor.
    """
    counted = items.terms.join(index.frequency, "term", "left")
    listed = counted.groupBy("tid", "size").agg(F.array_sort(F.collect_list(F.struct("ipos", "tf", "term"))).alias("w"))
    starts = listed.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - window + 1, F.lit(1)))))
    cut = starts.withColumn("c", F.slice("w", F.col("at"), F.least("size", F.lit(window)))).where(~F.exists("c", lambda x: x["tf"].isNull()))
    rare = cut.withColumn("r", F.array_sort(F.transform("c", lambda x: F.struct(x["tf"].alias("tf"), x["ipos"].alias("ipos"), x["term"].alias("term")))))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return rare.select(
        "tid", "size", first["ipos"].alias("p1"), first["term"].alias("t1"), second["ipos"].alias("p2"), second["term"].alias("t2")
    ).distinct()


def intersections(index: PositionalIndex, chosen: DataFrame) -> DataFrame:
    """(_h1, _h2, tid, diagonal) where both anchors of a window stand at the right distance."""
    small = at_most(chosen)
    diagonal = lambda p: (F.col("pos") - F.col(p)).alias("diagonal")
    key = [*ROW_KEY, "tid", "p1", "p2", "diagonal"]
    first = index.postings.join(small, F.col("term") == F.col("t1")).select(*ROW_KEY, "tid", "p1", "p2", diagonal("p1"))
    second = index.postings.join(small, F.col("term") == F.col("t2")).select(*ROW_KEY, "tid", "p1", "p2", diagonal("p2"))
    both = first.where("p2 is not null").join(second, key, "left_semi")
    return both.unionByName(first.where("p2 is null")).select(*ROW_KEY, "tid", "diagonal").distinct()


def phrase_matches(index: PositionalIndex, items: Items, window: int = 10) -> DataFrame:
    """Exact phrases: (_h1, _h2, tid, begin, end), maximal runs of at least ``window`` words, or of a whole
    shorter item. Positions count words of the document from 0, end exclusive."""
    found = materialize(intersections(index, anchors(items, index, window)), "diagonals")
    docs = at_most(found.select(*ROW_KEY).distinct())
    near = index.postings.join(docs, ROW_KEY, "left_semi")
    awaited = found.join(at_most(items.terms), "tid").withColumn("pos", F.col("diagonal") + F.col("ipos")).where("pos >= 0")
    agreed = awaited.join(near.distinct(), [*ROW_KEY, "pos", "term"], "left_semi")
    line = [*ROW_KEY, "tid", "diagonal"]
    runs = agreed.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*line).orderBy("ipos")))
    kept = runs.groupBy(*line, "size", "run").agg(F.min("pos").alias("begin"), F.count("*").alias("n"))
    kept = kept.where(F.col("n") >= F.least("size", F.lit(window)))
    return kept.select(*ROW_KEY, "tid", "begin", (F.col("begin") + F.col("n")).alias("end"))


def near_windows(items: Items, index: PositionalIndex, window: int, missing: int) -> DataFrame:
    """(tid, at, least, words, p1, t1, p2, t2): every window with its words that occur and their places, how many must agree, and
    one row for each pair of its rarest words, as many as leave two when those that may be missing are.
    Windows with too few words that occur, or less than two, are left out."""
    counted = items.terms.join(index.frequency, "term", "left")
    listed = counted.groupBy("tid", "size").agg(F.array_sort(F.collect_list(F.struct("ipos", "tf", "term"))).alias("w"))
    starts = listed.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - window + 1, F.lit(1)))))
    cut = starts.withColumn("c", F.slice("w", F.col("at"), F.least("size", F.lit(window))))
    there = F.filter("c", lambda x: x["tf"].isNotNull())
    rare = cut.withColumn("r", F.array_sort(F.transform(there, lambda x: F.struct(x["tf"].alias("tf"), x["ipos"].alias("ipos"), x["term"].alias("term")))))
    rare = rare.withColumn("least", F.when(F.col("size") < window, F.col("size")).otherwise(F.lit(max(2, window - missing))))
    rare = rare.where((F.size("r") >= F.col("least")) & (F.size("r") >= 2))
    plain = F.transform("r", lambda x: F.struct(x["ipos"].alias("ipos"), x["term"].alias("term")))
    rare = rare.select("tid", "at", "least", plain.alias("words"), F.slice("r", F.lit(1), F.size("c") - F.col("least") + 2).alias("heads"))
    pairs = rare.select("*", F.posexplode("heads").alias("i", "x")).select("*", F.posexplode("heads").alias("j", "y")).where("i < j")
    return pairs.selectExpr("tid", "at", "least", "words", "x.ipos as p1", "x.term as t1", "y.ipos as p2", "y.term as t2")


def proximity_matches(index: PositionalIndex, items: Items, window: int = 10, slop: int = 5, missing: int = 1) -> DataFrame:
    """(_h1, _h2, tid, at, begin, end): windows whose words stand about where they should.

    All words of the window but ``missing`` stand at most ``slop`` words from their place, counted from an occurrence of one of its
    rarest words; of an item shorter than a window all words do. Their order does not matter. Of the ``missing + 2`` rarest words two
    must then be there, so pairs of these are what is looked up. ``at`` is the window's number in the
    item, from 1; begin and end, exclusive, enclose the rare words.
    """
    windows = materialize(near_windows(items, index, window, missing), "windows")
    pairs = at_most(windows.select("tid", "p1", "t1", "p2", "t2").distinct())
    first = index.postings.join(pairs, F.col("term") == F.col("t1")).select(
        *ROW_KEY, "tid", "p1", "p2", F.col("pos").alias("x"), (F.col("pos") - F.col("p1")).alias("d1")
    )
    second = index.postings.join(pairs, F.col("term") == F.col("t2")).select(
        *ROW_KEY, "tid", "p1", "p2", F.col("pos").alias("y"), (F.col("pos") - F.col("p2")).alias("d2")
    )
    both = first.withColumn("cell", cells("d1", slop)).join(second.withColumn("cell", cell("d2", slop)), [*ROW_KEY, "tid", "p1", "p2", "cell"])
    both = both.where(F.abs(F.col("d1") - F.col("d2")) <= slop)
    spans = both.groupBy(*ROW_KEY, "tid", "p1", "p2", "d1").agg(F.min(F.least("x", "y")).alias("begin"), (F.max(F.greatest("x", "y")) + 1).alias("end"))
    spans = materialize(spans, "near-pairs")
    place = [*ROW_KEY, "tid", "at", "d1"]
    found = spans.join(at_most(windows.select("tid", "at", "p1", "p2")), ["tid", "p1", "p2"])
    found = materialize(found.groupBy(*place).agg(F.min("begin").alias("begin"), F.max("end").alias("end")), "near-found")
    whole = at_most(windows.select("tid", "at", "least", "words").distinct())
    # A few rare words tell nearly all chance pairs from matches, and have short lists; what passes is checked on all words.
    absent, all_of = F.size("words") - F.col("least"), F.size("words")
    few = F.least(all_of, F.lit(missing + 4))
    found = materialize(standing(index, found.join(whole, ["tid", "at"]), F.slice("words", F.lit(1), few), few - absent, slop), "near-few")
    return standing(index, found.join(whole, ["tid", "at"]), F.col("words"), F.col("least"), slop).select(*ROW_KEY, "tid", "at", "begin", "end")


def cell(place: str, slop: int, shift: int = 0) -> Column:
    """The cell of a place or diagonal. Cells are wide enough that what is at most ``slop`` away mostly lies in the same one."""
    return F.floor((F.col(place) + shift) / (4 * (slop + 1)))


def cells(place: str, slop: int) -> Column:
    """One row for each cell, one or two, that holds something at most ``slop`` away."""
    return F.explode(F.sequence(cell(place, slop, -slop), cell(place, slop, slop)))


def standing(index: PositionalIndex, found: DataFrame, checked: Column, need: Column, slop: int) -> DataFrame:
    """The rows (_h1, _h2, tid, at, d1, begin, end) of ``found`` of which at least ``need`` of the words ``checked`` stand
    at most ``slop`` words from their place on the diagonal d1."""
    place = [*ROW_KEY, "tid", "at", "d1"]
    rows = found.select(*place, "begin", "end", need.alias("need"), checked.alias("checked"))
    awaited = rows.select(*place, "begin", "end", "need", F.explode("checked").alias("word")).select("*", "word.ipos", "word.term").drop("word")
    awaited = awaited.withColumn("due", F.col("d1") + F.col("ipos"))
    docs, terms = at_most(found.select(*ROW_KEY).distinct()), at_most(awaited.select("term").distinct())
    near = index.postings.join(docs, ROW_KEY, "left_semi").join(terms, "term", "left_semi").withColumn("cell", cell("pos", slop)).distinct()
    around = awaited.withColumn("cell", cells("due", slop))
    agreed = around.join(near, [*ROW_KEY, "term", "cell"]).where(F.abs(F.col("pos") - F.col("due")) <= slop)
    # A word is counted once for its window, whichever cells it stands in.
    kept = [F.first(c).alias(c) for c in ("begin", "end", "need")]
    agreed = agreed.groupBy(*place, "ipos").agg(*kept)
    return agreed.groupBy(*place).agg(F.count("*").alias("n"), *kept).where("n >= need").drop("n", "need")


def hits(matches: DataFrame, items: Items) -> DataFrame:
    """(_h1, _h2, n_hit, n_items, item_ids) of the documents with matches."""
    runs = matches.select(*ROW_KEY, "begin", "end").distinct()
    before = Window.partitionBy(*ROW_KEY).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), reach))
    covered = runs.withColumn("fresh", fresh).groupBy(*ROW_KEY).agg(F.sum("fresh").alias("n_hit"))
    named = matches.select(*ROW_KEY, "tid").distinct().join(at_most(items.ids), "tid").select(*ROW_KEY, "item_id").distinct()
    listed = named.groupBy(*ROW_KEY).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return covered.join(listed, ROW_KEY)


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(_h1, _h2, n_hit, n_items, item_ids) of the rows of ``documents`` that hold benchmark windows."""
    items = read_items(benchmark)
    index = build_index(documents.select(*row_key("doc_id", "text"), "text"), items.terms.select("term"))
    found = materialize(phrase_matches(index, items, window), "matches")
    index.release()
    return materialize(hits(found, items), "hits")


def document_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 5, missing: int = 1) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of ``documents``.

    n_near counts the items of which a window stands nearby (:func:`proximity_matches`), those with exact occurrences among them
    unless they have one word only. The other columns are of exact occurrences.
    """
    items = read_items(benchmark)
    index = build_index(documents.select("doc_id", *row_key("doc_id", "text"), "text"), items.terms.select("term"), "doc_id")
    exact = materialize(phrase_matches(index, items, window), "matches")
    moved = proximity_matches(index, items, window, slop, missing).select(*ROW_KEY, "tid").distinct()
    moved = moved.join(at_most(items.ids), "tid").select(*ROW_KEY, "item_id").distinct().groupBy(*ROW_KEY).agg(F.count("*").alias("n_near"))
    moved = materialize(moved, "near")
    rows = materialize(index.sizes().withColumnRenamed("_name", "doc_id"), "sizes")
    index.release()
    found = materialize(hits(exact, items).join(moved, ROW_KEY, "full"), "hits")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ids = F.array_join(F.coalesce("item_ids", F.array().cast("array<string>")), ",")
    return rows.join(at_most(found), ROW_KEY, "left").select(
        "doc_id", "n_words", count("n_hit").alias("n_hit"), count("n_items").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (count("n_hit") > 0).alias("contaminated"), count("n_near").alias("n_near"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``documents`` without a word in an occurrence of a benchmark window."""
    found = benchmark_hits(documents, benchmark, window).select(*ROW_KEY)
    rows = documents.select(packed(documents), *row_key("doc_id", "text")).join(at_most(found), ROW_KEY, "left_anti")
    return rows.select(*unpacked(documents.columns))

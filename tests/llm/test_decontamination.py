from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from ballast.llm.common import row_key
from ballast.llm.decontamination import build_index, document_contamination, drop_contaminated, proximity_matches, read_items
from ballast.sources.tables import table
from tests.llm.cases import DOCUMENTS, documents, no_documents, words


def expected(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for k, item in items:
            v = words(item)
            n = min(window, len(v))
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    ids.add(k)
        named = ",".join(sorted(str(k) for k in ids if k is not None))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(docs, items):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in document_contamination(docs, items).select(*cols).collect()), key=repr)


def test_same_hits_as_brute_force(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    plain = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(docs, items) == plain
    assert any(r[5] for r in plain)


def test_defined_results(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten ELEVEN"),
        (2, "word"),
        (3, ""),
        (4, None),
        (10, "eight, nine... ten"),
        (10, "same id as well"),
        (11, "word"),
        (12, "x1 und wort2 und x2 und wort3 und x3 und wort4 und"),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("term", F.lit("mine"))
    docs = documents(spark)
    assert result(docs, items) == expected([(r[0], r[1]) for r in DOCUMENTS], rows)
    assert result(no_documents(spark), items) == []
    assert not any(r[5] for r in result(docs, items.limit(0)))


def test_repeated_and_overlapping_passages(spark):
    """Few different words, so that windows share anchors, repeat inside documents and overlap."""
    rng = random.Random(5)
    words_ = ["a", "b", "c", "the"]
    items = [(i, " ".join(rng.choices(words_, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    docs = [(i, " ".join(rng.choices(words_, k=rng.randrange(60)) + rng.choice(items)[1].split() * rng.randrange(3))) for i in range(80)]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == expected(docs, items)


def test_contaminated_rows_go(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = documents(spark)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3


def test_proximity_finds_words_moved_apart(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "alpha beta xx gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha " + "x " * 40 + "beta"), (3, "nothing here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", *row_key("doc_id", "text"))
    items = read_items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = build_index(df, items.terms.select("term"))
    found = proximity_matches(index, items, 10, 3).join(df, ["_h1", "_h2"])
    assert {r.doc_id for r in found.collect()} == {1}


def near_items(docs, items, window=10, slop=5, missing=1):
    """Per document the number of items with a window nearby, by trying every place."""
    texts = [words(t) for _, t in docs]
    tf = {}
    for w in texts:
        for x in w:
            tf[x] = tf.get(x, 0) + 1
    out = []
    for w in texts:
        found = set()
        for k, item in items:
            v = words(item)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if n else ():
                there = sorted((tf[v[p]], p) for p in range(a, a + n) if v[p] in tf)
                need = n if n < window else n - missing
                for _, p in there[: n - need + 1] if len(there) >= max(2, need) else ():
                    for x in (i for i, o in enumerate(w) if o == v[p]):
                        low = x - p - slop
                        if sum(v[i] in w[max(0, low + i) : max(0, low + i + 2 * slop + 1)] for _, i in there) >= need:
                            found.add(k)
        out.append(len(found))
    return out


def test_windows_nearby_as_by_brute_force(spark):
    """Inserted, replaced, dropped and swapped words, among few different words; exact columns are as they were."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 10, 14])))) for i in range(25)]
    docs = []
    for i in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(4)
            if kind == 0:
                w.insert(at, "new")
            elif kind == 1 and at < len(w):
                w[at] = "other"
            elif kind == 2 and at < len(w) > 1:
                del w[at]
            elif kind == 3:
                rng.shuffle(w)
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(30)) + w + rng.choices(vocabulary, k=rng.randrange(30)))))
    found = document_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [r.n_near for r in sorted(found.collect(), key=lambda r: r.doc_id)]
    assert got == near_items(docs, items) and any(got)
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == expected(docs, items)


def test_a_changed_passage_is_near_and_not_a_hit(spark):
    item = [f"w{i}" for i in range(15)]
    texts = [item[:7] + ["new"] + item[7:], item[:7] + ["other"] + item[8:], item[::-1], item[:5], [f"x{i}" for i in range(15)]]
    docs = spark.createDataFrame([(i, " ".join(["clean", "words", *t])) for i, t in enumerate(texts)], "doc_id long, text string")
    got = document_contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, r.n_near) for r in got.collect()) == [(0, 0, 1), (1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0)]


def test_the_plan_has_no_python(spark, data):
    plan = document_contamination(table(spark, data, "documents"), table(spark, data, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_words_are_counted_where_postings_are_made(spark):
    rows = [(1, "one two Three"), (1, "one two Three"), (2, None), (None, "ÄÖ İI four"), (3, "..."), (4, "K İ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *row_key("doc_id", "text"))
    terms = spark.createDataFrame([("one",), ("four",)], "term string")
    index = build_index(df, terms, "doc_id")
    counted = sorted(((r["_name"], r.n_words) for r in index.sizes().collect()), key=repr)
    assert counted == sorted(((i, len(words(t))) for i, t in rows), key=repr)
    assert sorted((r.term, r.pos) for r in index.postings.collect()) == [("four", 2), ("one", 0), ("one", 0)]
    assert {r.term: r.tf for r in index.frequency.collect()} == {"one": 2, "four": 1}

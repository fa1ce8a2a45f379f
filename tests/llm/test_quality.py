from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm.quality import ORDER, START, as_strings, chosen_limits, document_quality, kneser_ney, numbered, symbols, windows
from ballast.sources.tables import table
from tests.llm.cases import documents, no_documents

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "that is that", "the the the cat"]


def plain_model(texts):
    """Interpolated modified Kneser-Ney, written out: gram -> p, context -> gamma."""
    top = Counter()
    for t in texts:
        padded = START * (ORDER - 1) + t
        top.update(padded[i : i + ORDER] for i in range(len(t)))
    counts, level = {ORDER: top}, top
    for n in range(ORDER - 1, 0, -1):
        level = Counter(g[1:] for g in level)
        counts[n] = level
    p, gamma = {}, {}
    counts = {n: {g: c for g, c in x.items() if not g.endswith(START)} for n, x in counts.items()}
    p[""] = 1 / (len(counts[1]) + 1)
    for n in range(1, ORDER + 1):
        seen = Counter(counts[n].values())
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + seen[2] else None
        d = {}
        for k in (1, 2, 3):
            made = k - (k + 1) * y * seen[k + 1] / seen[k] if seen[k] and y is not None else 0.5 * k
            d[k] = max(0.1, min(k, made))
        total, off = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3)]
        for g, c in counts[n].items():
            h = g[:-1]
            gamma[h] = off[h] / total[h]
            p[g] = max(c - d[min(c, 3)], 0) / total[h] + gamma[h] * p[g[1:]]
    return p, gamma


def plain_perplexity(text, p, gamma):
    padded, total = START * (ORDER - 1) + text, 0.0
    for i in range(len(text)):
        g, weight = padded[i : i + ORDER], 1.0
        while g and g not in p:
            weight *= gamma.get(g[:-1], 1.0)
            g = g[1:]
        total += math.log(weight * p[g])
    return math.exp(-total / len(text))


def test_windows_stay_inside_texts():
    grams, number, ends = windows(TEXTS)
    strings, at = as_strings(grams), 0
    for t, end in zip(TEXTS, ends, strict=True):
        padded = START * (ORDER - 1) + t
        assert [strings[k] for k in number[at:end]] == [padded[i : i + ORDER] for i in range(len(t))]
        at = end


def test_windows_of_very_many_characters():
    texts = ["".join(map(chr, range(0x3000, 0xD7FF))), "".join(map(chr, range(0x10000, 0x10000 + 30_000))), "ab"]
    grams, number, ends = windows(texts)
    strings = as_strings(grams)
    assert [strings[k] for k in number[ends[1] :]] == [START * 3 + "a", START * 2 + "ab"]
    assert strings[number[5]] == texts[0][2:6]


def test_model_is_that_of_a_plain_version(spark):
    grams, number, _ = windows(TEXTS)
    top = Counter(as_strings(grams)[k] for k in number)
    model = kneser_ney(spark.createDataFrame([("en", g, c) for g, c in top.items()], "lang string, gram string, c long"))
    p, gamma = plain_model(TEXTS)
    rows = model.collect()
    assert {r.gram: r.p for r in rows if r.p is not None} == pytest.approx(p)
    assert {r.gram: r.gamma for r in rows if r.gamma is not None} == pytest.approx(gamma)


def test_probabilities_sum_to_one():
    p, gamma = plain_model(TEXTS)
    alphabet = [g for g in p if len(g) == 1]
    for h in ("the", "cat", " sa"):
        def prob(g):
            return p[g] if g in p else gamma.get(g[:-1], 1.0) * prob(g[1:])
        unseen = math.prod(gamma[h[i:]] for i in range(4)) * p[""]
        assert sum(prob(h + c) for c in alphabet) + unseen == pytest.approx(1)


def test_perplexities_are_those_of_a_plain_version(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS * 3)] + [(100, "zebra quiz €", "en", 0), (101, "THE  Cat\nsat 12", "en", 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("p", F.lit("mine"))
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in document_quality(docs, labels).collect()}
    import zlib

    p, gamma = plain_model([symbols(r[1]) for r in rows if r[3] and zlib.crc32(str(r[0]).encode()) % 5])
    for i, t, _, _ in rows:
        assert got[i].perplexity == pytest.approx(plain_perplexity(symbols(t), p, gamma))
        assert got[i].n_symbols == len(symbols(t)) and got[i].passed == (got[i].perplexity <= got[i].threshold)
    assert not got[100].passed


def test_defined_results(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = document_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.n_symbols == 0:
            assert r.perplexity is None and not r.passed
        elif r.lang != "en":
            assert r.perplexity is None and r.passed
        else:
            assert r.perplexity > 0
    assert document_quality(no_documents(spark), labels).collect() == []
    assert {r.passed for r in document_quality(docs, labels.limit(0)).where("n_symbols > 0").collect()} == {True}


def test_trusted_texts_pass_and_odd_ones_do_not(spark, data):
    folder = data.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    odd = docs.where("doc_id % 50 = 3").select(
        (F.col("doc_id") + 10**9).alias("doc_id"), F.expr("reverse(translate(text, 'etaoin', 'qxzjkw'))").alias("text"), "lang"
    )
    rows = document_quality(docs.select("doc_id", "text", "lang").unionByName(odd), labels).join(labels, "doc_id", "left").collect()
    good = [r.passed for r in rows if r.quality == 1 and r.toxic == 0]
    strange = [r.passed for r in rows if r.doc_id >= 10**9 and r.n_symbols > 100]
    assert sum(good) >= 0.98 * len(good)
    assert sum(strange) <= 0.05 * len(strange)


def test_limits_are_chosen_by_what_they_reject(spark):
    held = [("a", "held", float(i)) for i in range(1000)] + [("b", "held", float(i)) for i in range(1000)] + [("c", "train", 5.0)]
    rows = held + [("a", "toxic", 972.0), ("a", "low", 5000.0), ("b", "toxic", 1.0), ("b", "low", 5000.0)]
    got = {r.lang: (r.quantile, r.threshold) for r in chosen_limits(spark.createDataFrame(rows, "lang string, role string, perplexity double")).collect()}
    assert got["a"][0] == 0.97 and got["a"][1] < 972  # the highest one that rejects both
    assert got["b"][0] == 0.995 and got["c"] == (0.995, 5.0)  # nothing to gain by a lower one


def test_labelled_rows_that_are_rejected(spark, data):
    folder = data.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = document_quality(docs, labels).join(labels, "doc_id").where("n_symbols > 0 AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").collect()
    share = lambda found: sum(not r.passed for r in found) / len(found)
    assert share([r for r in rows if r.toxic == 1]) >= 0.6  # 0.12 at the 0.99 quantile times 1.25
    assert share([r for r in rows if r.toxic == 0 and r.quality == 0]) >= 0.8
    assert share([r for r in rows if r.toxic == 0 and r.quality == 1]) <= 0.03


def test_symbols_of_texts_with_other_letters():
    assert symbols("\x02É1\0 9\t\u3000İΣ 2") == " ".join("É0  0 İΣ 0".lower().split())
    assert symbols("A1\x02b\n\n9") == "a0 b 0"


def test_values_are_numbered_without_sorting_them(monkeypatch):
    values = np.random.default_rng(3).integers(0, 50, 4000).astype(np.uint64) * np.uint64(2**58)
    distinct, place = np.unique(values, return_inverse=True)
    longest, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: longest.append(len(x)) or argsort(x, *a, **b))
    monkeypatch.setattr(np, "unique", None)
    got, number = numbered(values)
    assert (got == distinct).all() and (number == place).all() and max(longest) == len(distinct)
    assert [len(x) for x in windows(["abab", "ba"])] == [6, 6, 2]

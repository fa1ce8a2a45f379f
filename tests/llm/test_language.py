from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm import language
from ballast.llm.language import ByteConvNet, document_languages, drop_unknown_language, fit_language, held_out, identify_language, train, windows_of
from ballast.sources.tables import table
from tests.llm.cases import documents, no_documents

SOME = [
    ("en", b"the quick brown fox jumps over the lazy dog and they thought that this was their house"),
    ("de", "der schnelle braune Fuchs springt über den faulen Hund und sie dachten daß dies ihr Haus wäre".encode()),
    ("fr", "le renard brun saute par dessus le chien paresseux et ils pensaient que c'était leur maison".encode()),
] * 40


@pytest.fixture(scope="module")
def model():
    return train(SOME, epochs=5)


def test_windows_cover_the_text():
    data = bytes(range(1, 256)) * 5
    assert windows_of(data).tobytes().rstrip(b"\0") == data and windows_of(b"").shape == (1, language.WINDOW)


def test_tables_give_the_convolution(model):
    x = windows_of(SOME[0][1])
    e = model.embedding[x[0]]
    peaks = []
    for w in language.WIDTHS:
        z = sum(e[j : len(e) - w + 1 + j] @ model.filters[w][j] for j in range(w))
        peaks.append(z.max(0))
    hidden = np.maximum(np.concatenate(peaks) + model.bias, 0)
    z = hidden @ model.out + model.out_bias
    assert np.allclose(model.probabilities(x, model.tables())[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    w = {"e": rng.normal(size=(256, language.EMBEDDING)), "b": rng.normal(size=36), "o": rng.normal(size=(36, 3)), "c": np.zeros(3)}
    w |= {k: rng.normal(size=(k, language.EMBEDDING, language.FILTERS)) for k in language.WIDTHS}
    x, y = rng.integers(0, 9, (4, 20)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        peak = np.concatenate([sum((w["e"] @ w[k][j])[x[:, j : j + 21 - k]] for j in range(k)).max(1) for k in language.WIDTHS], 1) + w["b"]
        p = language.softmax(np.maximum(peak, 0) @ w["o"] + w["c"])
        return -np.log(p[np.arange(4), y]).mean()

    grad = language.gradients(w, x, y)
    for name in w:
        flat, g = w[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), 6):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4, name


def test_learns_and_repeats(model):
    again = train(SOME, epochs=5)
    assert (again.out == model.out).all()
    tables = model.tables()
    assert [model.languages[model.probabilities(windows_of(d), tables).argmax()] for _, d in SOME[:3]] == ["en", "de", "fr"]


def test_defined_results(spark, model):
    rows = documents(spark).withColumn("p", identify_language(model, F.col("text"))).collect()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.p.lang == "und") == (not letters) and 0 <= r.p.score <= 1 and (r.p.score > 0) == letters
    plain = document_languages(no_documents(spark))
    assert plain.collect() == [] and plain.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in document_languages(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_are_those_of_crc32(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.sql("select cast(null as bigint) id").select(held_out(F.col("id")).alias("h")).first().h is False


def test_held_out_accuracy(spark, data):
    df = table(spark, data, "documents")
    rows = document_languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_sample_is_bounded(spark):
    df = spark.range(4000).select(F.col("id"), F.concat(F.lit("text of row "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    assert 0 < len(language.training_sample(df, 20)) <= 20 * language.WINDOWS_PER_ROW
    assert isinstance(fit_language(df, 5), ByteConvNet)


def test_only_unknown_rows_go(spark, data):
    df = table(spark, data, "documents").withColumn("_p", F.lit(1))
    odd = spark.createDataFrame([(10**9, "123 --- 456"), (10**9 + 1, None), (10**9 + 2, "")], "doc_id long, text string")
    kept = drop_unknown_language(df.unionByName(odd, allowMissingColumns=True))
    assert kept.columns == df.columns
    assert kept.where(f"doc_id >= {10**9}").count() == 0 and kept.count() >= 0.99 * df.count()

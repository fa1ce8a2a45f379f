from __future__ import annotations

import shutil

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ballast.plans.scratch import materialize
from ballast.sources.tables import table
from tests.llm.cases import documents, find_components, shingles, words


def test_stages_do_what_plain_python_does(spark, data):
    docs = table(spark, data, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, data), name)
        assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["language"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
    assert len(after) >= 0.98 * len(before)

    before, after = kept["near_duplicates"]
    rows = sorted(before, key=lambda r: r.doc_id)
    roots = find_components([shingles(r.text, 5) for r in rows])
    assert {r.doc_id for r in after} == {rows[i].doc_id for i in set(roots)}

    before, after = kept["decontaminate"]
    grams = set()
    for r in table(spark, data, "benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or {tuple(w)}
    sizes = {len(g) for g in grams if g}

    def dirty(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in after} == {r.doc_id for r in before if not dirty(r.text)}

    before, after = kept["personal_data"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    texts = {r.doc_id: r.text for r in before}
    assert any(r.text != texts[r.doc_id] for r in after) and all("@mail" not in r.text for r in after)
    assert all(r.n_chars == len(r.text) for r in after)

    packed = stages["pack"](spark, docs, data).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_odd_rows_and_no_rows_go_through(spark, data, tmp_path):
    shutil.copytree(data, tmp_path / "t", ignore=shutil.ignore_patterns("documents*"))
    for n, rows in enumerate((documents(spark), documents(spark).limit(0))):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path / "t")), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids == ({1, 5, None, 7, 8} if n == 0 else set())


def test_run_writes_every_stage(spark, data):
    made = corpus_pipeline.run(spark, data)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert made.agg(F.max("length")).first()[0] <= 2048


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "personal_data", "pack"])
def test_workers_get_small_batches_of_long_texts(spark, data, stage):
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    try:
        dict(corpus_pipeline.STAGES)[stage](spark, table(spark, data, "documents"), data)
        sizes = [r.n for r in long.mapInArrow(bytes_of, "n long").collect()]
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
    assert sum(sizes) > 20_000_000
    assert max(sizes) < 5_000_000


def test_run_keeps_the_limit_of_the_session(spark, data):
    corpus_pipeline.run(spark, data)
    assert corpus_pipeline.BATCH not in spark.conf.getAll
    spark.conf.set(corpus_pipeline.BATCH, "1m")
    try:
        corpus_pipeline.run(spark, data)
        assert spark.conf.get(corpus_pipeline.BATCH) == "1m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)

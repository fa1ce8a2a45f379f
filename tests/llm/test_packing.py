from __future__ import annotations

import inspect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ballast.llm import language, near_duplicates, packing, personal_data, quality
from ballast.llm.packing import LENGTH, WordIds, pack_documents, pack_pieces, slices, sum_of_squares
from ballast.sources.tables import table
from tests.llm.cases import documents, no_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), LENGTH)):
            cut = np.array(ids[at : at + LENGTH], "<u4").tobytes()
            out.append((i, k, at, len(cut) // 4, zlib.crc32(cut)))
    return sorted(out, key=repr)


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    return len(by)


def test_ids_of_words_are_ids_of_texts():
    t, ids = Tokenizer.from_file(PATH), WordIds(PATH)
    rng = random.Random(1)
    alphabet = "aB c\n\t1.,'sé ßΣ̈ 　\x1c<|endoftext|>日本\U0001f600-"
    texts = ["", " ", "it's  don't", "<|endoftext|>", "a <|startoftext|> b", "ΑΣ ΑΣ."] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_all_pieces_and_places(spark, data):
    df = table(spark, data, "documents")
    for source in (df, documents(spark)):
        rows = pack_documents(source, PATH).collect()
        got = sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr)
        assert got == plain_pieces([(r.doc_id, r.text) for r in source.collect()])
        n = check_places(rows)
        total = sum(r.length for r in rows)
        assert n <= 1.03 * total / LENGTH + 1
    assert pack_documents(no_documents(spark), PATH).collect() == []


def test_sum_of_squares_rule():
    bins, offsets, fill = sum_of_squares(np.array([6, 4, 5, 5, 10, 3]), 10)
    assert fill.tolist() == [10, 10, 10, 3]
    assert bins.tolist() == [0, 0, 1, 1, 2, 3] and offsets.tolist() == [0, 6, 0, 5, 0, 0]


def test_rule_is_that_of_a_plain_version():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 21, 300)
    bins, _, fill = sum_of_squares(sizes, 20)
    count, gaps = {}, []
    for s, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        def squares(h):
            c = dict(count)
            if h < 20:
                c[h] -= 1
            if h > s:
                c[h - s] = c.get(h - s, 0) + 1
            return sum(v * v for v in c.values())
        options = {h: squares(h) for h in {*[g for g, n in count.items() if n], 20} if h >= s}
        h = gaps[b] if b < len(gaps) else 20
        assert options[h] == min(options.values())
        if b == len(gaps):
            gaps.append(20)
        if h < 20:
            count[h] -= 1
        gaps[b] = h - s
        if h > s:
            count[h - s] = count.get(h - s, 0) + 1
    assert (np.bincount(bins, sizes) == fill).all() and fill.max() <= 20


def test_many_groups_cost_few_sequences(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    one = check_places(pack_pieces(df).collect())
    many = check_places(pack_pieces(df, per_group=300).collect())
    total = df.agg(F.sum("length")).first()[0]
    assert one <= 1.01 * total / LENGTH + 1 and many <= 1.02 * total / LENGTH + 1


def test_words_and_runs_are_looked_up_once(monkeypatch):
    ids, asked = WordIds(PATH), []
    for name in ("known", "runs"):
        memory = getattr(ids, name)
        monkeypatch.setattr(memory, "answer", lambda w, f=memory.answer, n=name: asked.append((n, w)) or f(w))
    text = "Été garden, garden Été\ngarden"
    plain = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids(text) + ids(text) == 2 * np.array(plain, "<u4").tobytes()
    assert len(asked) == len(set(asked)) and ("known", "garden") in asked and ("runs", "été") in asked


def test_freed_memory_goes_back_to_the_system():
    from ballast.llm.common import give_back

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    kept, held = [], []
    for i in range(200_000):  # every 50th block stays, so that the allocator keeps the pages around it
        (kept if i % 50 == 0 else held).append(bytes(1000 + i % 7))
    full = resident()
    del held
    give_back()
    assert resident() < full - 50_000_000 and len(kept) == 4000


def test_words_of_many_texts_are_looked_up_together(monkeypatch):
    t, ids, rng, asked = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(2), []
    for alphabet in ("aB \n1.,'sé ßÀ-", "aB c\n\t1.,'sé ßΣ̈ \x1c<|endoftext|>日\U0001f600-"):
        for n in (0, 1, 300):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n)]
            got, sizes = ids.of_texts(pa.array(texts, pa.string()))
            ends = [0, *np.cumsum(sizes).tolist()]
            assert [got[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    ids.runs.clear()
    monkeypatch.setattr(ids, "known", None)  # no look by word: plain words need none
    monkeypatch.setattr(ids.runs, "answer", lambda r, f=ids.runs.answer: asked.append(r) or f(r))
    ids.of_texts(pa.array(["the cat, the dog", None, "the\ncat"]))
    assert sorted(asked) == [",", "cat", "dog", "the"]


def test_batches_are_cut_by_bytes_and_no_row_is_lost():
    batch = pa.RecordBatch.from_pydict({"doc_id": [3, None, 5, 6, 7], "text": ["é" * 4, None, "abc", "x" * 50, ""]})
    parts = list(slices(batch, 11))
    assert [p.num_rows for p in parts] == [3, 1, 1] and pa.concat_batches(parts).equals(batch)
    assert list(slices(batch.slice(0, 0), 11)) == []


def test_workers_hand_back_what_a_step_leaves(monkeypatch):
    from ballast.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("back"))
    step = common.giving_back(lambda batches: (calls.append(x) or x for x in batches))
    assert list(step(iter([1, 2]))) == [1, 2] and calls == ["back", 1, 2, "back"]
    for make in (personal_data.scan, near_duplicates.sketch, near_duplicates.shingle_sets, packing.pieces, quality.cut_blocks, language.predictor):
        assert "giving_back" in inspect.getsource(make)


def test_a_worker_remembers_a_bounded_number_of_words():
    ids = WordIds(PATH)
    for at in range(0, 260_000, 10_000):
        texts = [" ".join(chr(97 + k % 26) + "".join(chr(97 + (k // 26**i) % 26) for i in range(1, 5)) for k in range(at, at + 10_000))]
        found, sizes = ids.of_texts(pa.array(texts))
        assert len(found) == sizes.sum()
        assert len(ids.runs) + len(ids.known) <= 111_000
    assert found.tolist() == Tokenizer.from_file(PATH).encode(texts[0], add_special_tokens=False).ids


def test_words_of_the_last_call_stay_remembered(monkeypatch):
    ids, asked = WordIds(PATH), []
    monkeypatch.setattr(ids.runs, "answer", lambda r, f=ids.runs.answer: asked.append(r) or f(r))

    def words(at):
        return pa.array([" ".join("".join(chr(97 + (k // 26**i) % 26) for i in range(4)) for k in range(at, at + 60_000))])

    first, _ = ids.of_texts(words(0))
    last, _ = ids.of_texts(words(60_000))
    assert len(asked) == 120_000 and len(ids.runs) <= packing.REMEMBERED
    assert (ids.of_texts(words(60_000))[0] == last).all() and len(asked) == 120_000
    assert (ids.of_texts(words(0))[0] == first).all() and len(asked) == 180_000


def test_texts_are_parted_by_their_bytes():
    ids, t = WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ["It'S we'LLx  a''s\n12", "ÀÉ×ß <B> c\tD", "x'", "s", "É", "\u0301E ", "", " \n", "'re", "don'", "", "t've"]
    data = [x.encode() for x in texts]
    low, begins, whole = ids.parts(bytearray(b"".join(data)), np.cumsum([0, *map(len, data)])[:-1])
    parts = [bytes(low[a:b]).decode() for a, b in zip(begins, [*begins[1:], len(low)])]
    assert parts[:9] == ["it", "'s", " we", "'ll", "x", "  a", "''", "s", "\n1"]
    assert parts[9:] == ["2", "ÀÉ×ß", " <B>", " c\tD", "x", "'", "s", "é", "\u0301E", " ", " \n", "'re", "don", "'", "t", "'ve"]
    assert [parts[i] for i in whole] == ["ÀÉ×ß", " <B>", " c\tD", "\u0301E"]
    for array in (pa.array(["cut off", *texts, None])[1:], pa.array([*texts, None], pa.large_string())):
        got, sizes = ids.of_texts(array)
        ends = np.cumsum([0, *sizes])
        assert [got[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(x, add_special_tokens=False).ids for x in [*texts, ""]]
    got, sizes = ids.of_texts(pa.array([None, ""], pa.string()))
    assert len(got) == 0 and sizes.tolist() == [0, 0]

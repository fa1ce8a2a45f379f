"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts sequences of ``ORDER`` characters per language, over all trusted texts (labels with quality 1 and not
toxic, less a fifth that is kept for the thresholds). Characters and not words, because then the n-grams of a block of texts repeat and
the model is met by joins that carry each n-gram once per block instead of once per occurrence.

1. Blocks of texts of one language are cut from the input, with their distinct n-grams and counts, and written as a table bucketed by block.
2. Counts of the training blocks are summed; discounts, back-off weights and probabilities follow from grouped sums and joins over n-grams.
3. Sharded join: the n-grams of all blocks meet the model by language and n-gram, and the answers go back to their blocks.
4. Each block scores its texts. Texts pass if their perplexity is at most a quantile of that of the trusted texts kept
   back. Which one is chosen by language on all labelled rows that are kept back: it rejects most of the toxic and of
   the low ones (quality 0) for the share of trusted ones lost.

Defined results: a null language is ``und``; a null, empty or blank text has no perplexity and does not pass; texts of a language without
trusted text have no perplexity and pass, as nothing speaks against them. A doc_id with several labels is trusted only if all
say so, else toxic if one says so, else low if one says so. Languages without toxic or low rows kept back get the highest quantile. Rows that repeat are scored each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import at_most, giving_back
from ballast.llm.language import held_out
from ballast.plans.scratch import materialize

ORDER = 4
#: Characters of a block, about. Blocks are cut between texts.
BLOCK = 4_000_000
#: Rising; at most a twentieth of the trusted texts kept back may be lost.
QUANTILES = (0.95, 0.96, 0.965, 0.97, 0.975, 0.98, 0.985, 0.99, 0.995)
#: Stands before the first character of a text and for nothing else.
START = "\x02"
PLAIN = dict(zip("123456789\0" + START, "000000000  ", strict=True))
PLAIN_TABLE = str.maketrans(PLAIN)


def symbols(text: str) -> str:
    """Lower case, white space as single spaces, digits as 0."""
    text = text.lower()
    if text.isascii():
        text = text.translate(PLAIN_TABLE)
    else:  # other texts are translated character by character, which takes ten times as long as replacing
        for c, plain in PLAIN.items():
            text = text.replace(c, plain)
    return " ".join(text.split())


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in rising order, and for each value the number of its own: by hashing, as sorting all of them costs several times that."""
    number, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[number]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as a (n, ORDER) array of code points, for each character the number of its n-gram,
    and where each text ends among the characters. Texts must not be empty."""
    lead = START * (ORDER - 1)
    codes = np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    inside = np.ones(len(codes) - ORDER + 1, bool)
    for i in range(ORDER - 1):  # windows that begin in the last characters of a text reach into the next one
        over = begins[1:] - 1 - i
        inside[over[over >= 0]] = False
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    if len(alphabet) ** ORDER >= 2**64:  # n-grams of so many characters don't fit a number
        grams, number = np.unique(np.lib.stride_tricks.sliding_window_view(codes, ORDER)[inside], axis=0, return_inverse=True)
        return grams, number.reshape(-1), np.cumsum(sizes)
    place = np.zeros(len(there), np.uint16)
    place[alphabet] = np.arange(len(alphabet))
    small = place[codes]
    width = np.uint64(len(alphabet))
    key = small[: len(inside)].astype(np.uint64)
    for i in range(1, ORDER):
        key *= width
        key += small[i : len(inside) + i]
    distinct, number = numbered(key[inside])
    grams = np.empty((len(distinct), ORDER), np.uint32)
    for i in range(ORDER - 1, -1, -1):
        grams[:, i] = alphabet[(distinct % width).astype(np.int64)]
        distinct = distinct // width
    return grams, number, np.cumsum(sizes)


def as_strings(grams: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    n = grams.shape[1]
    text = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + n] for i in range(0, len(text), n)]


def pack_texts(texts: list[str]) -> bytes:
    return zstandard.compress("\0".join(texts).encode("utf-8", "surrogatepass"), 3)


def unpack_texts(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass").split("\0")


def cut_blocks(rows: DataFrame) -> DataFrame:
    """(id, lang, role, text) -> (block, lang, ids, roles, texts, grams, counts): one row per block of a language.

    ``ids`` are the ids as text; ``counts`` are those of the texts whose role is train. Texts without a character
    are in blocks of their own, of which only the ids are kept.
    """

    def block(lang: str, ids: list, roles: list[str], texts: list[str]) -> pd.DataFrame:
        found = {"lang": [lang], "ids": [ids], "roles": [roles]}
        if not texts:
            return pd.DataFrame({"block": [0], **found, "texts": [None], "grams": [None], "counts": [None]})
        grams, number, _ = windows(texts)
        train = np.repeat([r == "train" for r in roles], [len(t) for t in texts])
        data = pack_texts(texts)
        name = xxhash.xxh3_64_intdigest(data + "\0".join(map(str, ids)).encode() + lang.encode()) - (1 << 63)
        counts = np.bincount(number[train], minlength=len(grams))
        return pd.DataFrame({"block": [name], **found, "texts": [data], "grams": [as_strings(grams)], "counts": [counts]})

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[str, bool], tuple[list, list[str], list[str], list[int]]] = {}
        for batch in batches:
            for i, lang, role, text in zip(batch["id"], batch["lang"], batch["role"], batch["text"], strict=True):
                plain = symbols(text) if isinstance(text, str) else ""
                ids, roles, texts, size = waiting.setdefault((lang, bool(plain)), ([], [], [], [0]))
                ids.append(i)
                roles.append(role)
                if plain:
                    texts.append(plain)
                size[0] += len(plain) + 50
                if size[0] >= BLOCK:
                    yield block(lang, ids, roles, texts)
                    del waiting[lang, bool(plain)]
        for (lang, _), (ids, roles, texts, _) in waiting.items():
            yield block(lang, ids, roles, texts)

    return rows.select("id", "lang", "role", "text").mapInPandas(
        run, "block long, lang string, ids array<string>, roles array<string>, texts binary, grams array<string>, counts array<long>"
    )


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, n, d1, d2, d3) by the counts of counts (Chen and Goodman 1998), kept within 0 and the count."""
    seen = counts.groupBy("lang", "n").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    made = [F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    held = [F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(m, F.lit(0.5 * k)))).alias(f"d{k}") for k, m in zip((1, 2, 3), made, strict=True)]
    return seen.select("lang", "n", *held)


def kneser_ney(top: DataFrame) -> DataFrame:
    """Counts (lang, gram, c) of n-grams of ``ORDER`` characters -> (lang, gram, p, gamma) for all n-grams.

    ``p`` is the interpolated probability of the last character after the others, ``gamma`` the weight that the
    n-gram, as a context, gives to shorter contexts. The empty n-gram holds the uniform probability.
    """
    top = materialize(top, "grams")
    levels, upper = [top.select("lang", F.lit(ORDER).alias("n"), "gram", "c")], top
    for n in range(ORDER - 1, 0, -1):
        # Lower orders count the different characters that stand before an n-gram.
        upper = upper.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        levels.append(upper.select("lang", F.lit(n).alias("n"), "gram", "c"))
    counts = levels[0]
    for x in levels[1:]:
        counts = counts.unionByName(x)
    counts = materialize(counts.where(~F.col("gram").endswith(START)), "counts")
    off = at_most(discounts(counts))
    of = lambda c: F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = counts.join(off, ["lang", "n"]).select("lang", "n", "gram", F.expr("substring(gram, 1, n - 1)").alias("context"), "c", of("c").alias("d"))
    contexts = cut.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("off"))
    contexts = materialize(contexts.select("lang", "n", "context", "total", (F.col("off") / F.col("total")).alias("gamma")), "contexts")
    alphabet = counts.where("n = 1").groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("p"))
    found = alphabet.select("lang", F.lit("").alias("gram"), "p")
    model = below = found
    for n in range(1, ORDER + 1):
        here = cut.where(F.col("n") == n).join(contexts.where(F.col("n") == n).drop("n"), ["lang", "context"])
        here = here.withColumn("shorter", F.expr("substring(gram, 2)"))
        shorter = below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("q")
        below = materialize(here.join(shorter, ["lang", "shorter"]).select("lang", "gram", p.alias("p")), f"model-{n}")
        model = model.unionByName(below)
    gammas = contexts.select("lang", F.col("context").alias("gram"), "gamma")
    return materialize(model.join(gammas, ["lang", "gram"], "full"), "model")


def score_block(grams: list[str], p: dict[str, float], gamma: dict[str, float]) -> np.ndarray:
    """Log probability of each n-gram, backing off where the model has none."""
    out = np.empty(len(grams))
    for i, g in enumerate(grams):
        weight, at = 1.0, 0
        while at < ORDER and g[at:] not in p:
            weight *= gamma.get(g[at:-1], 1.0)
            at += 1
        out[i] = weight * p.get(g[at:], 1e-9)
    return np.log(out)


def perplexities(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, role, n_symbols, perplexity) of the texts of ``blocks``, a table bucketed by block."""

    def cut(begin: int, length: int):
        return F.transform("grams", lambda g: F.substring(g, begin, length))

    blocks = blocks.where("texts is not null")
    tails = [cut(ORDER + 1 - n, n) for n in range(1, ORDER)]
    heads = [cut(1, n) for n in range(ORDER)]
    asked = blocks.select("block", "lang", F.explode(F.array_distinct(F.flatten(F.array("grams", *tails, *heads)))).alias("gram"))
    found = asked.join(model, ["lang", "gram"]).select("block", F.struct("gram", F.col("p").cast("float").alias("p"), F.col("gamma").cast("float").alias("gamma")).alias("a"))
    answers = found.groupBy("block").agg(F.collect_list("a").alias("a")).select("block", "a.gram", "a.p", "a.gamma")
    joined = blocks.select("block", "lang", "ids", "roles", "texts").join(answers, "block", "left")
    names = ["id", "lang", "role", "n_symbols", "perplexity"]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # only one block at a time becomes Python objects
                row = {name: batch.column(name)[i].as_py() for name in ("lang", "ids", "roles", "texts", "gram", "p", "gamma")}
                texts = unpack_texts(row["texts"])
                sizes = np.array([len(t) for t in texts])
                values = pa.nulls(len(texts), pa.float64())
                if row["gram"] is not None:
                    values = pa.array(block_perplexities(texts, row["gram"], row["p"], row["gamma"]))
                same = pa.array([row["lang"]] * len(texts), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.string()), same, pa.array(row["roles"], pa.string()), pa.array(sizes, pa.int64()), values], names
                )

    return joined.mapInArrow(run, "id string, lang string, role string, n_symbols long, perplexity double")


def block_perplexities(texts: list[str], found: list[str], p: list[float | None], gamma: list[float | None]) -> np.ndarray:
    """Perplexity of each text by what the model has for the n-grams ``found``."""
    known = {g: x for g, x in zip(found, p, strict=True) if x is not None}
    weights = {g: x for g, x in zip(found, gamma, strict=True) if x is not None}
    grams, number, ends = windows(texts)
    total = np.concatenate([[0.0], np.cumsum(score_block(as_strings(grams), known, weights)[number])])
    sizes = np.array([len(t) for t in texts])
    return np.exp(-(total[ends] - total[ends - sizes]) / sizes)


def chosen_limits(scored: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(lang, quantile, threshold) from (lang, role, perplexity).

    The quantiles are those of the trusted texts kept back (role held), or of all trusted ones (train) if a language has none. Chosen is
    the one with the highest mean share of rejected toxic and low rows less the share of lost held ones, the higher one of equals.
    """
    values = F.percentile_approx("perplexity", list(quantiles), 10_000)
    held = scored.where("role = 'held'").groupBy("lang").agg(values.alias("h"))
    all_trusted = scored.where("role IN ('train', 'held')").groupBy("lang").agg(values.alias("t"))
    limits = materialize(all_trusted.join(held, "lang", "left").select("lang", F.coalesce("h", "t").alias("limits")), "limits")
    tried = scored.where("role IN ('held', 'toxic', 'low')").join(at_most(limits), "lang")
    over = lambda role, i: F.avg(F.when(F.col("role") == role, (F.col("perplexity") > F.col("limits")[i]).cast("double")))
    shares = tried.groupBy("lang").agg(*[over(role, i).alias(f"{role}{i}") for role in ("held", "toxic", "low") for i in range(len(quantiles))])

    def choice(i: int, q: float):
        caught = (F.coalesce(f"toxic{i}", f"low{i}", F.lit(0.0)) + F.coalesce(f"low{i}", f"toxic{i}", F.lit(0.0))) / 2
        gain = caught - F.coalesce(f"held{i}", F.lit(0.0))
        return F.struct(gain.alias("gain"), F.lit(q).alias("quantile"), F.col("limits")[i].alias("threshold"))

    best = F.array_max(F.array(*[choice(i, q) for i, q in enumerate(quantiles)])).alias("best")
    return limits.join(shares, "lang", "left").select("lang", best).select("lang", "best.quantile", "best.threshold")


def document_quality(documents: DataFrame, labels: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, passed) for every row of ``documents``."""
    spark = documents.sparkSession
    sure = (F.col("quality") == 1) & (F.col("toxic") == 0)
    mark = F.when(F.min(F.coalesce(sure, F.lit(False))), "trusted").when(F.max(F.col("toxic") == 1), "toxic").when(F.max(F.col("quality") == 0), "low")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(mark.alias("_mark")).where("_mark is not null")
    kind = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text").join(at_most(known), "doc_id", "left")
    good, back = F.col("_mark") == "trusted", held_out(F.col("doc_id"))
    role = F.when(good & back, "held").when(good, "train").when(F.col("_mark").isNotNull() & back, F.col("_mark")).otherwise("other")
    cut = cut_blocks(rows.select(F.col("doc_id").cast("string").alias("id"), "lang", role.alias("role"), "text"))
    name = f"blocks_{uuid.uuid4().hex}"
    cut.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    blocks = spark.table(name)
    pairs = blocks.select("lang", F.explode(F.arrays_zip("grams", "counts")).alias("g")).where("g.counts > 0")
    top = pairs.groupBy("lang", F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("c"))
    scored = materialize(perplexities(blocks, kneser_ney(top)), "perplexity")
    blank = materialize(blocks.where("texts is null").select(F.explode("ids").alias("id"), "lang"), "blank")
    spark.sql(f"DROP TABLE {name}")
    limits = chosen_limits(scored, quantiles).drop("quantile")
    judged = scored.join(at_most(limits), "lang", "left")
    passed = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    judged = judged.select("id", "lang", "n_symbols", "perplexity", "threshold", passed.alias("passed"))
    none = F.lit(None).cast("double")
    blank = blank.select("id", "lang", F.lit(0).cast("long").alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"), F.lit(False).alias("passed"))
    return judged.unionByName(blank).select(F.col("id").cast(kind).alias("doc_id"), "lang", "n_symbols", "perplexity", "threshold", "passed")

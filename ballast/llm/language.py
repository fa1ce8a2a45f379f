"""Language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes. Every byte is embedded, filters of several
widths slide over the window, the largest response of each filter is kept, and a softmax layer
gives a probability per language. The network is trained in numpy on a bounded sample of
labelled rows and applied to all windows of every text, in batches, inside Spark tasks.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and so is
every text if no labelled row can be learned from. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.llm.common import at_most, giving_back, packed, unpacked

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 12
#: Labelled rows per language that the network is fitted on, and windows taken from each.
ROWS_PER_LANGUAGE = 500
WINDOWS_PER_ROW = 4
#: Texts whose best language scores less are not in any learned language.
LEAST_SCORE = 0.3
EPOCHS = 14
BATCH = 64


@dataclass
class ByteConvNet:
    """The weights. ``languages`` are the classes, in sorted order."""

    languages: list[str]
    embedding: np.ndarray = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, EMBEDDING, FILTERS)
    bias: np.ndarray = None
    out: np.ndarray = None
    out_bias: np.ndarray = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses of byte pairs: one gather per position replaces the products of a convolution."""
        e = self.embedding
        part = {w: [e @ f[j] for j in range(w)] for w, f in self.filters.items()}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(part[w][0], part[w][1]) for w in WIDTHS], axis=1)
        return first.astype(np.float32), part[3][2].astype(np.float32), pair(part[4][2], part[4][3]).astype(np.float32)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, languages)."""
        first, third, last = tables
        f = FILTERS
        x = windows.astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        got = first[pairs]
        peak = np.empty((len(x), 3 * f), np.float32)
        peak[:, :f] = got[:, :, :f].max(1)
        peak[:, f : 2 * f] = (got[:, :-1, f : 2 * f] + third[x[:, 2:]]).max(1)
        peak[:, 2 * f :] = (got[:, :-2, 2 * f :] + last[pairs[:, 2:]]).max(1)
        return softmax(np.maximum(peak + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text; the last one is filled up with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 7) -> ByteConvNet:
    """Fit on (language, text) pairs by Adam. Every second window is cut to a random length, so that
    the network also learns from little text."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return ByteConvNet([])
    rng = np.random.default_rng(seed)
    x = np.concatenate([windows_of(data[:WINDOW]) for _, data in samples])
    y = np.array([languages.index(lang) for lang, _ in samples])
    size = np.array([min(len(data), WINDOW) for _, data in samples])
    k, wide = len(languages), len(WIDTHS) * FILTERS
    weights = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "b": np.zeros(wide), "o": rng.normal(0, 0.1, (wide, k)), "c": np.zeros(k)}
    weights |= {w: rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    weights = {n: v.astype(np.float32) for n, v in weights.items()}
    first = {n: np.zeros_like(v) for n, v in weights.items()}
    second, step = {n: np.zeros_like(v) for n, v in weights.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            xb = x[at].copy()
            cut = np.where(rng.random(len(at)) < 0.5, rng.integers(4, WINDOW + 1, len(at)), size[at])
            xb[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            grad = gradients(weights, xb, y[at])
            step += 1
            for n, g in grad.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                weights[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
    return ByteConvNet(languages, weights["e"], {w: weights[w] for w in WIDTHS}, weights["b"], weights["o"], weights["c"])


def gradients(weights: dict, x: np.ndarray, y: np.ndarray) -> dict[object, np.ndarray]:
    """Gradients of the mean cross entropy. Only the position of each filter's peak gets any."""
    e, rows = weights["e"], np.arange(len(x))
    peaks, places = [], {}
    for w in WIDTHS:
        wide = x.shape[1] - w + 1
        z = sum((e @ weights[w][j])[x[:, j : j + wide]] for j in range(w))
        places[w] = z.argmax(1)
        peaks.append(np.take_along_axis(z, places[w][:, None, :], 1)[:, 0])
    peak = np.concatenate(peaks, 1) + weights["b"]
    hidden = np.maximum(peak, 0)
    d = softmax(hidden @ weights["o"] + weights["c"])
    d[rows, y] -= 1
    d /= len(x)
    grad = {"o": hidden.T @ d, "c": d.sum(0), "e": np.zeros_like(e)}
    back = (d @ weights["o"].T) * (peak > 0)
    grad["b"] = back.sum(0)
    for i, w in enumerate(WIDTHS):
        dz = back[:, i * FILTERS : (i + 1) * FILTERS]
        grad[w] = np.zeros_like(weights[w])
        for j in range(w):
            seen = x[rows[:, None], places[w] + j]
            grad[w][j] = np.einsum("nf,nfe->ef", dz, e[seen])
            np.add.at(grad["e"], seen.ravel(), (dz[:, :, None] * weights[w][j].T[None]).reshape(-1, EMBEDDING))
    return grad


def training_sample(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Windows at hashed places of at most ``rows_per_language`` rows of each language.

    ``labelled`` has (id, text, lang). The rows are those with the smallest hashes; a hash limit
    taken from the counts keeps all but a few candidates out before they are ranked.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("_u", F.xxhash64("id", "text"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    near = usable.join(at_most(counts, 10_000), "lang").where(
        F.pmod("_u", F.lit(1 << 30)) < (F.lit(float(1 << 30)) * (rows_per_language * 1.5 + 20) / F.col("_n"))
    )
    order = Window.partitionBy("lang").orderBy(F.pmod("_u", F.lit(1 << 30)), "_u", "id")
    chosen = near.select("lang", "id", "text", "_u", F.row_number().over(order).alias("_k")).where(F.col("_k") <= rows_per_language)
    place = F.pmod(F.xxhash64("_u", "_w"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    cuts = chosen.withColumn("_w", F.explode(F.sequence(F.lit(1), F.lit(WINDOWS_PER_ROW)))).select(
        "lang", "_u", "_w", F.col("text").substr(place, F.lit(WINDOW)).alias("cut")
    )
    return [(r.lang, r.cut.encode()) for r in sorted(cuts.collect(), key=lambda r: (r.lang, r._u, r._w, r.cut)) if r.cut.strip()]


def predictor(model: ByteConvNet):
    """A pandas UDF from text to (lang, score): mean probability over the windows, weighted by bytes."""

    @F.pandas_udf("lang string, score double")
    @giving_back
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.tables() if model.languages else None
        for texts in batches:
            got = [scored(model, tables, t) for t in in_groups(texts, model, tables)] if tables else [(UNKNOWN, 0.0)] * len(texts)
            yield pd.DataFrame(got, columns=["lang", "score"])

    return predict


def in_groups(texts: pd.Series, model: ByteConvNet, tables) -> Iterator[np.ndarray | None]:
    """Weighted mean probabilities of each text, None if it has no letter. Windows of many texts share a batch."""
    waiting, held = [], 0

    def flush():
        stacked = np.concatenate([windows_of(d) for d in waiting if d is not None] or [np.zeros((0, WINDOW), np.uint8)])
        p = [model.probabilities(stacked[i : i + BATCH], tables) for i in range(0, len(stacked), BATCH)]
        p, at = np.concatenate(p) if p else None, 0
        for d in waiting:
            if d is None:
                yield None
                continue
            n = max(1, -(-len(d) // WINDOW))
            size = np.full(n, float(WINDOW))
            size[-1] = len(d) - (n - 1) * WINDOW
            yield (p[at : at + n] * size[:, None]).sum(0) / size.sum()
            at += n

    for text in texts:
        waiting.append(text.encode() if isinstance(text, str) and any(map(str.isalpha, text)) else None)
        held += len(waiting[-1] or b"")
        if held > 1 << 20:
            yield from flush()
            waiting, held = [], 0
    yield from flush()


def scored(model: ByteConvNet, tables, p: np.ndarray | None) -> tuple[str, float]:
    return (UNKNOWN, 0.0) if p is None else (model.languages[int(p.argmax())], float(min(1.0, p.max())))


def fit_language(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> ByteConvNet:
    """Train on ``labelled`` (id, text, lang); rows without text or language are passed over."""
    return train(training_sample(labelled, rows_per_language))


def identify_language(model: ByteConvNet, text: Column) -> Column:
    """Struct (lang, score) for each whole text."""
    return predictor(model)(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, mod 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(documents: DataFrame) -> ByteConvNet:
    """The network of the rows of ``documents`` that are not held out."""
    learn = documents.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return fit_language(learn.select(F.col("doc_id").alias("id"), "text", "lang"))


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents``; repeated rows are kept."""
    rows = documents.select("doc_id", "text", "lang")
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify_language(learned(rows), F.col("text")).alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def drop_unknown_language(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``documents`` without the rows in no learned language: ``und``, or scored below ``least_score``.

    If there is nothing to learn from, rows with a letter stay.
    """
    model = learned(documents)
    if not model.languages:
        return documents.where(F.col("text").rlike(r"\p{L}"))
    rows = documents.select(packed(documents)).withColumn("_p", identify_language(model, F.col("_row.text")))
    return rows.where((F.col("_p.lang") != UNKNOWN) & (F.col("_p.score") >= least_score)).select(*unpacked(documents.columns))

"""Personal data by bootstrapped contextual extraction.

Four base patterns find emails, IP addresses, card and phone numbers. They are the seeds: the words around
them induce lexical patterns ("the word before is ``tel:``"), and mentions that look like identifiers but match
no base pattern are the unlabelled instances. Spark scores the graph of patterns and instances in rounds: a pattern is
trusted as far as its instances are, an instance as far as the trusted patterns around its mentions are.
Mentions in the context of high-confidence patterns become spans of the pattern's kind. Base spans
always stay.

Offsets count code points, ends are exclusive. Defined results: null and empty texts have no spans. Rows
that repeat id and text are scanned each and get the same spans; in the graph an instance counts once per pattern.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import ROW_KEY, at_most, giving_back, packed, row_key, unpacked
from ballast.plans.scratch import materialize

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the start of a run of digits, as the digits of a part are taken greedily: the look-behind
# changes no match and keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looks of unlabelled instances, by the kinds they could be.
NUMBER = re.compile(r"(?<![0-9+])\(?[0-9][0-9() .-]{5,}[0-9]")
HEX_GROUPS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
NO_ADDRESS = frozenset(" \t\n\r\f\v<>()[]{}\"',;:@")

#: A pattern is used if its instances add up to this much trust, and to this share of it and what speaks against the pattern.
SUPPORT, PURITY = 5.0, 0.9
#: What an unlabelled instance that nothing contradicts counts against a pattern, before the rounds trust it.
UNLABELLED = 0.1
#: An instance is accepted from this trust on.
ACCEPT = 0.9
ROUNDS = 3
#: Longer words around mentions are one and the same word in a pattern; they are no vocabulary, and patterns stay short.
WORD_CHARS = 60
LONG_WORD = "..long.."

SPAN = "struct<kind:int,begin:int,end:int>"
MENTION = "struct<seed:int,looks:int,begin:int,end:int,value:string,contexts:array<string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @."""
    found, past = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > past and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
        past = m.end() if m else at + 1
        at = text.find("@", past)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) in the order of kinds, then of places."""
    found = [(0, b, e) for b, e in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def lookalikes(text: str) -> list[tuple[int, int, int]]:
    """(looks, begin, end) of what could be an identifier; looks has bit 1 << kind for every kind it could be."""
    found = []
    for m in NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        looks = (8 if 7 <= n <= 15 else 0) | (4 if 13 <= n <= 19 else 0)
        if looks:
            found.append((looks, *m.span()))
    if ":" in text:
        found += [(2, *m.span()) for m in HEX_GROUPS.finditer(text)]
    past, at = 0, text.find("@")
    while at >= 0:
        begin, end = at, at + 1
        while begin > past and text[begin - 1] not in NO_ADDRESS:
            begin -= 1
        while end < len(text) and text[end] not in NO_ADDRESS:
            end += 1
        if begin < at and end > at + 1:
            found.append((1, begin, end))
        past = end
        at = text.find("@", past)
    return found


class Words:
    """Where the words of a text begin and end, found once for all of its mentions."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begins, self.ends = array("q"), array("q")
        for m in re.finditer(r"\S+", text):
            self.begins.append(m.start())
            self.ends.append(m.end())

    def word(self, begin: int, end: int) -> str:
        """In lower case with zeros for digits. Words of more than ``WORD_CHARS`` characters are all the same."""
        return re.sub(r"[0-9]", "0", self.text[begin:end].lower()) if end - begin <= WORD_CHARS else LONG_WORD

    def contexts(self, begin: int, end: int) -> list[str]:
        """Lexical patterns of a mention: the word before, the two before, the one after, those on both sides. What touches the mention is a word."""
        at, past = bisect_left(self.begins, begin) - 1, bisect_right(self.ends, end)
        left = self.word(self.begins[at], min(self.ends[at], begin)) if at >= 0 else "^"
        right = self.word(max(self.begins[past], end), self.ends[past]) if past < len(self.ends) else "$"
        found = [f"L {left}", f"R {right}", f"B {left} _ {right}"]
        return found + ([f"LL {self.word(self.begins[at - 1], self.ends[at - 1])} {left}"] if at >= 1 else [])


def scan_text(text: str) -> tuple[list, list]:
    """Base spans and mentions (seed kind or -1, looks, begin, end, value, contexts)."""
    base, more = base_spans(text), lookalikes(text)
    if not base and not more:
        return [], []
    words = Words(text)
    mentions = [(k, 1 << k, b, e, text[b:e].lower(), words.contexts(b, e)) for k, b, e in base]
    taken = sorted((b, e) for _, b, e in base)
    at = 0
    for looks, b, e in sorted(more, key=lambda x: (x[1], x[2])):
        while at < len(taken) and taken[at][1] <= b:
            at += 1
        if not any(x < e and b < y for x, y in taken[at : at + 4]):
            mentions.append((-1, looks, b, e, text[b:e].lower(), words.contexts(b, e)))
    return base, mentions


def listed(spans) -> str:
    """kind:start:end, by kind, then start."""
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in sorted(spans))


def scan(rows: DataFrame) -> DataFrame:
    """(_h1, _h2, doc_id, text) -> the same keys, base spans and mentions."""

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [scan_text(t) if isinstance(t, str) else ([], []) for t in batch["text"]]
            out = batch[[*ROW_KEY, "doc_id"]].copy()
            out["base"] = [[{"kind": k, "begin": b, "end": e} for k, b, e in base] for base, _ in both]
            names = ("seed", "looks", "begin", "end", "value", "contexts")
            out["mentions"] = [[dict(zip(names, m, strict=True)) for m in found] for _, found in both]
            yield out

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*ROW_KEY, "doc_id", "text").mapInPandas(
        run, f"_h1 long, _h2 int, doc_id {kind}, base array<{SPAN}>, mentions array<{MENTION}>"
    )


def score_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trust of patterns (pattern, kind, trust) and of instances (value, looks, kind, trust).

    ``mentions`` has (seed, looks, value, contexts). A pattern's trust in a kind is the sum s of the trust of its distinct instances over
    s and what speaks against it, times log2(1 + s) / log2(1 + s) of twice the needed support s at most, and 0 below the limits; an instance's trust is
    1 - the product of (1 - trust) of the patterns around it (noisy or). Seeds stay at 1 for their kind.

    Against a pattern speak seeds of other kinds, and unlabelled instances that could be of the kind, by what they lack in trust: in full if
    the word on their other side is one that only unlabelled instances have, ``SUPPORT`` of them or more, else times ``UNLABELLED``.
    """
    edges = mentions.select("seed", "looks", "value", F.explode("contexts").alias("pattern")).distinct()
    edges = materialize(edges, "edges")
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))]))
    seeds = edges.where("seed >= 0").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("s"))
    all_seeds = seeds.groupBy("pattern").agg(F.sum("s").alias("all_seeds"))
    open_edges = edges.where("seed < 0").select("pattern", "value", "looks")
    possible = open_edges.withColumn("kind", kinds).where(F.expr("looks & shiftleft(1, kind) > 0"))
    side = F.substring_index("pattern", " ", 1)
    strange = possible.where(side.isin("L", "R")).groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    strange = strange.join(all_seeds, "pattern", "left_anti").select("pattern", "kind")
    contradicted = possible.join(strange, ["pattern", "kind"]).groupBy("value", "looks", "kind")
    contradicted = contradicted.agg(F.max(side == "L").alias("left"), F.max(side == "R").alias("right"))
    other = F.when(side.isin("L", "LL"), F.col("right")).when(side == "R", F.col("left"))
    weight = F.when(other, F.lit(1.0)).otherwise(F.lit(UNLABELLED)).alias("weight")
    possible = materialize(possible.join(contradicted, ["value", "looks", "kind"], "left").select("pattern", "value", "looks", "kind", weight), "possible")
    against = possible.groupBy("pattern", "kind").agg(F.sum("weight").alias("against"))

    def trusted(sums: DataFrame) -> DataFrame:
        """Of (pattern, kind, s, own, gained): s with the trust of unlabelled ones, own without, gained what that takes from against."""
        hard = F.col("all_seeds") - F.col("own")
        share = F.col("s") / (F.col("s") + F.coalesce(hard, F.lit(0.0)) + F.greatest(F.coalesce("against", F.lit(0.0)) - F.col("gained"), F.lit(0.0)))
        backed = F.least(F.lit(1.0), F.log2(1 + F.col("s")) / F.log2(F.lit(1 + SUPPORT)))
        found = sums.join(all_seeds, "pattern", "left").join(against, ["pattern", "kind"], "left").withColumn("trust", share * backed)
        return found.where((F.col("s") >= SUPPORT) & (share >= PURITY)).select("pattern", "kind", "trust")

    def believed(patterns: DataFrame) -> DataFrame:
        doubt = F.greatest(1 - F.col("trust"), F.lit(1e-9))
        met = possible.join(patterns, ["pattern", "kind"]).groupBy("value", "looks", "kind")
        return met.agg((1 - F.exp(F.sum(F.log(doubt)))).alias("trust"))

    labelled = seeds.select("pattern", "kind", "s", F.col("s").alias("own"), F.lit(0.0).alias("gained"))
    patterns = trusted(labelled)
    instances = believed(patterns)
    for _ in range(rounds - 1):
        gained = possible.join(instances, ["value", "looks", "kind"]).groupBy("pattern", "kind")
        gained = gained.agg(F.sum("trust").alias("s"), F.lit(0.0).alias("own"), F.sum(F.col("trust") * F.col("weight")).alias("gained"))
        sums = labelled.unionByName(gained).groupBy("pattern", "kind")
        patterns = trusted(sums.agg(*[F.sum(c).alias(c) for c in ("s", "own", "gained")]))
        patterns = materialize(patterns, "patterns")
        instances = believed(patterns)
    return patterns, materialize(instances, "instances")


def discovered(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(_h1, _h2, more): spans that only their contexts give away, by document."""
    mentions = scanned.select(*ROW_KEY, F.explode("mentions").alias("m")).select(*ROW_KEY, "m.*")
    patterns, instances = score_patterns(mentions.select("seed", "looks", "value", "contexts"), rounds)
    sure = instances.where(F.col("trust") >= ACCEPT).select("value", "looks", "kind", "trust")
    open_mentions = mentions.where("seed < 0").select(*ROW_KEY, "looks", "value", "begin", "end", "contexts")
    near = open_mentions.join(sure, ["value", "looks"]).withColumn("pattern", F.explode("contexts"))
    backed = near.join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    best = backed.groupBy(*ROW_KEY, "begin", "end").agg(F.max(F.struct("trust", -F.col("kind"))).alias("b"))
    span = F.struct((-F.col("b")["col2"]).alias("kind"), "begin", "end")
    return best.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set(span.cast(SPAN))).alias("more"))


def find_personal_data(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(_h1, _h2, doc_id, base, more) for every row of ``documents`` (doc_id, text)."""
    rows = documents.select(*row_key("doc_id", "text"), "doc_id", "text")
    scanned = materialize(scan(rows), "scanned")
    more = materialize(discovered(scanned, rounds), "discovered")
    found = scanned.select(*ROW_KEY, "doc_id", "base").join(at_most(more), ROW_KEY, "left")
    return found.withColumn("more", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))


def as_text(spans: str) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["begin"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.expr(spans)), one), ",")


def document_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``documents``.

    Counts and digest are those of the base spans; ``spans`` lists all.
    """
    found = find_personal_data(documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("array_union(base, more)").alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first one names the place."""
    parts, at = [], 0
    for begin, end, kind in sorted((b, e, k) for k, b, e in spans):
        if begin >= at:
            parts += [text[at:begin], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_personal_data(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with all personal data in ``text`` replaced, and ``n_chars``, if there, counted anew."""
    found = find_personal_data(documents, rounds).where(F.size("base") + F.size("more") > 0)
    spans = found.select(*ROW_KEY, F.array_union("base", "more").alias("_spans")).dropDuplicates(ROW_KEY)

    @F.pandas_udf("string")
    @giving_back
    def mask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            got = ((t, [] if s is None else [(x["kind"], x["begin"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True))
            yield pd.Series([masked(t, s) if s else t for t, s in got], dtype=object)

    rows = documents.select(packed(documents), *row_key("doc_id", "text")).join(at_most(spans), ROW_KEY, "left")
    rows = rows.select("_row", F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(mask("_row.text", "_spans")).alias("_text"))
    fresh = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        fresh["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return rows.select(*[fresh[c].alias(c) if c in fresh else unpacked([c])[0] for c in documents.columns])

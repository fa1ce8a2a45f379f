from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from ballast.llm.personal_data import Words, base_spans, document_personal_data, find_personal_data, luhn, mask_personal_data, masked, scan_text, score_patterns
from ballast.sources.tables import table
from tests.llm.cases import DOCUMENTS, documents, no_documents

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    count = lambda s: len(re.sub("[^0-9]", "", s))
    found = [(0, *m.span()) for m in re.finditer(EMAIL, text)]
    found += [(1, *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in re.finditer(CARD, text) if 13 <= count(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    return found + [(3, *m.span()) for m in re.finditer(PHONE, text) if 9 <= count(m[0]) <= 15]


def digest(spans):
    return hashlib.sha256(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{b}:{e}" for k, b, e in spans).encode()).hexdigest()


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("378282246310005")


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "0123456789. -", "+12 ()-.", "x@y.z@ü%", "1.2 5-٣"])
def test_base_spans_are_those_of_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for part in ("1", "a", "1.", "a@", "+1 ", "@", "1 ", "9:"):
        base_spans(part * (200_000 // len(part)))


def test_same_base_as_plain_patterns(spark, data):
    df = table(spark, data, "documents")
    for got in (df, documents(spark)):
        texts = sorted(((r.doc_id, digest(plain_spans(r.text or ""))) for r in got.collect()), key=repr)
        rows = document_personal_data(got).collect()
        assert sorted(((r.doc_id, r.base_sha256) for r in rows), key=repr) == texts
    assert document_personal_data(no_documents(spark)).collect() == []


def test_counts_and_lists(spark):
    got = {(r.doc_id, r.spans): r for r in document_personal_data(documents(spark)).collect()}
    r = next(r for (i, s), r in got.items() if i == 7 and s)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
    assert r.spans.startswith("email:") and ",phone:" in r.spans
    r = next(r for (i, _), r in got.items() if i == 8)
    assert (r.n_ip, r.n_card) == (1, 1)
    assert len(got) <= len(DOCUMENTS)


def bootstrapped(n=30):
    """Numbers after 'tel:' are phones, which the base patterns see only with a plus; numbers after 'order' are not."""
    rng = random.Random(4)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    filler = lambda: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=6))
    rows = [(i, f"{filler()} tel: +1 {number()} {filler()}") for i in range(n)]
    rows += [(100 + i, f"{filler()} tel: {number()} {filler()}") for i in range(2)]
    rows += [(200 + i, f"{filler()} order {number()} {filler()}") for i in range(n)]
    return rows + [(300, filler()), (301, f"{filler()} tel: soon {filler()}")]


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    df = spark.createDataFrame(bootstrapped(), "doc_id long, text string")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    for i in (100, 101):
        assert len(got[i].more) == 1 and got[i].more[0].kind == 3
        text = dict(bootstrapped())[i]
        assert re.fullmatch(r"\(\d{3}\) 555-\d{4}", text[got[i].more[0].begin : got[i].more[0].end])
    assert all(not r.more for i, r in got.items() if i not in (100, 101))


def test_as_many_unseen_identifiers_as_seeds(spark):
    rows = bootstrapped()
    rows += [(400 + i, t.replace("tel: +1 ", "tel: ")) for i, t in rows[:30]]
    got = {r.doc_id: r.more for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unseen = {100, 101, *range(400, 430)}
    assert {i for i, more in got.items() if more} == unseen
    assert all(len(got[i]) == 1 and got[i][0].kind == 3 for i in unseen)


def test_masked_text():
    assert masked("mail a@b.c now", [(0, 5, 10)]) == "mail [EMAIL] now"
    assert masked("0123456789", [(2, 2, 6), (3, 4, 8)]) == "01[CARD]89"


def test_masking_leaves_clean_rows_alone(spark):
    df = documents(spark)
    got = mask_personal_data(df)
    assert got.columns == df.columns and got.count() == df.count()
    before, after = ({(r.doc_id, r.text) for r in x.collect()} for x in (df, got))
    changed = {i for i, t in before - after}
    assert changed == {7, 8}
    text = next(t for i, t in after if i == 8)
    assert "[IP]" in text and "[CARD]" in text and "日本語" in text
    row = got.where("doc_id = 8").first()
    assert row.n_chars == len(row.text)


def test_contexts_are_whole_words():
    text = "call\t " + " " * 90 + "tel: +1 (555) " + "\n" * 50 + "Supercalifragilisticexpialidocious-and-longer, " + "z" * 61
    begin, end = text.index("+1"), text.index(")") + 1
    assert Words(text).contexts(begin, end) == ["L tel:", "R supercalifragilisticexpialidocious-and-longer,", "B tel: _ supercalifragilisticexpialidocious-and-longer,", "LL call tel:"]
    assert Words("id=7x").contexts(3, 4) == ["L id=", "R x", "B id= _ x"]
    assert Words("z" * 61 + "@1 2").contexts(62, 63)[:2] == ["L ..long..", "R 0"]
    assert Words("1").contexts(0, 1) == ["L ^", "R $", "B ^ _ $"]


def plain_scores(mentions, rounds=3, support=5.0, purity=0.9, unlabelled=0.1):
    """The scores of patterns and instances with dictionaries."""
    edges = {(seed, looks, value, p) for seed, looks, _, _, value, around in mentions for p in around}
    own, hard = {}, {}
    for seed, _, _, p in edges:
        if seed >= 0:
            own[p, seed] = own.get((p, seed), 0) + 1
            hard[p] = hard.get(p, 0) + 1
    possible = {(p, value, looks, k) for seed, looks, value, p in edges if seed < 0 for k in range(4) if looks >> k & 1}
    met = {}
    for p, *_, k in possible:
        met[p, k] = met.get((p, k), 0) + 1
    strange = {(p, k) for (p, k), n in met.items() if n >= support and p not in hard and p.split(" ")[0] in ("L", "R")}
    sides = {}
    for p, value, looks, k in possible:
        if (p, k) in strange:
            sides.setdefault((value, looks, k), set()).add(p.split(" ")[0])
    other = {"L": "R", "LL": "R", "R": "L", "B": None}
    weight = {x: 1.0 if other[x[0].split(" ")[0]] in sides.get(x[1:], ()) else unlabelled for x in possible}
    against = {}
    for x, w in weight.items():
        against[x[0], x[3]] = against.get((x[0], x[3]), 0) + w
    trust_of, patterns = {}, {}
    for _ in range(rounds):
        sums = {key: [float(n), 0.0] for key, n in own.items()}
        for x, w in weight.items():
            t = trust_of.get(x[1:])
            if t is not None:
                both = sums.setdefault((x[0], x[3]), [0.0, 0.0])
                both[0] += t
                both[1] += t * w
        patterns = {}
        for (p, k), (s, gained) in sums.items():
            share = s / (s + hard.get(p, 0) - own.get((p, k), 0) + max(against.get((p, k), 0) - gained, 0))
            if s >= support and share >= purity:
                patterns[p, k] = share * min(1, math.log2(1 + s) / math.log2(1 + support))
        doubt = {}
        for x in possible:
            if (x[0], x[3]) in patterns:
                doubt[x[1:]] = doubt.get(x[1:], 1.0) * max(1 - patterns[x[0], x[3]], 1e-9)
        trust_of = {x: 1 - d for x, d in doubt.items()}
    return patterns, trust_of


def planted(rng, n=40):
    """(text, begin, end, kind or None): all four kinds in contexts that seeds share, and decoys that look like them in others."""
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    filler = lambda: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "elit"], k=5))

    def card():
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def no_card():
        return next(x for x in iter(lambda: "4" + digits(15), None) if not luhn(x))

    hexes = lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))
    name = lambda: "".join(rng.choices("bcdfgaeiou", k=8))
    kinds = {
        0: (("mail to", "write at"), lambda: f"{name()}@{name()}.org", lambda: f"{name()}@{name()}"),
        1: (("address of host", "from node"), lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), hexes),
        2: (("card number", "paid with"), card, no_card),
        3: (("phone no", "ring us"), lambda: f"+49 {rng.randrange(100, 999)} {digits(7)}", lambda: f"0{rng.randrange(100, 999)} {digits(7)}"),
    }
    decoys = {0: "login as", 1: "checksum is", 2: "serial batch", 3: "order ref"}
    rows = []
    for k, (before, seed, unseen) in kinds.items():
        for make, kind, leads, times in ((seed, None, before, 3 * n), (unseen, k, before, n), (unseen, -1, (decoys[k],), n)):
            for _ in range(times):
                lead, value = f"{filler()} {rng.choice(leads)} ", make()
                rows.append((lead + value + f" {filler()}", len(lead), len(lead) + len(value), kind))
    rng.shuffle(rows)
    return rows


def test_scores_are_those_of_a_plain_version(spark):
    rows = [t for t, *_ in planted(random.Random(6), 12)] + [t for _, t in bootstrapped()]
    mentions = [m for t in rows for m in scan_text(t)[1]]
    df = spark.createDataFrame([(m[0], m[1], m[4], m[5]) for m in mentions], "seed int, looks int, value string, contexts array<string>")
    patterns, instances = score_patterns(df)
    want, trust = plain_scores(mentions)
    got = {(r.pattern, r.kind): r.trust for r in patterns.collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = {(r.value, r.looks, r.kind): r.trust for r in instances.collect()}
    assert got.keys() == trust.keys() and trust and all(abs(got[k] - trust[k]) < 1e-9 for k in trust)


def test_precision_and_recall_of_planted_contexts(spark):
    """Unseen identifiers of each kind in the contexts of seeds are found, look-alikes elsewhere aren't."""
    rows = planted(random.Random(9))
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    found = {(r.doc_id, x.begin, x.end, x.kind) for r in find_personal_data(df).collect() for x in r.more}
    unseen = {(i, b, e, k) for i, (_, b, e, k) in enumerate(rows) if k is not None and k >= 0}
    for kind in range(4):
        got, want = ({x for x in s if x[3] == kind} for s in (found, unseen))
        right = len(got & want)
        print(kind, len(want), len(got), right)
        assert right >= 0.9 * len(want) and right >= 0.9 * len(got), (kind, len(want), len(got), right)

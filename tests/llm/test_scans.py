"""Ops 1, 3, 4, 9: documents on their own (op 1 and 4 with a trained model)."""

import base64
import random

import numpy as np
import pytest
from .brute import contamination, pii, quality, secrets, sha
from .conftest import EDGE

from contactlake.llm import decontaminate as D
from contactlake.llm import pii as P
from contactlake.llm import quality as Q
from contactlake.llm import secret_scan as S
from contactlake.llm.packed import Packed


def test_secret_rules():
    r = random.Random(3)
    parts = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdef0123456789", "AKIA",
             "ABCDEFGHIJ0123456", "x", "é", "-", "\n", "ſecret", "toKen"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = S.Scanner(np.zeros(S.K * S.K)).scan(texts)
    assert [[(s, S.ORDER[k], e) for s, k, e in x] for x in got] == [secrets(t) for t in texts]


def test_secret_model_held_out(spark, small):
    """Chains trained on labelled samples tell new random strings from words."""
    r = random.Random(5)
    secret = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = small + [(10_000 + i, f"token = {secret(b64, 32)} and more") for i in range(60)]
    table = S.train(spark.createDataFrame(rows, "doc_id long, text string"))
    random_ = [secret(b64, 28) for _ in range(200)] + [secret("0123456789abcdef", 32) for _ in range(100)]
    words = sorted({w for _, t in small for w in t.split() if len(w) >= 12 and w.isascii() and w.isalpha()})[:300]
    assert (S.ratio(table, random_) >= S.THRESHOLD).mean() > 0.95
    assert (S.ratio(table, words) < S.THRESHOLD).mean() > 0.99
    found = S.Scanner(table).scan([f"see {random_[0]} here", "plain words only"])
    assert found[0] == [(4, "random", 32)] and found[1] == []


def test_pii_base():
    r = random.Random(4)
    parts = list("0123456789..@@+- ()ab4") + ["12", "é", "255", "256", "0", "a.b"]
    scanner = P.Scanner()
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert [(s, P.ORDER[k], e) for s, k, e in scanner.spans(t) if k in P.BASE_KINDS] == pii(t)


def test_pii_added():
    spans = P.Scanner().spans("IBAN: DE89 3704 0044 0532 0130 00, http://bob:pw@x.org/a. ssn 123-45-6789; an account of events")
    assert [(s, e) for s, k, e in spans if k == "account"] == [(6, 33), (62, 73)]
    assert [(s, e) for s, k, e in spans if k == "url"] == [(35, 56)]


@pytest.mark.parametrize("part", ["account ", "://", "http://", "+1 ", "1.1.", "account no \t", "a@", "1-"])
def test_pii_grows_with_the_text(part):
    """Repeated anchors cost time in proportion, whatever the length."""
    import time
    scanner = P.Scanner()
    took = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        scanner.spans(part * (size // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 5


def test_contamination_automaton():
    r = random.Random(1)
    for _ in range(600):
        words = ["a", "B", "c", "é", "d1"][:r.randint(2, 5)]
        make = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))  # noqa: E731, B023
        items, texts, w = [(str(i), make(12)) for i in range(r.randint(0, 5))], [make(40) for _ in range(4)], r.choice([2, 3, 5, 10])
        m, p = D.Marker(items, w), Packed([t.encode() for t in texts])
        start, end, doc = D.words_of(p)
        hit, found = np.zeros(len(start), bool), [set() for _ in texts]
        m.mark(p, start, end, doc, hit, found)
        got = list(zip(np.bincount(doc, minlength=4).tolist(), np.bincount(doc, weights=hit, minlength=4).astype(int).tolist(),
                       map(sorted, found), strict=True))
        assert got == contamination(texts, items, w), (items, texts, w)


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_contamination_blocks_and_edges(spark, edge, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 14))) for i in range(30)] + [(90, None), (91, ""), (92, "lazy dog the")]
    docs = edge.unionByName(spark.createDataFrame([(50, "Intro " + items[3][1].upper() + " w17 outro")], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(docs.withColumn("n_hit", docs.doc_id), bench).collect()
    texts = [t for _, t in EDGE] + ["Intro " + items[3][1].upper() + " w17 outro"]
    exp = contamination(texts, [(str(i), t) for i, t in items])
    got = sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    assert got == sorted((n, h, len(i), sha(",".join(i)), h > 0) for n, h, i in exp)
    kept = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench).collect()}
    assert 50 not in kept and kept[5] == "one two"         # mostly benchmark text: gone
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_clean_cuts_the_span(spark):
    docs = spark.createDataFrame([(1, "keep " * 30 + "a b c d e f g h i j k" + " tail é" * 20, 5)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string")
    r = D.decontaminate(docs, bench).first()
    assert r["text"] == "keep " * 30 + " k" + " tail é" * 20 and r["n_chars"] == len(r["text"])


def test_quality_features(small):
    texts = [t for _, t in small] + [t or "" for _, t in EDGE]
    f = Q.features(Packed([t.encode() for t in texts]))
    got = list(zip(*(f[c].tolist() for c, _ in Q.FEATURES), strict=True))
    assert got == [quality(t) for t in texts]


def test_kneser_ney_sums_to_one(spark, small):
    """Every seen context's probabilities over the 64 symbols add up to 1."""
    docs = spark.createDataFrame([(i, t, "x" if i % 2 else None) for i, t in small], "doc_id long, text string, lang string")
    counts = Q.gram_counts(docs)
    by_hand = sum(len(t.encode()) for i, t in small if not quality(t)[5])
    assert counts.agg({"n": "sum"}).first()[0] == by_hand
    models = Q._models(Q.kneser_ney(counts))
    assert sorted(models) == ["", "=x"]
    for m in models.values():
        ctx = m.arrays[Q.ORDER][0][::500] >> Q.BITS
        for c in ctx.tolist():
            p = 10 ** m.logp((c << Q.BITS) + np.arange(64))
            assert abs(p.sum() - 1) < 1e-6


def test_quality_verdicts(spark, edge, empty):
    good = ["the river runs past the old mill and the children watch it turn in the evening light " + f"number{i} " * 1 +
            " ".join(f"{a}{b}" for a in ("house", "field", "stone", "water", "cloud") for b in ("", "s", "ed", "ing", "er", i)) +
            " while people walk along the bank and talk about the day that has passed so quickly" for i in range(60)]
    junk = " ".join("#$%&" + "qzx|"[i % 4] * 3 + str(i) for i in range(120))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, junk])], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in Q.judge(docs).collect()}
    assert not out[len(good)] and all(out[i] for i in range(len(good)))
    odd = Q.judge(edge.selectExpr("doc_id", "text", "cast(null as string) lang", "1 as n_words"))
    assert odd.count() == len(EDGE) and odd.where("base_failed and kept").count() == 0
    assert Q.filtered(empty).count() == 0


def test_quality_partly_junk(spark):
    """Texts with 20 to 45 % of base64 lines are rejected, the same texts
    without them are kept, as is a quotation in another language."""
    r = random.Random(11)
    words = {x: ["".join(r.choice(x) for _ in range(r.randint(2, 9))) for _ in range(400)] for x in ("etaoinshrdlu", "aeiouzkvjmyp")}
    line = lambda x: " ".join(r.choice(words[x]) for _ in range(12)) + "."
    text = lambda x, n: [line(x) for _ in range(n)]
    rows = [(i, "\n".join(text(x, r.randint(20, 40))), x) for i, x in enumerate(["etaoinshrdlu", "aeiouzkvjmyp"] * 150)]
    for i, share in enumerate((0.2, 0.25, 0.35, 0.45)):
        good = text("etaoinshrdlu", 30)
        size = int(sum(map(len, good)) * share / (1 - share))
        junk = base64.b64encode(r.randbytes(size)).decode()[:size]
        rows.append((1000 + i, "\n".join(good + [junk[k:k + 76] for k in range(0, size, 76)]), "etaoinshrdlu"))
        rows.append((2000 + i, "\n".join(good), "etaoinshrdlu"))
    rows.append((3000, "\n".join(text("etaoinshrdlu", 30) + text("aeiouzkvjmyp", 8)), "etaoinshrdlu"))
    out = {x["doc_id"]: x["kept"] for x in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[1000 + i] for i in range(4))
    assert all(out[2000 + i] for i in range(4)) and out[3000] and sum(out[i] for i in range(300)) > 280


def test_scans_edges(spark, edge, empty):
    for f in (S.span_digest, P.span_digest):
        rows = f(edge).collect()
        assert len(rows) == len(EDGE) and f(empty).count() == 0
        assert {r["base_sha256"] for r in rows if r["doc_id"] in (1, 2)} == {sha("")}
    assert P.find(edge.withColumn("pii", edge.doc_id)).columns == ["doc_id", "text", "pii"]

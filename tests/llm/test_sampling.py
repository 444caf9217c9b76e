"""Packing, hard negatives and importance resampling against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactlake.llm import bpe, hard_negatives as H, importance as I, packing as P
from tests.llm import brute


def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, texts, size=P.SIZE):
    """Each id in one piece, gapless sequences, right checksums."""
    want = Counter()
    for (i, _), ids in zip(texts, reference_ids([t or "" for _, t in texts]), strict=True):
        doc = np.array([*ids, 0], "<u4")
        for s in range(0, len(doc), size):
            want[i, s, len(doc[s:s + size]), zlib.crc32(doc[s:s + size]), len(doc)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return by


def test_packing(spark, small):
    docs = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    by = check_pieces(P.packed_pieces(docs).collect(), small)
    used = sum(n for parts in by.values() for _, n in parts)
    assert used / (len(by) * P.SIZE) > 0.98


def test_packing_edges(spark, edge, empty):
    from tests.llm.conftest import EDGE
    extra = edge.withColumn("part", F.lit("x")).withColumn("sequence_id", F.lit(1))
    check_pieces(P.packed_pieces(extra, size=64).collect(), EDGE, 64)
    assert P.packed_pieces(empty).count() == 0


def test_packed_sequences_give_the_ids_back(spark, small):
    docs = spark.createDataFrame(small[:60], "doc_id long, text string").repartition(2)
    pieces = P.piece_table(docs, 128, ids=True)
    rows = {(r.sequence_id, r.offset): r for r in P.assigned(pieces, 128).collect()}
    docs_of = {}
    for r in P.packed_sequences(docs, 128).collect():
        assert len(r.ids) <= 128 and r.doc_starts[0] == 0
        docs_of[r.sequence_id] = r
    assert sum(len(r.ids) for r in docs_of.values()) == sum(r.length for r in rows.values())
    got = {}
    for r in rows.values():
        got.setdefault(r.doc_id, {})[r.start] = r.ids
    for (i, text), ids in zip(small[:60], reference_ids([t or "" for _, t in small[:60]]), strict=True):
        assert [x for _, p in sorted(got[i].items()) for x in p] == [*ids, 0]


@pytest.mark.parametrize("seed", range(6))
def test_shortest_pack_first_is_the_sequential_rule(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 50, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
    got = Counter()
    for packs, runs in P.shortest_pack_first(Counter(lengths), size):
        got[tuple(x for x, n in runs for _ in range(n))] += packs
    packs = []
    for x in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + x <= size]
        if fits:
            min(fits, key=sum).append(x)
        else:
            packs.append([x])
    assert Counter(x for p, n in got.items() for _ in range(n) for x in p) == Counter(lengths)
    # equal fill levels are told apart differently, the number of packs and their levels are the rule's
    assert sum(got.values()) <= len(packs) + 1
    slots = P.slot_table(P.shortest_pack_first(Counter(lengths), size), size)
    assert sorted(zip(slots["length"], slots["rank"], strict=True)) == list(zip(slots["length"], slots["rank"], strict=True))


def test_encoder_equals_the_library():
    e = P.Encoder(bpe.tokenizer_path())
    rng = random.Random(3)
    vocabulary = [b.decode(errors="ignore") for b in rng.sample(sorted(e.quick._mergeable_ranks), 5000)]
    chars = [f"a{chr(c)}1{chr(c)}. {chr(c)}\n{chr(c)}" for c in rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 20_000)]
    mixed = ["".join(rng.choice(["<|endoftext|>", "<|", "'s", " ", "\n", " ", "é", "日本", "ing", " the", "12"]) for _ in range(rng.randint(1, 30)))
             for _ in range(5000)]
    long = ["x" * 200_000, " " * 150_000, "word " * 50_000, "日" * 100_000 + " a", ("ab cd\n" * 30_000)]
    texts = [*vocabulary, *chars, *mixed, *long]
    for t, ids in zip(texts, reference_ids(texts), strict=True):
        assert e.ids(t).tolist() == ids, t[:40]


# --- hard negatives ---

def mined_by_hand(rows):
    v = []
    for i, e, lab in rows:
        if lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  (shorter vectors end in zeros)
    first = lambda found, n: sorted(found, key=lambda t: (-t[0], t[1] is None, t[1] or 0))[:n]
    out = []
    for k, (i, lab, q) in enumerate(v):
        if i is None or i % 100:
            continue
        scores = [(dot(q, w), j, other == lab) for m, (j, other, w) in enumerate(v) if m != k]
        for p, pid, _ in first([s for s in scores if s[2]], 5):
            near = first([s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p], 10)
            out += [(i, pid, r + 1, j, p, s) for r, (s, j, _) in enumerate(near)]
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def shown(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()),
                  key=lambda t: tuple((x is None, x or 0) for x in t))


def clusters(n, seed, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist(), i % 6) for i in range(n)]


@pytest.mark.parametrize("leaf_rows,fit_rows", [(40, 300), (20, 10_000), (5000, 100)])
def test_hard_negatives(spark, leaf_rows, fit_rows):
    rows = clusters(1200, leaf_rows)
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(3).withColumn("row", F.lit("a")).withColumn("score", F.lit(1))
    got = shown(H.mined(df, fit_rows=fit_rows, leaf_rows=leaf_rows))
    assert got == sorted(mined_by_hand(rows)) and len(got) > 100


def test_hard_negatives_many_equal_rows(spark):
    rows = clusters(400, 9) + [(1000 + i, [1.0] * 12, 3) for i in range(3000)]
    got = shown(H.mined(spark.createDataFrame(rows, EMBEDDINGS).repartition(4), fit_rows=600, leaf_rows=50))
    assert got == sorted(mined_by_hand(rows))


def test_hard_negatives_edges(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 2), (300, [float("nan"), 1.0], 2),
            (400, [1.0, float("inf")], 2), (500, [1.0, 1.0], None), (None, [1.0, 2.0], 2), (None, [2.0, 1.0], 1), (600, [1.0], 2), (700, [], 2),
            (-100, [-1.0, 0.5], 4), (3, [0.3, 0.9], 4), (4, [0.5, 0.5], 5), (5, [0.4, 0.4], 2), (6, [0.4, 0.4], 2), (800, [1.0, 1.0, 1.0], 9)]
    assert shown(H.mined(spark.createDataFrame(rows, EMBEDDINGS))) == sorted(mined_by_hand(rows), key=lambda t: tuple((x is None, x or 0) for x in t))
    assert H.mined(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert H.mined(spark.createDataFrame([(100, [1.0], 1)], EMBEDDINGS)).count() == 0


def test_hard_negative_groups_are_bounded(spark, monkeypatch):
    """Rows and queries of a group do not grow with those of a leaf, and small leaves share one."""
    monkeypatch.setattr(H, "GROUP_QUERIES", 200)
    assert H.homes(np.array([100, 200, 300, 0, 7000, 10, 10]), 500).tolist() == [0, 0, 1, 1, 2, 3, 3]
    groups = F.when(F.col("id") < 7000, 0).otherwise(F.col("id") % 3)
    rows, asked = (spark.range(n).select(groups.cast("long").alias("grp"), F.col("id").alias("row")) for n in (9000, 1500))
    left, right = (x.groupBy("grp", "a", "b").count().collect() for x in H.grouped(rows, asked, 500))
    assert {(r["grp"], r["a"], r["b"]) for r in left} == {(r["grp"], r["a"], r["b"]) for r in right} and len(left) == 16 * 8
    assert max(r["count"] for r in left) < 750 and max(r["count"] for r in right) < 300


def test_hard_negative_tables_have_narrow_rows(spark):
    """A reader holds thousands of rows at once, so a row has one vector (the ranges of the tree aside)."""
    rows = H.vectors(spark.createDataFrame(clusters(900, 4), EMBEDDINGS))
    index = H.Index(rows, fit_rows=300, leaf_rows=40)
    assert index.indexed.where("leaf >= 0").agg(F.count("row"), F.max(F.octet_length("vector"))).first() == (900, 12 * 8)
    assert index.indexed.where("leaf = -1").count() > 0


def test_hard_negatives_hold_the_best_only(spark, monkeypatch):
    """Groups of many leaves, shares of leaves and dropped candidates give the same rows."""
    for name, value in {"GROUP_ROWS": 100, "LEAST_GROUP": 1, "GROUP_QUERIES": 3, "BLOCK_ROWS": 16, "BLOCK_QUERIES": 2, "HELD": 10, "SEND_ROWS": 2}.items():
        monkeypatch.setattr(H, name, value)
    rows = clusters(1300, 21) + [(2000 + i, [1.0] * 12, 3) for i in range(300)]
    got = shown(H.mined(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), fit_rows=400, leaf_rows=30))
    assert got == sorted(mined_by_hand(rows)) and len(got) > 100


def test_tree_passes_over_leaves(spark):
    rows = np.floor(256 * np.array([e for _, e, _ in clusters(3000, 1)])).astype(np.int64)
    tree = H.Tree(rows, len(rows), leaf_rows=100)
    leaf = tree.assign(rows)
    q = rows[:50]
    scores = H.products(q, rows)
    low = np.sort(scores, 1)[:, -10:-9]
    high = np.full_like(low, 2 ** 62)
    reached = {(int(a), b) for on, b in tree.reached(q, low, high) for a in on}
    at, col = np.nonzero(scores >= low)
    assert {(int(a), int(leaf[c])) for a, c in zip(at, col, strict=True)} <= reached
    assert len(reached) < 0.8 * 50 * tree.leaves


# --- importance resampling ---

def resampled_by_hand(docs, target, longest=1, buckets=10_000):
    words = lambda t: brute.ALNUM.findall(brute.low(t))
    feats = lambda t: [" ".join(w[k:k + n]) for w in [words(t)] for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in feats(t))
    t_ = Counter(bucket(f) for _, t in target for f in feats(t))
    big_s, big_t = sum(s.values()), sum(t_.values())
    out = []
    for i, text in docs:
        f = feats(text)
        gain = [math.floor(1000 * math.log((t_[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, f)]
        weight = sum(gain) // len(f) if f else 0
        h = int(brute.sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[:10 * len(able) // 100])]
    rest = able[len(drawn):] + [r for r in out if r[4] < 20]
    return Counter([*drawn, *((*r[:4], None) for r in rest)])


def listed(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("longest", [1, 2])
def test_resampled(spark, small, longest):
    target = [(i, t) for i, t in small if i % 9 == 0]
    docs, aim = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (small, target))
    assert listed(I.resampled(docs, aim, longest=longest)) == resampled_by_hand(small, target, longest)


def test_resampled_edges(spark, edge, empty, small):
    from tests.llm.conftest import EDGE
    rows = EDGE * 3 + small[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("rank", F.lit("x"))
    assert listed(I.resampled(docs, edge)) == resampled_by_hand(rows, EDGE)
    assert listed(I.resampled(docs, empty)) == resampled_by_hand(rows, [])
    assert I.resampled(empty, edge).count() == 0
    assert I.drawn_documents(docs, edge).columns == docs.columns


def test_overlapped_scan_gives_every_run():
    text = "One  two-THREE é4\n\nfive".encode()
    plain = I.collapsed(text)
    assert plain == "one two three é4 five".encode()
    spans = [m.span() for m in I.scanners(3)[2].finditer(plain, overlapped=True)]
    assert [plain[a:b].decode() for a, b in spans] == ["one two three", "two three é4", "three é4 five"]

"""Ops 8 and 10, and the pipeline."""

import random

import public_tokenizers
import pytest
from .brute import sha
from .conftest import EDGE
from tokenizers import Tokenizer

from contactlake.llm import bpe as B
from contactlake.llm import token_counts as C


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoding(library, small, monkeypatch):
    monkeypatch.setattr(B, "TRIE_WORDS", 50)
    monkeypatch.setattr(B, "KNOWN_WORDS", 3000)
    r = random.Random(6)
    odd = ["".join(r.choice(["a", "b", " ", "  ", "'", "s", "re", "\n", "12", "é", "<|endoftext|>", "\t", "!!", "日本", " ", "🙂"])
                   for _ in range(r.randint(0, 30))) for _ in range(2000)]
    texts = [t for _, t in small] + odd + ["a" * 3000, " " * 300, "ab" * 2000]
    bpe = B.Bpe(B.tokenizer_path())
    got = [i for k in range(0, len(texts), 300) for i in bpe.encode_batch(texts[k:k + 300])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(i) for i in got] == texts
    broken = [199, 50256, 200, 262]
    assert bpe.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_digest_and_edges(spark, edge, empty, library):
    rows = B.round_trip_digest(edge).collect()
    exp = sorted((i or -1, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))
                 for (i, t) in EDGE for e in [library.encode(t or "", add_special_tokens=False)])
    assert sorted((r[0] or -1, *r[1:]) for r in rows) == exp
    assert B.round_trip_digest(empty).count() == 0
    back = B.decode(B.encode(edge.withColumn("ids", edge.doc_id)))
    assert back.columns == ["doc_id", "ids", "text"] and {r["text"] for r in back.collect()} == {t or "" for _, t in EDGE}


def test_edits_follow_a_full_recount(library):
    library.encode_special_tokens = True
    bpe = B.Bpe(B.tokenizer_path(), specials=False)

    def counter(pieces):
        bpe.learn(pieces)
        return [len(bpe.known[p]) for p in pieces]

    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "'", "s", "re", "\n", "1", "2", ".", " the", "é", "ll", "\t", "!", "<|endoftext|>"]
    for _ in range(2500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        tree = C.PretokenTree(bpe.split(text), counter, bpe.split)
        for _ in range(4):
            i = r.randint(0, len(text))
            j = min(len(text), i + r.choice([0, 0, 1, 2, 5]))
            new = "".join(r.choice(parts) for _ in range(r.randint(0, 3)))
            tree.edit(i, j, new)
            text = text[:i] + new + text[j:]
            assert [p for leaf in tree.leaves for p in leaf] == bpe.split(text)
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_edits_touch_little():
    bpe = B.Bpe(B.tokenizer_path(), specials=False)

    def counter(pieces):
        bpe.learn(pieces)
        return [len(bpe.known[p]) for p in pieces]

    tree = C.PretokenTree(bpe.split("one two three " * 5000), counter, bpe.split)
    tree.edit(30_000, 30_003, "X")
    assert tree.encoded < 8


def test_masked_counts(spark, edge, empty, library):
    library.encode_special_tokens = True
    rows = [(1, "mail a.b@c.org or 1234 5678 9012 3456, a.b@c.org"), (2, "é 🙂 x@y.zz"), (3, "nothing here 12"), (4, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in C.edited_counts(C.mask_edits(docs), keep_text=True).collect()}
    want = {1: "mail [MASK] or [MASK], [MASK]", 2: "é 🙂 [MASK]", 3: "nothing here 12", 4: "[MASK]"}
    for i, t in rows:
        assert out[i]["text"] == want[i]
        assert out[i]["n_tokens"] == len(library.encode(want[i], add_special_tokens=False).ids)
        assert out[i]["n_tokens_before"] == len(library.encode(t, add_special_tokens=False).ids)
    assert C.edited_counts(C.mask_edits(edge)).count() == len(EDGE)
    assert C.edited_counts(C.mask_edits(empty)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    out = P.run(spark, sf)
    assert out.where("not round_trip").count() == 0
    assert 0 < out.count() < docs.count()
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns

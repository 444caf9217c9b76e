"""Ops 2, 5, 6, 7: statistics and joins over the corpus."""

import random
from collections import defaultdict

import numpy as np
import pytest
from .brute import lm, lm_interpolated, near, suffix
from .conftest import EDGE
from pyspark.sql import functions as F

from contactlake.llm import components as K
from contactlake.llm import line_dedup as L
from contactlake.llm import lm_score, near_dedup, suffix_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_lm_scores(spark, small):
    n, v, exp = lm(small)
    rows = lm_score.scores(frame(spark, small)).collect()
    assert len(rows) == len(small)
    for r in rows:
        held, tokens, known, base = exp[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    per = lambda held: np.mean([r["score"] / r["n_tokens"] for r in rows if r["held_out"] == held])
    base = np.mean([r["base_score"] / r["n_tokens"] for r in rows if r["held_out"]])
    assert per(True) > base                         # better than the base model on unseen texts


def test_lm_score_by_hand(spark, small):
    """Interpolated scores against dictionaries, with the same number of EM steps."""
    n, v, _ = lm(small)
    exp = lm_interpolated(small, lm_score.BUCKETS, lm_score.ITERATIONS, lm_score.ENOUGH)
    for r in lm_score.scores(frame(spark, small)).collect():
        assert r["score"] == pytest.approx(exp[r["doc_id"]], rel=1e-9)


def test_lm_learns_nothing_from_held_out_texts(spark, small):
    other = [(i, "quite another text " * 9 if lm_score.kind(i) == lm_score.HELD_OUT else t) for i, t in small]
    a, b = ({r["doc_id"]: r for r in lm_score.scores(frame(spark, rows)).collect()} for rows in (small, other))
    taught = [i for i in a if lm_score.kind(i) != lm_score.HELD_OUT]
    assert len(taught) < len(a)
    for i in taught:                                # sums of doubles may be added in another order
        assert b[i][:5] == a[i][:5] and b[i][5:] == pytest.approx(a[i][5:], rel=1e-9)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_hashes_of_thue_morse_strings(spark):
    """Strings that cancel out in polynomials modulo 2**64 are told apart, as
    words, lines, shingles and grams."""
    from contactlake.llm import quality
    from contactlake.llm.packed import Packed
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    p = Packed([one.encode(), two.encode(), one.upper().encode()])
    for size in (3, 7, 8, 9, 64, 1024, 2048, 4096):
        h, folded = (p.hashes(p.start, p.start + size, fold) for fold in (False, True))
        assert h[0] != h[1] and folded[0] != folded[1] and folded[0] == folded[2] and h[0] != h[2]
    g = p.grams(2048)
    assert len(np.unique(g[[0, 4097]])) == 2
    rows = [(1, one), (2, two), (3, f"{one}\n{two}\n{one}"), (4, f"{one} {two}"), (5, f"{two} {one}")]
    docs = frame(spark, rows)
    judged = {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(docs.withColumn("lang", F.lit("en"))).collect()}
    assert judged == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    near_ = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert len(set(near_.values())) == 5
    known = {r["doc_id"]: r["n_known"] for r in lm_score.scores(frame(spark, [(3, one), (10, two)])).collect()}
    assert lm_score.kind(10) == lm_score.HELD_OUT or known[10] == 2


def test_substring_hashes_agree(small):
    from contactlake.llm.packed import Packed
    texts = [t.encode() for _, t in small[:20] if t]
    p, whole = Packed(texts), Packed([b"pad" + texts[3], b"x" * 13 + texts[3]])
    r = random.Random(1)
    for _ in range(300):
        a = r.randrange(len(texts[3]))
        b = r.randrange(a, min(a + 60, len(texts[3])) + 1)
        at = np.array([p.start[3] + a])
        h = {int(p.hashes(at, at + b - a)[0]), *(int(x) for x in whole.hashes(whole.start + [3 + a, 13 + a], whole.start + [3 + b, 13 + b]))}
        assert len(h) == 1


def test_em_weights(spark):
    counts = spark.createDataFrame([(3, 10, 8, 8, 90), (3, 10, 8, 0, 10), (0, 5, 0, 0, 7)], "bucket long, cw long, cv long, cvw long, n long")
    w = lm_score.learn_weights(counts, 1000, 50)
    assert w[3, 0] > 0.8 and w[0, 0] < 1e-6 and np.allclose(w.sum(axis=1), 1)


def test_lm_edges(spark, edge, empty):
    rows = lm_score.scores(edge).collect()
    assert len(rows) == len(EDGE) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm_score.scores(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (201, 200)] + [(300, i) for i in range(301, 340)]
    got = dict(map(tuple, K.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, **{i: 300 for i in range(300, 340)}}
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(seed, groups=6, size=12):
    """Texts of groups of near copies of differing closeness, with exact copies."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(2, 60))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"w{r.randint(0, 400)}"
            rows.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, small, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = variants(7) + [(1000 + i, t) for i, t in small]
    exp = near(rows)
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == exp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_edges(spark, edge, empty):
    got = near_dedup.near_duplicates(edge, shingle=2).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[11]["component_id"] == 10 and not by[11]["kept"] and by[1]["kept"] and by[2]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert sum(r["kept"] for r in got if r["doc_id"] == 4) == 2
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(edge.withColumn("key", F.lit(1)), shingle=2)
    assert kept.columns == ["doc_id", "text", "key"] and kept.where("doc_id = 11").count() == 0


def test_suffix(spark, small):
    got = defaultdict(list)
    for r in suffix_dedup.deduplicated(frame(spark, small), texts=False).collect():
        got[r[0]].append(tuple(r[1:]))
    assert {k: sorted(v) for k, v in got.items()} == suffix(small)


def test_suffix_overlaps(spark):
    r = random.Random(2)
    base = "".join(r.choice("ab c\né") for _ in range(3000))
    rows = [(None, base[:400]), (3, None), (4, "")]
    for _ in range(60):
        t = ""
        for _ in range(r.randint(0, 6)):
            a = r.randint(0, 2800)
            t += base[a:a + r.randint(10, 200)] + "a" * (r.randint(0, 1500) if r.random() < 0.3 else 0)
        rows.append((r.randint(5, 50), t))
    got = defaultdict(list)
    for x in suffix_dedup.deduplicated(frame(spark, rows)).collect():
        got[x[0]].append(tuple(x[1:5]))
    assert {k: sorted(v) for k, v in got.items()} == suffix(rows)


def test_suffix_edges(spark, edge, empty):
    assert suffix_dedup.deduplicated(edge).count() == len(EDGE) and suffix_dedup.deduplicated(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    r = random.Random(9)
    pool = [" ".join(f"word{r.randint(0, 300)}" for _ in range(r.randint(3, 70))) for _ in range(25)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(pool).split()
            if r.random() < 0.6:
                w[r.randrange(len(w))] += r.choice(["x", "y", ""])
            out.append("  ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(out)))
    docs = frame(spark, rows)
    text, at = {}, defaultdict(list)
    for x in L.lines(docs).select("doc_id", "pos", "cls", F.array_join("words", " ").alias("t")).collect():
        text[x["cls"]] = x["t"]
        at[x["cls"]].append((x["doc_id"], x["pos"]))
    root = {c: c for c in text}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    links = 0
    ids = sorted(text)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if find(a) != find(b) and distance(text[a], text[b]) <= int(0.1 * max(len(text[a]), len(text[b])) + 1e-9):
                root[find(a)] = find(b)
                links += 1
    groups, exp = defaultdict(list), defaultdict(set)
    for c in ids:
        groups[find(c)] += at[c]
    for g in groups.values():
        for d, p in g:
            if (d, p) != min(g):
                exp[d].add(p)
    got = {x["doc_id"]: {int(p) for p in x["removed_lines"].split(",")} for x in L.removal_report(docs).collect() if x["n_removed"]}
    assert links > 5 and got == dict(exp)
    new = {x["doc_id"]: x["text"] for x in L.deduplicated(docs).collect()}
    for d, t in rows:
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in exp[d])
        assert new.get(d, "") == kept


def test_line_edges(spark, edge, empty):
    rows = {r["doc_id"]: r for r in L.removal_report(edge).collect()}
    assert len(rows) == len({i for i, _ in EDGE}) and rows[11]["n_removed"] == 1 and rows[10]["n_removed"] == 0
    assert L.removal_report(empty).count() == 0
    assert L.deduplicated(edge.withColumn("cls", F.lit(1))).columns == ["doc_id", "text", "cls"]
    many = " ".join(f"w{i}" for i in range(9000))
    long = spark.createDataFrame([(1, many), (2, many), (3, many + " cd")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in L.removal_report(long).collect()} == {1: 0, 2: 1, 3: 1}


def test_line_dedup_edit_similarity(spark):
    """Groups are those of edit similarity alone, short lines included: one
    word of a line changed, or one character added to it."""
    r = random.Random(4)
    pool = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8))) for _ in range(n)) for n in (5, 7, 9, 12, 15, 20, 27, 40, 60)]
    rows = []
    for t in pool:
        rows.append(t)
        for _ in range(6):
            w = t.split()
            i = r.randrange(len(w))
            w[i] = w[i][:-2] + "zz" if r.random() < 0.5 else w[i] + "x"
            rows.append(" ".join(w))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    root = dict(rows)
    first = {}
    for i, a in rows:                               # rows come by doc_id: the first of a group stays
        near = {first[j] for j in first if distance(a, root[j]) <= int(0.1 * max(len(a), len(root[j])) + 1e-9)}
        first[i] = min(near, default=i)
        first = {j: first[i] if g in near else g for j, g in first.items()}
    got = {x["doc_id"] for x in L.removal_report(frame(spark, rows)).collect() if x["n_removed"]}
    exp = {i for i, g in first.items() if i != g}
    assert len(exp) > 40 and got == exp


def test_line_dedup_very_long_lines(spark):
    """Lines of more than 8,191 distinct words are compared as others are."""
    many = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, many), (2, many), (3, many + " cd"), (4, many.replace("w4000 ", "other ")), (5, many[::-1])]
    got = {x["doc_id"]: x["n_removed"] for x in L.removal_report(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_line_mixed_buckets(spark, monkeypatch):
    """Buckets of one component are not joined; the others are dealt into blocks."""
    monkeypatch.setattr(L, "BLOCK", 4)
    rows = [(1, i, 0, 21) for i in range(21)] + [(2, i, 30, 11) for i in range(30, 41)]
    members = spark.createDataFrame(rows, "key long, cls long, pivot long, size long")
    comp = spark.createDataFrame([(i, 0) for i in range(21)] + [(i, 30) for i in range(30, 35)], "id long, component long")
    got = L.mixed_buckets(members, comp).collect()
    assert {(x["key"], x["cls"]) for x in got} == {(2, i) for i in range(31, 41)}
    assert {x["blocks"] for x in got} == {3} and all(0 <= x["block"] < 3 for x in got)


def test_quality_tells_letters_of_all_scripts_apart(spark):
    """Every byte counts in the model: a Cyrillic text with its letters swapped is rejected, its twin kept."""
    from contactlake.llm import quality
    from contactlake.llm.packed import Packed
    words = ["ABC", "abc", "CBA", "123", "321", "абв", "ийк", "日本", "本日"]
    p = Packed([w.encode() for w in words])
    code = quality.ngram_codes(p)
    assert len(set(code[p.end - 1].tolist())) == len(words)
    r = random.Random(5)
    vocabulary = ["".join(r.choice("абвгде" if i % 2 else "стуклм") for i in range(r.randint(3, 9))) for _ in range(150)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(120)) for _ in range(120)]
    # letters whose second bytes are equal modulo 8
    swapped = texts[0].translate(str.maketrans("абвгде", "ийклмн"))
    docs = frame(spark, [*enumerate(texts), (500, swapped)]).withColumn("lang", F.lit("ru"))
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    assert got[500]["log_ppl"] > got[0]["log_ppl"] + 0.05
    assert got[0]["kept"] and not got[500]["kept"]


def test_members_outside_the_largest_component(spark):
    """Rows of a bucket grow with its size, not with its square, if one component holds most of it."""
    from contactlake.llm.components import dealt, outside_largest
    rows = [(1, i, 0) for i in range(1000)] + [(1, 1000 + i, 1000 + i) for i in range(3)] + [(2, i, 7) for i in range(50)]
    members = spark.createDataFrame([*rows, *((3, i, i) for i in range(20))], "key long, rep long, c long")
    minor, whole = dealt(outside_largest(members, 4).cache(), "rep")
    assert {r["rep"] for r in minor.where("key = 1").collect()} == {1000, 1001, 1002}
    assert whole.where("key = 1").count() == 1003 and whole.where("key = 2").count() == 0
    assert whole.where("key = 3").count() == 20 * 5
    x, y = minor.selectExpr("key", "block", "rep a", "c ca"), whole.selectExpr("key", "block", "rep b", "c cb", "main")
    met = x.join(y, ["key", "block"]).where("ca != cb and (cb = main or a > b)").where("key = 3").select(F.greatest("a", "b"), F.least("a", "b"))
    assert sorted(tuple(r) for r in met.collect()) == [(i, j) for i in range(20) for j in range(i)]


def test_line_dedup_in_parts(spark, monkeypatch):
    """Pairs compared two parts at a time are all pairs: each part has at most its share of the texts."""
    r = random.Random(8)
    texts = [(i, "".join(r.choice("ab") for _ in range(12))) for i in range(12)]
    texts += [(100 + i, t + "c") for i, t in texts]
    rows = spark.createDataFrame(texts, "cls long, text string")
    pairs = spark.createDataFrame([(100 + i, j) for i in range(12) for j in range(12)], "a long, b long")
    whole = {tuple(x) for x in L.confirmed(pairs, rows).collect()}
    assert whole == {(a, b) for a, s in texts if a > 99 for b, t in texts if b < 99 and distance(s, t) <= 1}
    monkeypatch.setattr(L, "FEW_TEXTS", 0)
    monkeypatch.setattr(L, "MOST_PARTS", 3)
    assert L._parts(10, 10) == 2 and L._parts(100, 10) == 3
    assert {tuple(x) for x in L.confirmed(pairs, rows).collect()} == whole


def test_line_kinds(spark):
    """Lines of a pair on both sides of a bound of the kinds have one in common, and
    scripts with and without spaces have minima."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("etaoinshrdlu ") for _ in range(n))
    plain = "".join(r.choice("etaoinshrdlu") for _ in range(400))
    script = "".join(chr(r.randint(0x4E00, 0x5200)) for _ in range(400))
    rows = [(0, "x" + text(L.LONG - 3).strip()), (1, "x" + text(L.LONG + 30)), (2, "x" + text(400)), (3, plain), (4, script)]
    classes = L.line_classes(frame(spark, rows))
    kinds = defaultdict(set)
    for x in classes.collect():
        kinds[x["doc"]].add(x["kind"])
        assert x["m0"] is not None
    assert kinds[0] == {0} and 0 in kinds[1] and 1 in kinds[2] and kinds[3] == {0} and kinds[4] == {1}
    assert classes.where("first").count() == 5 == len(kinds)


def test_suffix_reducers_get_equal_shares():
    """Least hashes are spread over all hashes, so equal ranges of them hold equal shares."""
    from contactlake.llm.chunks import slices
    from contactlake.llm.packed import Packed
    r = random.Random(3)
    p = Packed([bytes(r.choices(b"abcdefgh ", k=400_000))])
    size = np.diff(slices(np.sort(suffix_dedup.stretches(p)[0]), 100))
    assert size.max() < 1.5 * size.mean()


def test_suffix_frequent_string_is_sorted_in_parts(spark, monkeypatch):
    """Strings around one very common passage are cut into parts of bounded size, with the same result."""
    r = random.Random(9)
    passage = "the same thirty bytes or so, always"
    word = lambda: "".join(r.choices("abcdef", k=r.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(9)) + " " + passage + " " + " ".join(word() for _ in range(9))) for i in range(400)]
    rows += [(400 + i, rows[7 * i][1][10:] + word()) for i in range(40)]
    sorted_bytes, plain = [], suffix_dedup.window_docs
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "window_docs", lambda text, n, doc: sorted_bytes.append(len(text)) or plain(text, n, doc))
    texts = [t.encode() for _, t in rows]
    n = np.array([len(t) - suffix_dedup.LENGTH + 1 for t in texts])
    got = suffix_dedup.cut_docs(np.frombuffer(b"".join(texts), np.uint8), n, np.arange(len(rows)))
    first, at = {}, []
    for i, t in enumerate(texts):
        at += [t[k:k + suffix_dedup.LENGTH] for k in range(n[i])]
        for w in at[-n[i]:]:
            first.setdefault(w, i)
    assert got.tolist() == [first[w] for w in at]
    assert max(sorted_bytes) < sum(map(len, texts)) / 4
    table = {}
    for x in suffix_dedup.deduplicated(frame(spark, rows)).collect():
        table.setdefault(x["doc_id"], []).append((x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]))
    assert {k: sorted(v) for k, v in table.items()} == suffix(rows)


def test_quality_model_covers_all_bytes(spark):
    """After every context the probabilities of all 256 bytes add up to 1, in texts of any script."""
    from contactlake.llm import quality
    r = random.Random(8)
    words = ["".join(r.choice("aeioubcdfé абвгдежз日本語文字") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs = frame(spark, [(i, " ".join(r.choice(words) for _ in range(90))) for i in range(40)]).withColumn("lang", F.lit("x"))
    m = quality._models(quality.kneser_ney(quality.gram_counts(docs)))["=x"]
    seen = np.unique(m.arrays[quality.ORDER][0] >> np.uint32(8))[::40]
    for c in [*seen.tolist(), 0x010203]:
        assert abs((10 ** -m.cost((c << 8) + np.arange(256))).sum() - 1) < 1e-5

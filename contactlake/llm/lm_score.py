"""Op 2: language-model scores by deleted interpolation.

A token's probability after the one before it mixes maximum-likelihood
estimates: ``l2 c(v,w)/c(v) + l1 c(w)/N + l0/(V+1)``.  The weights depend on
the bucket of the context's frequency c(v) and are learned by
expectation-maximisation on the tokens of a tenth of the training documents
(``fits``), each with its own document's occurrences deleted from the counts,
so that it is held out.  Documents whose remainder is 0 are scored and teach
nothing.

Counting: per chunk of documents the distinct token and token-pair hashes go
to reducers by hash range with their training counts; the reducers answer with
the corpus counts (``chunks.py``), which are written to the shared folder once
and read for the weights (chunks of the fitting tenth only) and for the scores.  Tokens
are known by 64-bit hashes; two of n distinct ones share a hash with
probability below n**2 / 2**65.

Edge cases: null texts count as empty (one end token); a null doc_id counts as
held out and is returned as null; with no training tokens, estimates fall back
to the uniform share; with no fitting documents the three weights are equal;
repeated rows count each.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import chunks as C
from contactlake.llm import common
from contactlake.llm.packed import chain, pack_counts, pack_sorted, unpack_counts, unpack_sorted, word_bytes

#: Hashes of the end token and of the place before a text; no word's.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BUCKETS = 16
#: Larger chunks repeat fewer hashes; only 8 bytes a token are held of one.
CHUNK_BYTES = 4 << 20
ITERATIONS, ENOUGH = 20, 1e-4


#: Kinds of documents: training, held out, training whose tokens fit the weights.
TRAIN, HELD_OUT, FIT = 0, 1, 2


def kind(doc_id) -> int:
    by = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    return HELD_OUT if by % 10 == 0 else FIT if by // 10 % 10 == 0 else TRAIN


def tokens(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before, text) in order; every text ends with END."""
    hs, docs = [], []
    for first, p in chunk.pieces():
        start, end = p.runs(word_bytes())
        doc = p.text_of(start)
        ends = np.searchsorted(doc, np.arange(p.n), side="right")   # an END after the words of each text
        hs.append(np.insert(p.hashes(start, end, fold=True), ends, END))
        docs.append(np.insert(doc, ends, np.arange(p.n)).astype(np.int32) + np.int32(first))
    h, doc = np.concatenate(hs), np.concatenate(docs)
    before = np.concatenate([[START], h[:-1]])
    before[1:][doc[1:] != doc[:-1]] = START
    return h, before, doc


def _distinct(chunk: C.Chunk, h: np.ndarray, pair: np.ndarray):
    """Distinct tokens with START, and distinct pairs, with training counts."""
    train = chunk.number % C.SIDES != HELD_OUT
    u, un = np.unique(np.concatenate([h, np.full(chunk.packed.n, START)]), return_counts=True)
    b, bn = np.unique(pair, return_counts=True)
    return u, un * train, b, bn * train


def _requests(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for row in C.each_row(batches):
            chunk = C.Chunk(row)
            h, before, _ = tokens(chunk)
            u, un, b, bn = _distinct(chunk, h, chain(before, h))
            ue, be = C.slices(u, parts), C.slices(b, parts)
            out = [(q, chunk.number, pack_sorted(u[ue[q]:ue[q + 1]]), pack_counts(un[ue[q]:ue[q + 1]]),
                    pack_sorted(b[be[q]:be[q + 1]]), pack_counts(bn[be[q]:be[q + 1]]))
                   for q in range(parts) if ue[q] < ue[q + 1] or be[q] < be[q + 1]]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                names=["part", "chunk", "u", "un", "b", "bn"])

    return chunks.mapInArrow(run, "part int, chunk long, u binary, un binary, b binary, bn binary")


REPLY = "chunk long, part int, u binary, b binary, train_tokens long, vocabulary long"


def _replies(requests: DataFrame) -> DataFrame:
    """Corpus counts of each chunk's hashes; row -1 holds the part's number of
    training tokens and of distinct ones."""
    def corpus(blobs, counts):
        h = [unpack_sorted(x) for x in blobs]
        u, inv = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([unpack_counts(x) for x in counts]), minlength=len(u)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in h])])
        return u, n, [pack_counts(n[inv[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def run(table):
        import pyarrow as pa
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        u, n, ublobs = corpus(cols["u"], cols["un"])
        n = np.where(u == START, 0, n)
        _, _, bblobs = corpus(cols["b"], cols["bn"])
        part = cols["part"][0]
        k = len(ublobs)
        return pa.table({"chunk": pa.array([*cols["chunk"], -1], pa.int64()), "part": pa.array([part] * (k + 1), pa.int32()),
                         "u": pa.array([*ublobs, None], pa.binary()), "b": pa.array([*bblobs, None], pa.binary()),
                         "train_tokens": pa.array([None] * k + [int(n.sum())], pa.int64()),
                         "vocabulary": pa.array([None] * k + [int((n > 0).sum())], pa.int64())})

    return requests.groupBy("part").applyInArrow(run, REPLY)


def _looked_up(row: dict):
    """(chunk, text of each token, c(w), c(v), c(v,w), places of w, v and the
    pair among the chunk's distinct ones) of a chunk with replies."""
    chunk = C.Chunk(row)
    h, before, doc = tokens(chunk)
    pair = chain(before, h)
    u, _, b, _ = _distinct(chunk, h, pair)
    un = np.concatenate([unpack_counts(r["u"]) for r in row["replies"]])
    bn = np.concatenate([unpack_counts(r["b"]) for r in row["replies"]])
    at = np.searchsorted(u, h), np.searchsorted(u, before), np.searchsorted(b, pair)
    return chunk, doc, un[at[0]], un[at[1]], bn[at[2]], at


def _own(doc: np.ndarray, at: np.ndarray, sought: np.ndarray | None = None) -> np.ndarray:
    """How often each token's item ``sought`` (``at`` itself) is among the items
    ``at`` of its document."""
    width = int(at.max(initial=0)) + 1 if sought is None else int(max(at.max(initial=0), sought.max(initial=0))) + 1
    have, n = np.unique(doc.astype(np.int64) * width + at, return_counts=True)
    key = doc.astype(np.int64) * width + (at if sought is None else sought)
    place = np.minimum(np.searchsorted(have, key), len(have) - 1)
    return np.where(have[place] == key, n[place], 0)


def bucket(context: np.ndarray) -> np.ndarray:
    """Context frequency by powers of two; 0: never seen."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


def _deleted_counts(joined: DataFrame) -> DataFrame:
    """(bucket, cw, cv, cvw, n): how many tokens of the fitting documents have
    these counts in the training documents but their own."""
    def run(batches):
        import pyarrow as pa
        for row in C.each_row(batches):
            _, doc, cw, cv, cvw, (w, v, vw) = _looked_up(row)
            first = np.concatenate([[True], doc[1:] != doc[:-1]])       # its context is the text's start, once a document
            cw, cv, cvw = cw - _own(doc, w), cv - np.where(first, 1, _own(doc, w, v)), cvw - _own(doc, vw)
            by = np.lexsort((cvw, cv, cw))
            cw, cv, cvw = cw[by], cv[by], cvw[by]
            at = np.flatnonzero(np.concatenate([[True], (cw[1:] != cw[:-1]) | (cv[1:] != cv[:-1]) | (cvw[1:] != cvw[:-1])]))
            n = np.diff(np.append(at, len(cw)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket(cv[at]), cw[at], cv[at], cvw[at], n)],
                                             names=["bucket", "cw", "cv", "cvw", "n"])

    return (joined.mapInArrow(run, "bucket long, cw long, cv long, cvw long, n long")
            .groupBy("bucket", "cw", "cv", "cvw").agg(F.sum("n").alias("n")))


def learn_weights(counts: DataFrame, n_tokens: int, vocabulary: int) -> np.ndarray:
    """Weights (bucket, 3) of the pair, token and uniform estimates by
    expectation-maximisation; each step is one grouping, of which at most
    BUCKETS rows come to the driver."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    p2 = F.when(F.col("cv") > 0, F.col("cvw") / F.col("cv")).otherwise(0.0)
    p1 = F.col("cw") / F.lit(float(n_tokens)) if n_tokens else F.lit(0.0)
    p = [p2, p1, F.lit(1.0 / (vocabulary + 1))]
    for _ in range(ITERATIONS):
        part = [F.element_at(F.array(*map(F.lit, weights[:, i].tolist())), (F.col("bucket") + 1).cast("int")) * p[i] for i in range(3)]
        t = counts.select("bucket", "n", *(x.alias(f"p{i}") for i, x in enumerate(part)))
        all_ = F.col("p0") + F.col("p1") + F.col("p2")
        rows = t.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f"p{i}") / all_).alias(f"e{i}") for i in range(3)))
        new = weights.copy()
        for r in rows.collect():
            e = np.array([r["e0"], r["e1"], r["e2"]])
            new[r["bucket"]] = e / e.sum()
        moved = float(np.abs(new - weights).max())
        weights = new
        if moved < ENOUGH:
            break
    return weights


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(joined: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for row in C.each_row(batches):
            chunk, doc, cw, cv, cvw, _ = _looked_up(row)
            k = chunk.packed.n
            add = lambda x: np.bincount(doc, weights=x, minlength=k)  # noqa: E731, B023
            w = weights[bucket(cv)]
            p = (w[:, 0] * cvw / np.maximum(cv, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1))
            yield pa.RecordBatch.from_arrays(
                [chunk.id_column(), pa.array(np.full(k, chunk.number % C.SIDES == HELD_OUT)), pa.array(np.bincount(doc, minlength=k).astype(np.int64)),
                 pa.array(add(cw > 0).astype(np.int64)), pa.array(np.full(k, n, np.int64)),
                 pa.array(add(np.log10((cw + 0.1) / (n + 0.1 * (v + 1))))), pa.array(add(np.log10(p)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, SCORE)


def scores(docs: DataFrame) -> DataFrame:
    """Scores of every document, learned from those whose crc32 of the id
    leaves a remainder other than 0 by 10."""
    docs = common.documents_of(docs)
    spark = docs.sparkSession
    chunks = C.chunk_table(docs, side=kind, chunk_bytes=CHUNK_BYTES)
    replies = common.materialize(_replies(_requests(chunks, 2 * common.parallelism(spark))), "lm-counts")
    sums = replies.where("chunk = -1").agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n"),
                                           F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()
    joined = C.with_replies(chunks, replies.where("chunk >= 0").select("chunk", "part", "u", "b"))
    deleted = common.materialize(_deleted_counts(joined.where(F.col("chunk") % C.SIDES == FIT)), "lm-deleted")
    weights = learn_weights(deleted, sums["n"], sums["v"])
    return _scores(joined, weights, sums["n"], sums["v"])

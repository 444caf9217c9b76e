"""Op 1: secrets by rules and by two character Markov models.

Rules find assigned values, access keys and long hex strings.  Their values
are the labelled samples of *random* strings; identifiers and words outside
them are the samples of *ordinary* ones.  Over all documents, Spark counts the
character transitions of both classes (a table of fixed size).  A run of
identifier characters that no rule has covered is added as kind ``random`` if
the log-likelihood ratio of the two chains exceeds ``THRESHOLD`` in total and
``PER_CHAR`` on average.

Edge cases: null texts count as empty; a corpus without samples leaves both
chains uniform, so nothing is added; repeated rows are counted and scanned
each; whole texts are read whatever their length.  Positions are code points,
end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import common
from contactlake.llm.packed import Packed

BASE_KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE_KINDS, "random"))}
#: The rules and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Characters of identifiers; 0 is any other.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET) + 1
LEAST_RANDOM = 16
THRESHOLD, PER_CHAR = 16.0, 0.6
#: Share of the uniform chain in the model of random strings, pseudo-counts in both.
UNIFORM, PSEUDO = 0.3, 0.5


def _symbols() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(ALPHABET)] = np.arange(1, K)
    return t


def rule_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, secret value) of the rules, per kind leftmost and
    without overlap, sorted by start and then by kind."""
    out = [(m.start(), "assign", m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    out += [(m.start(), "access", m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]]
    out += [(m.start(), "hex", m.end(), m.group()) for m in HEX.finditer(text) if len(m.group()) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


def candidates(p: Packed) -> np.ndarray:
    """Which texts may hold a rule's match: key words, the access prefix, long
    runs of hex digits."""
    hit = np.zeros(p.n, bool)
    raw = p.buf.tobytes()
    for hay, needles in ((raw.lower(), KEYS), (raw, (b"AKIA",))):
        for needle in needles:
            at = hay.find(needle)
            while at >= 0:
                i = int(p.text_of(np.int64(at)))
                hit[i] = True
                at = hay.find(needle, int(p.end[i]))
    member = np.zeros(256, bool)
    member[list(b"0123456789abcdef")] = True
    start, end = p.runs(member)
    hit[p.text_of(start[end - start >= LEAST["hex"]])] = True
    return hit


def held_out(value: str) -> bool:
    """A tenth of the distinct samples is for measuring accuracy only."""
    return zlib.crc32(value.encode()) % 10 == 0


def _pairs(p: Packed) -> np.ndarray:
    """Code of the transition into each byte."""
    s = _symbols()[p.buf]
    return np.concatenate([[0], s[:-1]])[:len(s)] * K + s


def transition_counts(docs: DataFrame) -> DataFrame:
    """(random boolean, code, n) over all documents; held-out samples are left
    out of the random ones."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros((2, K * K), np.int64)
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                p = Packed([(t or "").encode() for t in texts])
                values, hit = [], candidates(p)
                if hit.any():                       # blank the rules' matches out of the ordinary text
                    plain = []
                    for i, t in enumerate(texts):
                        t = t or ""
                        if hit[i]:
                            spans = rule_spans(t)
                            values += [v.encode() for *_, v in spans if not held_out(v)]
                            kept, at = [], 0
                            for s, _, e, _ in spans:
                                if e > at:
                                    kept += [t[at:max(at, s)], " "]
                                    at = e
                            t = "".join(kept) + t[at:]
                        plain.append(t.encode())
                    p = Packed(plain)
                total[0] += np.bincount(_pairs(p), minlength=K * K)
                if values:
                    total[1] += np.bincount(_pairs(Packed(values)), minlength=K * K)
        label, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(bool)), pa.array(code.astype(np.int32)), pa.array(total[label, code])],
            names=["random", "code", "n"])

    return (docs.select("text").mapInArrow(run, "random boolean, code int, n long")
            .groupBy("random", "code").agg(F.sum("n").alias("n")))


def ratio_table(counts) -> np.ndarray:
    """Log-likelihood ratio of random against ordinary for each transition,
    from rows (random, code, n); transitions from and to other characters
    count as starts and ends."""
    c = np.full((2, K, K), 0.0)
    for random, code, n in counts:
        c[int(random), code // K, code % K] = n
    c[:, 0, 0] = 0
    if not c[1].any() or not c[0].any():
        return np.zeros(K * K)
    p = (c + PSEUDO) / (c + PSEUDO).sum(axis=2, keepdims=True)
    p[1] = (1 - UNIFORM) * p[1] + UNIFORM / K
    out = np.log(p[1]) - np.log(p[0])
    out[0, 0] = 0.0
    return out.ravel()


def train(docs: DataFrame) -> np.ndarray:
    """The ratio table; what comes to the driver has 2 * K * K rows at most."""
    return ratio_table(transition_counts(docs).toLocalIterator())


def ratio(table: np.ndarray, values: list[str]) -> np.ndarray:
    """Log-likelihood ratio of whole strings."""
    p = Packed([v.encode() for v in values])
    c = np.concatenate([[0.0], np.cumsum(table[_pairs(p)])])
    return c[p.end + 1] - c[p.start]


class Scanner:
    def __init__(self, table: np.ndarray):
        self.table = table

    def scan(self, texts: list[str]) -> list[list[tuple[int, str, int]]]:
        """(start, kind, end) per text, sorted by start and then by kind."""
        p = Packed([t.encode() for t in texts])
        out: list[list] = [[] for _ in texts]
        for i in np.flatnonzero(candidates(p)):
            out[i] = [(s, k, e) for s, k, e, _ in rule_spans(texts[i])]
        member = _symbols() > 0
        start, end = p.runs(member)
        long = end - start >= LEAST_RANDOM
        start, end = start[long], end[long]
        if len(start):
            c = np.concatenate([[0.0], np.cumsum(self.table[_pairs(p)])])
            score = c[end + 1] - c[start]
            good = (score >= THRESHOLD) & (score >= PER_CHAR * (end - start))
            for s, e in zip(start[good].tolist(), end[good].tolist(), strict=True):
                i = int(p.text_of(np.int64(s)))
                a = len(p.buf[p.start[i]:s].tobytes().decode())
                b = a + e - s
                if all(b <= x or y <= a for x, _, y in out[i]):
                    out[i].append((a, "random", b))
            for spans in out:
                spans.sort(key=lambda s: (s[0], ORDER[s[1]]))
        return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def span_digest(docs: DataFrame) -> DataFrame:
    """Trains on ``docs`` and returns counts, digest and list of the spans of
    each document."""
    docs = common.documents_of(docs)
    table = train(docs)

    def run(batches):
        import pyarrow as pa
        scanner = Scanner(table)
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                n = {k: [] for k in ORDER}
                sha, lists = [], []
                for spans in scanner.scan(batch.column(1).to_pylist()):
                    kinds = [k for _, k, _ in spans]
                    for k in ORDER:
                        n[k].append(kinds.count(k))
                    sha.append(hashlib.sha256(joined(s for s in spans if s[1] != "random").encode()).hexdigest())
                    lists.append(joined(spans))
                c = {k: pa.array(v, pa.int64()) for k, v in n.items()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(c[k] for k in BASE_KINDS), pa.array(sha, pa.string()), pa.array(lists, pa.string()),
                     c["random"]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.mapInArrow(run, DIGEST)

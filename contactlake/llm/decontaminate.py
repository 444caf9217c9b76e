"""Op 3: benchmark decontamination with a generalised suffix automaton.

The normalised items (lower-cased ASCII, words of letters, digits and
non-ASCII characters) form one suffix automaton over words.  A document's
words are streamed through it; state and longest matching length at a word
tell which windows (``window`` consecutive item words, or a whole shorter
item) end there and which items hold them.  Before that, word-pair hashes drop
the stretches that cannot hold a window: every pair of neighbours inside a
window is a pair of some item, so no occurrence is lost.

Items are read in blocks of ``BLOCK_BYTES`` of text (a block's automaton is
what a task holds); with more than one block, marks are carried from block to
block through a table.

Edge cases: null texts and texts without words have no words, no hits and are
not contaminated; null or wordless items have no window; repeated items and
rows count each by their own id; an empty benchmark marks nothing; other
columns pass through; columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.llm import common
from contactlake.llm.packed import Packed, chain, texts_of, word_bytes

WINDOW = 10
COVERAGE = 0.5
BLOCK_BYTES = 2 << 20
FILTER_BITS = 22


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        seqs = []
        for item, words in items:
            if words:
                self.shortest = min(self.shortest, len(words))
                seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
                seqs.append((item, seq))
                last = 0
                for w in seq:
                    last = self._extend(last, w)
        self.items: list[set] = [set() for _ in self.next]      # of each state: items that hold its strings
        own: list[list] = [[] for _ in self.next]               # short items that end in it: (length, item)
        for item, seq in seqs:
            state = 0
            for w in seq:
                state = self.next[state][w]
                up = state
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(seq) < window:
                own[state].append((len(seq), item))
        self.short = own
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.has_short = [bool(o) for o in own]
        for s in order:
            self.has_short[s] = self.has_short[s] or self.has_short[self.link[s]]

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def occurrences(self, words: list[bytes]):
        """(first, last, items) of each window occurrence in ``words``."""
        state = size = 0
        for i, word in enumerate(words):
            w = self.ids.get(word, -1)
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w not in self.next[state]:
                continue
            state, size = self.next[state][w], size + 1
            if size >= self.window:
                up = state
                while self.length[self.link[up]] >= self.window:
                    up = self.link[up]
                yield i - self.window + 1, i, self.items[up]
            if self.has_short[state]:
                up = state
                while up > 0:
                    for n, item in self.short[up]:
                        if n <= size:
                            yield i - n + 1, i, {item}
                    up = self.link[up]


def words_of(p: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = p.runs(word_bytes(letters_only=True))
    return start, end, p.text_of(start)


class Marker:
    """Automaton of a block of items, with the word-pair filter before it."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        p = Packed([(t or "").encode() for _, t in rows])
        start, end, item = words_of(p)
        low = p.buf.tobytes().lower()
        words: list[list[bytes]] = [[] for _ in rows]
        for s, e, i in zip(start.tolist(), end.tolist(), item.tolist(), strict=True):
            words[i].append(low[s:e])
        self.automaton = Automaton([(r[0], w) for r, w in zip(rows, words, strict=True)], window)
        h = p.hashes(start, end, fold=True)
        self.word_filter, self.pair_filter = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool)
        self.word_filter[self._slot(h)] = True
        same = item[1:] == item[:-1]
        self.pair_filter[self._slot(chain(h[:-1], h[1:])[same])] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def mark(self, p: Packed, start, end, doc, hit: np.ndarray, items: list[set]) -> None:
        """Set ``hit`` of each word inside an occurrence; add to ``items``."""
        if not len(start) or len(self.automaton.next) == 1:
            return
        h = p.hashes(start, end, fold=True)
        good = self.word_filter[self._slot(h)]
        joined = self.pair_filter[self._slot(chain(h[:-1], h[1:]))] & (doc[1:] == doc[:-1]) & good[1:] & good[:-1]
        cut = np.concatenate([[True], ~joined])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(start)]])
        long = (last - first >= self.automaton.shortest) & good[first]
        low = None
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            if low is None:
                low = p.buf.tobytes().lower()
            words = [low[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            found = items[doc[a]]
            for i, j, held in self.automaton.occurrences(words):
                hit[a + i:a + j + 1] = True
                found |= held


#: Columns that the modes add, in order.
DIGEST = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]


def _cleaned(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False,
                  text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items_sha256 and contaminated.
    With ``clean``, each maximal run of hit words (from its first to its last
    byte) is cut out of the text as well."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    added = [c for c, _ in DIGEST]
    kept = [f for f in docs.schema.fields if f.name not in {*added, "_hit", "_items"}]
    out = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    for b in range(blocks):
        rows = [tuple(r) for r in (bench if blocks == 1 else bench.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()]    # at most about BLOCK_BYTES
        rows = [(r[0] or "", r[1]) for r in rows]
        first, last = b == 0, b == blocks - 1
        extra = ([T.StructField(c, T._parse_datatype_string(t)) for c, t in DIGEST] if last else
                 [T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
        out = _pass(out, kept, rows, window, first, last, clean and last, text_col, T.StructType([*kept, *extra]))
        if not last:
            out = common.materialize(out, "benchmark-block")
    return out


def _pass(docs, kept, rows, window, first, last, clean, text_col, schema):
    def run(batches):
        import pyarrow as pa
        marker = Marker(rows, window)
        for whole in batches:
            for batch in common.by_bytes(whole, text_col):
                get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
                texts = texts_of(batch, text_col)
                p = Packed(texts)
                start, end, doc = words_of(p)
                n = np.bincount(doc, minlength=p.n) if p.n else np.zeros(0, np.int64)
                edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                hit = np.zeros(len(start), bool)
                items: list[set] = [set() for _ in texts]
                if not first:
                    for i, (bits, held) in enumerate(zip(get("_hit").to_pylist(), get("_items").to_pylist(), strict=True)):
                        hit[edges[i]:edges[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:n[i]].astype(bool)
                        items[i] |= set(held)
                marker.mark(p, start, end, doc, hit, items)
                cols = {f.name: get(f.name) for f in kept}
                if not last:
                    cols["_hit"] = pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                    cols["_items"] = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
                else:
                    hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[edges])
                    if clean:
                        new = []
                        for i, t in enumerate(texts):
                            if hits[i]:
                                a, b = edges[i], edges[i + 1]
                                step = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                                s = start[a:b][np.flatnonzero(step == 1)] - p.start[i]
                                e = end[a:b][np.flatnonzero(step == -1) - 1] - p.start[i]
                                new.append(_cleaned(t, list(zip(s.tolist(), e.tolist(), strict=True))))
                            else:
                                new.append(t.decode())
                        cols[text_col] = pa.array(new, pa.string())
                    cols |= {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                             "n_items": pa.array([len(s) for s in items], pa.int64()),
                             "items_sha256": pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items], pa.string()),
                             "contaminated": pa.array(hits > 0, pa.bool_())}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with occurrences of benchmark windows cut out; documents of
    whose words more than ``coverage`` are hit go altogether.  Same columns;
    ``n_chars``, if there is one, follows the text."""
    inner, now = common.sheltered(docs, "text")
    out = contamination(inner, benchmark, window, clean=True)
    out = out.where(F.col("n_hit") <= F.lit(coverage) * F.col("n_words"))
    if "n_chars" in now:
        size = F.when(F.col("contaminated"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(now["n_chars"]))
        out = out.withColumn(now["n_chars"], size)
    return common.restored(out, now)

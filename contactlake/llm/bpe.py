"""Op 8: byte-level BPE encoding and decoding by a trie of distinct words.

A BPE encoding is fixed by the last token of every prefix: the encoding of
``w[:d]`` is that of ``w[:d-len(t)]`` followed by its last token ``t``, and two
tokens may stand side by side exactly if BPE leaves the two of them apart when
it encodes their concatenation.  So the distinct words of a batch go into a
trie, a depth-first walk carries the last token of every node's prefix, and a
prefix that many words share is worked out once.  A word's ids are read by
stepping back from its node.

Works on any table without a shuffle.  A trie holds at most ``TRIE_WORDS``
words and the table of known words at most ``KNOWN_WORDS`` per task; both only
bound memory, a forgotten word is encoded again.

Edge cases: null texts count as empty; empty texts have no tokens; repeated
rows are encoded each; other columns pass through ``encode``; invalid UTF-8
cannot occur in Spark strings.  The special token's own string in a text
becomes its id, as in the library.
"""

from __future__ import annotations

import hashlib
import gc
import json
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactlake.llm import common

TRIE_WORDS = 20_000
KNOWN_WORDS = 400_000
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beside white space, or at an end of the text.
ODD_SPACES = re.compile(r"\s\s|^\s|\s\Z").search


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as a visible character: printable
    Latin-1 characters stand for themselves, the others for 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Vocabulary, merges and the table of known words of one task."""

    def __init__(self, path: str, specials: bool = True):
        import regex
        gc.disable()            # tries are trees: no cycles to look for, and looking costs a third of the time
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        # merges between ids, and for each token the merge that makes it
        self.rank, self.born, self.halves = {}, {}, {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = (raw[p] for p in (m.split(" ") if isinstance(m, str) else m))
            left, right, made = self.id_of[x], self.id_of[y], self.id_of[x + y]
            self.rank[left, right] = r
            if made not in self.born:
                self.born[made], self.halves[made] = r, (left, right)
        self.longest = max(map(len, self.id_of))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(PATTERN).findall
        self.scan = regex.compile(PATTERN).finditer
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.apart = lru_cache(1 << 19)(self._apart)
        self.likely: dict[tuple[int, int], int] = {}

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: undo the merges inside both,
        latest first, and look for a merge across that would have come earlier
        (of equal merges, the one further left comes first)."""
        before = len(self.rank)
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = self.born.get(left, -1), self.born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 1, self.halves[right][0]

    def learn(self, words) -> None:
        """Encode ``words`` that are not known, trie by trie."""
        new = sorted({w for w in words if w not in self.known})
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = sorted(set(words))
        for i in range(0, len(new), TRIE_WORDS):
            self._walk(new[i:i + TRIE_WORDS])

    def _walk(self, words: list[str]) -> None:
        root: dict = {}
        for w in words:
            node = root
            for b in w.encode():
                nxt = node.get(b)
                if nxt is None:
                    nxt = node[b] = {}
                node = nxt
            node[-1] = w
        id_of, apart, size_of, likely, longest = self.id_of, self.apart, self.size_of, self.likely, self.longest
        known = self.known
        last: list[int] = [-1]              # last[d]: last token of the path's first d bytes
        path = bytearray()
        stack = [(0, -1, root)]
        while stack:
            depth, byte, node = stack.pop()
            if depth:
                del path[depth - 1:], last[depth:]
                path.append(byte)
                # the token that followed such a state before, if it holds here
                token = likely.get((last[-1], byte), -1)
                if token < 0 or (size := size_of[token]) > depth or size < depth and not apart(last[depth - size], token):
                    here = bytes(path[-longest:])
                    for size in range(len(here), 0, -1):
                        token = id_of.get(here[-size:], -1)
                        if token >= 0 and (size == depth or apart(last[depth - size], token)):
                            break
                    # only such as depend on the last token and the byte alone
                    if last[-1] >= 0 and size <= size_of[last[-1]] + 1:
                        likely[last[-1], byte] = token
                last.append(token)
            for b, child in node.items():
                if b == -1:
                    ids, d = [], depth
                    while d:
                        t = last[d]
                        ids.append(t)
                        d -= size_of[t]
                    ids.reverse()
                    known[child] = tuple(ids)
                else:
                    stack.append((depth + 1, b, child))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings are pieces of their own."""
        if self.at_special is None or not any(s in text for s in self.specials):
            return self.split(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.specials else self.split(part)
        return out

    def chunked(self, text: str) -> list[str]:
        """Parts that can be cut into pre-tokens one by one.  A lone space
        between two other characters that are no white space always starts a
        pre-token; texts with other white space next to a space, or with a
        special string, are one part."""
        if ODD_SPACES(text) or any(s in text for s in self.specials):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def encode_chunks(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """Per text the ids of its parts.  Parts seen before are looked up."""
        cut = [self.chunked(t) for t in texts]
        new = {c for cs in cut for c in cs if c not in self.chunks}
        if len(self.chunks) + len(new) > KNOWN_WORDS:
            self.chunks.clear()
            new = {c for cs in cut for c in cs}
        pieces = {c: self.pieces(c) for c in new}
        self.learn({w for ws in pieces.values() for w in ws if w not in self.specials})
        known, specials = self.known, self.specials
        for c, ws in pieces.items():
            self.chunks[c] = known[ws[0]] if len(ws) == 1 and ws[0] in known else tuple(
                i for w in ws for i in ((specials[w],) if w in specials else known[w]))
        return [list(map(self.chunks.__getitem__, cs)) for cs in cut]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(parts)) for parts in self.encode_chunks(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids",
           specials: bool = True) -> DataFrame:
    """``docs`` with the array of token ids of each text in ``ids_col`` (a
    column of that name is replaced)."""
    path = path or tokenizer_path()
    kept = [f for f in docs.schema.fields if f.name != ids_col]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa
        bpe = Bpe(path, specials)
        for whole in batches:
            for batch in common.by_bytes(whole, text_col):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                ids = pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, ids], names=[f.name for f in kept] + [ids_col])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the text of the ids in ``text_col`` (a column of that name
    is replaced).  Null ids give an empty text."""
    path = path or tokenizer_path()
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches):
        import pyarrow as pa
        bpe = Bpe(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            text = pa.array([bpe.decode(x or []) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, text], names=[f.name for f in kept] + [text_col])

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without the text, plus n_tokens, ids and round_trip (whether
    decoding the ids gives the text; null texts count as empty)."""
    path = path or tokenizer_path()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
             T.StructField("round_trip", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {text_col, *(a.name for a in added)}]
    schema = T.StructType([*kept, *added])

    def run(batches):
        import pyarrow as pa
        bpe = Bpe(path)
        for whole in batches:
            for batch in common.by_bytes(whole, text_col, common.SMALL_BATCH_BYTES):
                get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
                texts = [t or "" for t in get(text_col).to_pylist()]
                ids = bpe.encode_batch(texts)
                same = [bpe.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(get(f.name) for f in kept), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(same, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text
    that decoding the ids gives: ``encode`` and ``decode`` in one pass, as the
    ids of a whole corpus need not leave the task."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        bpe = Bpe(path)
        sha = hashlib.sha256
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                n, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents_of(docs).mapInArrow(run, DIGEST)

"""Op 11: packing of documents into training sequences, shortest pack first.

Documents are tokenised once, get an end id and are cut into full pieces of
``size`` ids and one rest.  Only the histogram of piece lengths (``size``
entries at most) reaches the driver.  Shortest-pack-first places the lengths
longest first: each goes into the pack with the most room that still holds it,
a new pack is opened where none does, and packs with the same content are one
pattern with a count.  A pattern's slots are stated as runs of ranks among the
pieces of a length, so the patterns (at most two new ones a length, each with
fewer than 2 * sqrt(size) runs) are a small table whatever the corpus, and each
piece finds its sequence and offset by its rank alone.

Ranks are numbered without a sort: the tokenising task numbers the pieces of
each length, the counts per task are summed up per length, and a piece joins
its task's start by (task, length).  The join keys are as many as the tasks
and lengths, so no key is hot.

The ids are those of the ``tokenizers`` library.  They come from ``tiktoken``
over the same vocabulary, which takes a quarter of the time (tests compare the
two over the vocabulary, code points and random strings); stretches of over
``2 * SPAN_CHARS`` without a lone space go through ``tokenizers`` itself.

Edge cases: null texts count as empty and have the end id only; a null doc_id
stays null; repeated rows are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm import bpe, common

SIZE = 1024
END_ID = 0
SPAN_CHARS = 1 << 16
#: A space that starts a pre-token whatever stands around it.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them, as arrays."""

    def __init__(self, path: str):
        import json
        import os

        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.load(open(path, encoding="utf-8"))
        letters = bpe.byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.quick = tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self.names = set(self.specials)
        self.path, self.slow = path, None

    def exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def spans(self, text: str):
        """Parts of ``SPAN_CHARS`` at least that start at lone spaces; BPE
        never crosses these."""
        at = 0
        while len(text) - at > SPAN_CHARS:
            m = LONE_SPACE.search(text, at + SPAN_CHARS)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def part(self, text: str) -> np.ndarray:
        if len(text) > 2 * SPAN_CHARS:
            return self.exact(text)
        return self.quick.encode_to_numpy(text, allowed_special=self.names)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= SPAN_CHARS:
            return self.part(text)
        return np.concatenate([self.part(s) for s in self.spans(text)])


def piece_table(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None, ids: bool = False) -> DataFrame:
    """The pieces of every document, written to the shared folder: ``nth`` is
    the piece's number among those of its length in the task ``part``.  With
    ``ids`` the token ids come along as an array."""
    path = path or bpe.tokenizer_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), [0] * (size + 1)
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                rows, cut = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    doc = np.concatenate([encoder.ids(text), end]).astype("<u4", copy=False)
                    for start in range(0, len(doc), size):
                        piece = doc[start:start + size]
                        rows.append((i, start, len(piece), zlib.crc32(piece), len(doc), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                        if ids:
                            cut.append(piece)
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                if ids:
                    cols.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return common.materialize(common.documents_of(docs).mapInArrow(run, PIECES + (", ids array<int>" if ids else "")), "pieces")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, runs (length, how many) of each) for a histogram of
    lengths up to ``size``."""
    by_room: list[list] = [[] for _ in range(size + 1)]

    def put(packs, runs, room, length, times):
        if runs and runs[-1][0] == length:
            runs = [*runs[:-1], (length, runs[-1][1] + times)]
        else:
            runs = [*runs, (length, times)]
        by_room[room - length * times].append((packs, runs))

    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:           # no pack has room: new ones, each filled with this length
                times = size // length
                if left >= times:
                    put(left // times, [], size, length, times)
                if left % times:
                    put(1, [], size, length, left % times)
                break
            packs, runs = by_room[room].pop()
            used = min(packs, left)
            if packs > used:
                by_room[room].append((packs - used, runs))
            put(used, runs, room, length, 1)
            left -= used
    return [p for group in by_room for p in group]


def slot_table(patterns, size: int = SIZE) -> dict[str, np.ndarray]:
    """Runs of ranks, sorted by (length, first rank): the piece of rank r in
    such a run lies in sequence ``sequence + (r - rank) // times`` at
    ``offset + (r - rank) % times * length``."""
    taken, rows, sequence = [0] * (size + 1), [], 0
    for packs, runs in patterns:
        offset = 0
        for length, times in runs:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += packs * times
            offset += length * times
        sequence += packs
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "times", "sequence", "offset"), cols, strict=True))


def assigned(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with length, part, nth) plus sequence_id and offset."""
    counts = common.materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, size), size)
    edge = [int(np.searchsorted(slots["length"], k)) for k in range(size + 2)]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = [c for c in pieces.columns if c not in ("part", "nth")]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            length, rank = np.asarray(get("length")), np.asarray(get("before")) + np.asarray(get("nth"))
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                rows = length == k
                at[rows] = edge[k] + np.searchsorted(slots["rank"][edge[k]:edge[k + 1]], rank[rows], side="right") - 1
            step, times = rank - slots["rank"][at], slots["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in names), pa.array(slots["sequence"][at] + step // times),
                 pa.array(slots["offset"][at] + step % times * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)
    return pieces.join(starts, ["part", "length"]).mapInArrow(run, schema + ", sequence_id long, offset long")


def packed_pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return assigned(piece_table(docs, size, end_id, path), size)


def packed_sequences(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The training rows: sequence_id, ids (at most ``size``, unpadded) and
    ``doc_starts``, the offsets at which pieces start (attention stops there)."""
    pieces = assigned(piece_table(docs, size, end_id, path, ids=True), size)
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id").agg(rows.alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("doc_starts")))

"""Documents in chunks, and lookups of hashes across all chunks.

A chunk holds some megabytes of documents as one compressed value.  An
operator that needs, for every distinct hash of a chunk, a statistic over the
whole corpus sends the chunk's sorted distinct hashes to reducers by hash
range, and gets the answers back in the same order: so a hash crosses the
network once per chunk that holds it, however often it occurs there, and hot
values never meet row by row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import common
from contactlake.llm.packed import Packed, bounds

PIECE_BYTES = 1 << 20
SIDES = 4
CHUNK = "chunk long, payload binary, sizes binary, ids binary, known binary"


def chunk_table(docs: DataFrame, side=None, chunk_bytes: int = common.BATCH_BYTES) -> DataFrame:
    """(chunk, payload, sizes, ids, known) from (doc_id long, text string),
    written to the shared folder.  ``side(doc_id)`` below ``SIDES`` keeps kinds
    of documents in chunks of their own (it is the chunk number's remainder by
    ``SIDES``).  ``known`` marks the ids that are not null."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        squeeze = zstandard.ZstdCompressor(level=3).compress
        base, count = TaskContext.get().partitionId() << 32, 0
        open_: list[list] = [[] for _ in range(SIDES)]
        held = [0] * SIDES

        def close(k):
            nonlocal count
            texts = [t for _, t in open_[k]]
            ids = [i for i, _ in open_[k]]
            sizes = np.array([len(t) for t in texts], "<i4")
            row = {"chunk": base + SIDES * count + k, "payload": squeeze(b"\n".join(texts) + b"\n"), "sizes": sizes.tobytes(),
                   "ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
                   "known": np.array([i is not None for i in ids], np.uint8).tobytes()}
            count += 1
            open_[k], held[k] = [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("chunk", pa.int64()), *((c, pa.binary()) for c in ("payload", "sizes", "ids", "known"))]))

        for whole in batches:
            for batch in common.by_bytes(whole, "text", PIECE_BYTES):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    k = side(i) if side else 0
                    if held[k] and held[k] + len(t) > chunk_bytes:
                        yield close(k)
                    open_[k].append((i, t))
                    held[k] += len(t) + 1
        for k in range(SIDES):
            if open_[k]:
                yield close(k)

    return common.materialize(docs.mapInArrow(run, CHUNK), "chunks")


class Chunk:
    def __init__(self, row: dict):
        import zstandard
        self.number = row["chunk"]
        sizes = np.frombuffer(row["sizes"], "<i4")
        raw = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=int(sizes.astype(np.int64).sum()) + len(sizes) + 1)
        self.packed = Packed.unpacked(raw, sizes)
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)

    def pieces(self):
        """(first text, Packed) of consecutive texts of about PIECE_BYTES, so
        that the arrays made from a piece stay small whatever the chunk's size."""
        p = self.packed
        at = 0
        while at < p.n:
            stop = max(at + 1, int(np.searchsorted(p.end, p.start[at] + PIECE_BYTES)))
            yield at, p.part(at, stop)
            at = stop

    def id_column(self):
        import pyarrow as pa
        return pa.array(self.ids, pa.int64(), mask=~self.known)


def each_row(batches):
    """The rows of Arrow batches as dicts, one at a time: a row holds megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def slices(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Edges of the parts' ranges in an array of sorted hashes."""
    return np.concatenate([[0], np.searchsorted(sorted_hashes, bounds(parts)), [len(sorted_hashes)]]).astype(np.int64)


def with_replies(chunks: DataFrame, replies: DataFrame, name: str = "replies") -> DataFrame:
    """Each chunk's row with its replies as an array sorted by reducer; as many
    entries as there are reducers."""
    cols = [c for c in replies.columns if c != "chunk"]
    grouped = replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    return chunks.join(grouped, "chunk", "left")

"""Op 10: token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf holds the
pre-tokens of one place in the text, every node the sum of characters and of
tokens below it.  An edit (start, stop, replacement; in characters of the text
as it stands then) finds its leaves by descending the character sums, cuts the
touched region anew from a boundary that the edit cannot have moved up to the
next old boundary past the edit, encodes only that region, and updates the
sums on the paths to the root.

The split pattern looks at most two characters past the end of a pre-token, so
cutting may restart at the first pre-token that ends less than three
characters before the edit; from an old boundary past the edit on, the cut is
what it was.  Special strings are ordinary text here: an edit may make or
break one.

Edge cases: null text is empty; null, empty or absent edit lists change
nothing; positions are clipped to the text; edits apply in list order; repeated
rows are counted each; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.llm import bpe as B
from contactlake.llm import common

LOOK_AHEAD = 3
EDITS = "array<struct<start:int,stop:int,text:string>>"


class PretokenTree:
    """Segment tree over pre-tokens; ``n_tokens`` is the root's sum."""

    def __init__(self, pieces: list[str], counter, split):
        self.counter, self.split = counter, split
        self.leaves: list[list[str]] = [[p] for p in pieces] or [[]]
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        counts = counter(pieces)
        self.chars[self.size:self.size + len(pieces)] = map(len, pieces)
        self.tokens[self.size:self.size + len(pieces)] = counts
        for sums in (self.chars, self.tokens):
            for i in range(self.size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
        self.encoded = 0            # pre-tokens encoded because of edits

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def locate(self, position: int) -> tuple[int, int]:
        """(leaf, position of its first character) of the leaf that holds a
        character; the last leaf with text for a position at the end."""
        position = min(position, self.chars[1] - 1)
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        self.leaves[leaf] = pieces
        node = leaf + self.size
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, stop: int, text: str) -> None:
        total = self.chars[1]
        start = max(0, min(start, total))
        stop = max(start, min(stop, total))
        if not total:
            pieces = self.split(text)
            self.encoded += len(pieces)
            self._set(0, pieces, sum(self.counter(pieces)))
            return
        first, at = self.locate(max(0, start - LOOK_AHEAD))
        last, last_at = self.locate(stop)
        while True:
            old = [p for leaf in self.leaves[first:last + 1] for p in leaf]
            region = "".join(old)
            new = region[:start - at] + text + region[stop - at:]
            # further text that the last pre-tokens may reach into
            tail_leaf, tail = last + 1, []
            while tail_leaf < len(self.leaves) and sum(map(len, tail)) < LOOK_AHEAD:
                tail += self.leaves[tail_leaf]
                tail_leaf += 1
            pieces = self.split(new + "".join(tail))
            # boundaries of old pre-tokens past the edit, as positions in the new text
            ends, position = set(), 0
            for p in [*old, *tail]:
                if position >= stop - at:
                    ends.add(position + len(text) - (stop - start))
                position += len(p)
            at_end = tail_leaf >= len(self.leaves)
            position, kept = 0, None
            for i, p in enumerate(pieces):
                if position == len(new) and position in ends:
                    kept = pieces[:i]
                    break
                position += len(p)
            if kept is None and at_end:
                kept, last = pieces, len(self.leaves) - 1
            if kept is not None:
                break
            last = tail_leaf            # the cut has not met an old boundary yet: go on further
        self.encoded += len(kept)
        self._set(first, kept, sum(self.counter(kept)))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, [], 0)

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def edited_counts(docs: DataFrame, edits_col: str = "edits", text_col: str = "text", path: str | None = None,
                  keep_text: bool = False) -> DataFrame:
    """``docs`` without the edits and the text (unless ``keep_text``: then with
    the text after the edits), plus n_tokens_before, n_tokens, n_edits and n_reencoded (pre-tokens encoded anew because of edits)."""
    path = path or B.tokenizer_path()
    added = ["n_tokens_before", "n_tokens", "n_edits", "n_reencoded"]
    kept = [f for f in docs.schema.fields if f.name not in {edits_col, text_col, *added}]
    fields = [*kept, *([T.StructField(text_col, T.StringType())] if keep_text else []),
              *(T.StructField(c, T.LongType()) for c in added)]
    schema = T.StructType(fields)

    def run(batches):
        import pyarrow as pa
        bpe = B.Bpe(path, specials=False)

        def counter(pieces):
            known = bpe.known
            if any(p not in known for p in pieces):
                bpe.learn(pieces)
                known = bpe.known
            return [len(known[p]) for p in pieces]

        for whole in batches:
            for batch in common.by_bytes(whole, text_col):
                get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
                texts, edits = get(text_col).to_pylist(), get(edits_col).to_pylist()
                chunks = bpe.encode_chunks([t or "" for t in texts])
                out, after = {c: [] for c in added}, []
                for text, parts, todo in zip(texts, chunks, edits, strict=True):
                    before = now = sum(map(len, parts))
                    encoded = n = 0
                    if todo:
                        pieces = bpe.split(text or "")
                        tree = PretokenTree(pieces, counter, bpe.split)
                        for e in todo:
                            if e is not None and e["start"] is not None and e["stop"] is not None:
                                tree.edit(e["start"], e["stop"], e["text"] or "")
                                n += 1
                        now, encoded = tree.n_tokens, tree.encoded
                        text = tree.text() if keep_text else None
                    if keep_text:
                        after.append(text or "")
                    for c, v in zip(added, (before, now, n, encoded), strict=True):
                        out[c].append(v)
                cols = [get(f.name) for f in kept] + ([pa.array(after, pa.string())] if keep_text else [])
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out[c], pa.int64()) for c in added],
                                                 names=[f.name for f in fields])

    return docs.mapInArrow(run, schema)


#: What the query edits out: e-mail addresses and runs of 12 digits or more.
MASKS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9](?:[ -]?[0-9]){11,}"


def mask_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with an ``edits`` column that replaces each match of ``MASKS``
    by ``[MASK]``, last match first so that earlier positions stay right."""
    found: Column = F.expr(f"regexp_extract_all({text_col}, r'{MASKS}', 0)")
    rest: Column = F.expr(f"split({text_col}, r'{MASKS}', -1)")
    # start of match i: characters in the i+1 gaps and i matches before it
    m, r = common.unused("matches"), common.unused("rest")
    starts = F.expr(f"""transform(sequence(size({m}) - 1, 0, -1), i -> named_struct(
        'start', cast(aggregate(slice({r}, 1, i + 1), 0L, (a, x) -> a + length(x))
                 + aggregate(slice({m}, 1, i), 0L, (a, x) -> a + length(x)) as int),
        'len', length(element_at({m}, i + 1))))""")
    none = F.expr(f"cast(array() as {EDITS})")
    return (docs.withColumn(m, F.when(F.col(text_col).rlike("@|[0-9]{2}|[0-9][ -][0-9]"), found))
            .withColumn(r, F.when(F.size(m) > 0, rest))
            .withColumn("edits", F.when(F.size(m) > 0, F.transform(starts, lambda s: F.struct(
                s["start"].alias("start"), (s["start"] + s["len"]).alias("stop"),
                F.lit("[MASK]").alias("text")))).otherwise(none))
            .drop(m, r))

"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The leaves are runs of about ``LEAF`` pre-tokens with their characters and token
counts; inner nodes hold sums. A table of trees (``build``) keeps the leaves of every
document, so later edits never encode an untouched part again. An edit replaces
characters [at, at + cut) by a text. Only the leaves that it touches are pre-tokenized
again, together with boundary context: earlier leaves until the first new pre-token
border is sure to be an old one, later leaves until the new borders fall on an old leaf
border again. The new pre-tokens are dealt over as many leaves as before while each
holds at most ``2 * LEAF``; then only the sums above these leaves change. Leaves have free
places between them, so that more leaves go into the smallest subtree with room,
whose leaves are spread again; the tree doubles when it is full.

Nulls: a null text is empty (0 tokens); an edit beyond the end is clipped; a
null edit changes nothing. Very long texts: the tree grows with the text of one
document, a document at a time. Each row is counted by itself, so repeated rows
and null ids give one result each; edits of a doc_id apply to each row that has it,
and rows with a null doc_id have none. An empty table gives an empty result. Columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common, tokens

LEAF = 64
#: Untouched pre-tokens that a kept border needs behind it.
CONTEXT = 4
#: How full a subtree may be before more leaves go to a larger one.
FULL = 0.75
#: Rows that are held before they are given on.
ROWS = 500
LEAVES = "array<struct<text:string,tokens:int,pieces:int>>"
TREES = f"doc_id bigint, leaves {LEAVES}, n_chars bigint, n_tokens bigint, n_pieces bigint"
EDITS = "array<struct<at:bigint,cut:bigint,new:string>>"
SCHEMA = f"doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, n_pieces bigint, n_recoded bigint, leaves {LEAVES}"
LEAF_TYPE = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32()), ("pieces", pa.int32())]))


class TokenTree:
    """Pre-token leaves (text, tokens, pieces) of one text with sums of characters and tokens."""

    def __init__(self, encoder: tokens.Encoder, text: str = "", leaves: list[tuple[str, int, int]] | None = None):
        self.encoder, self.recoded, self.touched = encoder, 0, 0
        if leaves is None:
            leaves = self._leaves(encoder.pieces(text))
        self.size = 2
        while FULL * self.size < len(leaves):
            self.size *= 2
        self._lay(leaves)

    def _leaves(self, pieces: list[str], count: int | None = None) -> list[tuple[str, int, int]]:
        """The pieces dealt evenly over ``count`` leaves, or over as many as hold LEAF each."""
        count = count or -(-len(pieces) // LEAF)
        tokens_of, out = self.encoder.lengths(pieces), []
        for i in range(count):
            a, b = i * len(pieces) // count, (i + 1) * len(pieces) // count
            if b > a:
                out.append(("".join(pieces[a:b]), sum(tokens_of[a:b]), b - a))
        return out

    def _lay(self, leaves: list[tuple[str, int, int]]) -> None:
        """All leaves anew, evenly over all places."""
        self.leaf: list[tuple[str, int, int] | None] = [None] * self.size
        self.chars, self.count = [0] * (2 * self.size), [0] * (2 * self.size)
        self._spread(0, self.size, leaves)

    def _spread(self, first: int, width: int, leaves: list[tuple[str, int, int]]) -> None:
        """The leaves evenly over the places of a subtree, and the sums in and above it."""
        places = {i * width // len(leaves): x for i, x in enumerate(leaves)} if leaves else {}
        for k in range(width):
            x = self.leaf[first + k] = places.get(k)
            self.chars[self.size + first + k], self.count[self.size + first + k] = (len(x[0]), x[1]) if x else (0, 0)
        lo, hi = (self.size + first) // 2, (self.size + first + width - 1) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._pull(i)
            lo, hi = lo // 2, hi // 2

    def _pull(self, i: int) -> None:
        self.touched += 1
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.count[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def leaves(self) -> list[tuple[str, int, int]]:
        return [x for x in self.leaf if x]

    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The place of the leaf that holds character ``at`` (the last one for the end) and the characters before it."""
        i, before, at = 1, 0, min(at, self.n_chars - 1)
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _next(self, k: int, step: int = 1) -> int:
        """The nearest place with a leaf after place k (or before it, step -1); the size or -1 if there is none."""
        k += step
        while 0 <= k < self.size and self.leaf[k] is None:
            k += step
        return k

    def _texts(self, first: int, last: int) -> str:
        return "".join(x[0] for x in self.leaf[first:last] if x)

    def edit(self, at: int, cut: int, new: str) -> None:
        """Replace characters [at, at + cut) by ``new``."""
        at = max(0, min(at, self.n_chars))
        cut = max(0, min(cut, self.n_chars - at))
        split = self.encoder.pieces
        if not self.n_chars:
            pieces = split(new)
            self.recoded += len(pieces)
            self._put(0, self.size, self._leaves(pieces))
            return
        lo, before = self.find(at)
        # A border depends on the run of white space and the piece that follow it: with some
        # untouched pieces between, the start of leaf lo stays a border.
        while (back := self._next(lo, -1)) >= 0 and len(split(self._texts(lo, self._next(self._next(lo)) + 1)[:at - before])) < CONTEXT:
            lo = back
            before -= len(self.leaf[lo][0])
        hi, end = lo, before
        while hi < self.size and end <= at + cut:
            end += len(self.leaf[hi][0])
            hi = self._next(hi)
        while True:
            old = self._texts(lo, hi)
            text = old[:at - before] + new + old[at - before + cut:]
            look, k = "", hi
            while k < self.size and len(split(look)) < CONTEXT:
                look, k = look + self.leaf[k][0], self._next(k)
            head, size = [], 0
            for piece in split(text + look):
                if size >= len(text):
                    break
                head.append(piece)
                size += len(piece)
            if size == len(text):  # a border again where an old leaf starts: what follows splits as it did
                break
            hi = self._next(hi) if hi < self.size else hi
        self.recoded += len(head)
        before_ = sum(x is not None for x in self.leaf[lo:hi])
        even = 0 < len(head) <= 2 * LEAF * before_ and len(head) >= before_
        self._put(lo, hi, self._leaves(head, before_ if even else None))

    def _put(self, lo: int, hi: int, fresh: list[tuple[str, int, int]]) -> None:
        """``fresh`` in place of the leaves at lo .. hi - 1."""
        used = [k for k in range(lo, hi) if self.leaf[k]]
        if len(fresh) == len(used):
            for k, x in zip(used, fresh):
                self.leaf[k] = x
                i = self.size + k
                self.chars[i], self.count[i] = len(x[0]), x[1]
            above = {(self.size + k) // 2 for k in used}
            while above and 0 not in above:
                for i in above:
                    self._pull(i)
                above = {i // 2 for i in above}
            return
        width, first = 1, lo
        while True:  # the smallest subtree around the places that has room
            if first + width >= hi:
                kept = [x for x in self.leaf[first:lo] if x] + fresh + [x for x in self.leaf[hi:first + width] if x]
                if len(kept) <= FULL * width or width == 1 and len(kept) <= 1:
                    return self._spread(first, width, kept)
            if width == self.size:
                break
            width *= 2
            first = first // width * width
        while FULL * self.size < len(kept):
            self.size *= 2
        self._lay(kept)


def build(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The trees of all rows: doc_id, leaves, n_chars, n_tokens, n_pieces. Write it to keep it; ``edit`` takes it from there."""
    path = tokenizer or tokens.vocabulary()

    def run(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            for lo, hi, _, _ in common.chunks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                for a in range(0, part.num_rows, ROWS):
                    some = part.slice(a, ROWS)
                    leaves = [tree._leaves(encoder.pieces(text or "")) for tree in [TokenTree(encoder)] for text in some.column(1).to_pylist()]
                    sums = [[sum(map(f, x)) for x in leaves] for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2])]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([[dict(zip(("text", "tokens", "pieces"), x)) for x in own] for own in leaves], LEAF_TYPE), *(pa.array(c, pa.int64()) for c in sums)], [x.split()[0] for x in TREES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.freed(run, keeps=True), TREES)


def edit(trees: DataFrame, edits, tokenizer: str | None = None) -> DataFrame:
    """Trees after edits: doc_id, n_tokens before, n_tokens_after, n_chars_after, n_pieces before, n_recoded (pre-tokens encoded again), leaves.

    edits: a column of ``trees`` (array<struct<at, cut, new>>, applied in order), or a table doc_id, seq, at, cut, new.
    """
    path = tokenizer or tokens.vocabulary()
    if isinstance(edits, DataFrame):
        one = F.struct(F.col("at").cast("long").alias("at"), F.col("cut").cast("long").alias("cut"), F.col("new").cast("string").alias("new"))
        listed = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("edit")))), lambda x: x["edit"]).alias("edits"))
        trees, edits = trees.join(listed, "doc_id", "left"), F.col("edits")
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_pieces", "n_recoded", "leaves"]

    def run(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                rows, after = [], []
                for leaves, todo in zip(part.column(1), part.column(4).to_pylist()):
                    tree = TokenTree(encoder, leaves=[(x["text"], x["tokens"], x["pieces"]) for x in leaves.as_py()])
                    for e in todo or ():
                        if e is not None:
                            tree.edit(e["at"] or 0, e["cut"] or 0, e["new"] or "")
                    rows.append((tree.n_tokens, tree.n_chars, tree.recoded))
                    after.append([dict(zip(("text", "tokens", "pieces"), x)) for x in tree.leaves])
                n, chars, recoded = (pa.array(c, pa.int64()) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n, chars, part.column(3), recoded, pa.array(after, LEAF_TYPE)], names)

    rows = trees.select("doc_id", "leaves", "n_tokens", "n_pieces", edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(common.freed(run, keeps=True), SCHEMA)


def standard_edits():
    """A column of trees: a phrase put in at half of a text's length, and 5 characters cut at a third."""
    one = lambda at, cut, new: F.struct(at.cast("long").alias("at"), F.lit(cut).cast("long").alias("cut"), F.lit(new).alias("new"))
    return F.array(one(F.floor(F.col("n_chars") / 2), 0, " edited 2024"), one(F.floor(F.col("n_chars") / 3), 5, ""))


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row: tokens of the text, tokens and characters after the standard edits, pre-tokens, and pre-tokens encoded again.

    The trees are written to the shared folder and edited from there.
    """
    trees = common.stored(build(docs, tokenizer), "trees")
    return edit(trees, standard_edits(), tokenizer).drop("leaves")

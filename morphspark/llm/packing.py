"""Mixture-controlled packing: deficit round robin over source queues.

Every window of ``window`` tokens takes from each source queue its target share.
``targets`` gives shares by source; what they leave of 1 is shared by the other sources
in proportion to their tokens (all of it if there are no targets, so that all
queues run dry together). Nothing is dropped or repeated: when a queue runs dry before
others, a phase ends, and the rest goes on at the same proportions to each other;
sources without a share come last. There is a phase for each target at most.

In a phase a source's quantum per window is window * its tokens / the phase's tokens,
which is seldom whole: what a window could not serve is the queue's deficit, and is
carried to the next window. The deficits are kept over a binary tree of the sources,
a round robin of two queues at each node: of the first x tokens that a node is served,
its left child gets floor(x * left / node), the whole part of its quanta so far, and
its right child the rest (left, node: their tokens). Both grow with x, add up to x, and
meet their totals at the end, so after w windows a source of S has been served
its exact share to within log2(S) tokens. As this is a pure function of w, a token's
window follows from its place in its queue alone: windows on either side of a partition
border carry the same deficits without any task waiting for another.

A queue holds a source's documents in the order of the stored token table
(task, place in the task). That table is written once to the shared folder; the
second pass reads it and joins one small row per task and source. Every source has a
queue of its own, at any number of sources: they are ranked in ranges and their paths
are found by joins, a row a source and level of the tree. With more even sources than
tokens in a window most pieces are one token, so a result has at most a row a token. Padding:
only the last sequence, which is padded to ``window`` unless its length is a power of
two. Memory: one document at a time beside one counter per source of the task and
the paths of ``PATHS`` queues.

Nulls: a null text is empty and yields only the end id; a null source is a queue
of its own; doc_id may be null or repeated, each row is packed. An empty table
gives an empty result. Columns besides doc_id, source and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphspark.llm import common, tokens
from morphspark.operators.ranks import global_rank

WINDOW = 2048
ROWS = 20_000
#: Queues whose paths a task holds at once; others are read again from their rows.
PATHS = 4096
PIECES = "doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, target_length bigint"


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """task, source, start (the source's tokens before it in the task), n, ids (uint16 or uint32 little-endian), doc_id; stored."""

    def run(batches):
        encoder, task, seen = tokens.encoder(tokenizer), TaskContext.get().partitionId(), {}
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        end = np.array([tokens.END], np.uint32).tobytes()
        for batch in batches:
            for lo, hi, _, _ in common.chunks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                sources, ids, starts, ns = part.column(1).to_pylist(), [], [], []
                for text, source in zip(part.column(2).to_pylist(), sources):
                    own = encoder.encode(text or "") + end
                    n = len(own) >> 2
                    ids.append(own if wide else np.frombuffer(own, "<u4").astype("<u2").tobytes())
                    ns.append(n)
                    starts.append(seen.get(source, 0))
                    seen[source] = starts[-1] + n
                m = len(ns)
                yield pa.RecordBatch.from_arrays([pa.array([task] * m, pa.int32()), pa.array(sources, pa.string()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), part.column(0)], ["task", "source", "start", "n", "ids", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return common.stored(rows.mapInArrow(common.freed(run, keeps=True), "task int, source string, start bigint, n bigint, ids binary, doc_id bigint"), "tokens")


def served(x: int, path: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Of the first x tokens: how many are of the queue at the end of ``path``, and of queues before it."""
    before = 0
    for left, node, side in path:
        cut = x * left // node
        if side:
            before += cut
            x -= cut
        else:
            x = cut
    return x, before


def place(y: int, path: list[tuple[int, int, int]]) -> int:
    """The smallest x of which ``served`` gives y tokens (1 or more) to the queue: its y-th token is the x-th of all."""
    for left, node, side in reversed(path):
        y = (y - 1) * node // (node - left) + 1 if side else -(-y * node // left)
    return y


def pieces_of(first: int, n: int, path: list[tuple[int, int, int]], total: int, window: int, base: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(window, start, length, offset) of the queue's places first .. first + n - 1 in a phase of ``total`` tokens after ``base`` others."""
    upto = lambda w: min(max(0, w * window - base), total)  # noqa: E731  tokens of the phase before window w
    at, w = first, -1
    while at < first + n:
        if w < 0:  # the window that serves the queue's place `at`
            w = (base + place(at + 1, path) - 1) // window
            got, before = served(upto(w), path)
        then, then_before = served(upto(w + 1), path)
        if then > at:
            end = min(then, first + n)
            yield w, at - first, end - at, max(0, base - w * window) + then_before - before + at - got
            at, w, got, before = end, w + 1, then, then_before
        else:  # a rare queue: not served by each window
            w = -1


def phases(totals: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """queue, total -> queue, phase, first (its place where the phase begins), n (its tokens in the phase, above 0)."""
    if not targets:
        return totals.select("queue", F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("first"), F.col("total").alias("n"))
    if min(targets.values()) <= 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are shares above 0 that add up to 1 at most")
    named = {_queue_name(k): v for k, v in targets.items()}
    has = {r.queue: r.total for r in totals.where(F.col("queue").isin(list(named))).collect()}  # at most a row a target
    rest = totals.where(~F.col("queue").isin(list(named))).agg(F.sum("total")).first()[0] or 0
    left = 1 - sum(named.values())
    dry = {q: n / named[q] for q, n in has.items()}
    others = rest / left if rest and left > 1e-9 else 0.0
    ends = sorted({*dry.values(), *([others] if others else [])})
    part = lambda d: F.array(*[F.lit(min(1.0, e / d)) for e in ends])  # noqa: E731  of a queue that runs dry at d
    upto = part(others) if others else F.array(*[F.lit(0.0) for _ in ends], F.lit(1.0))
    for q, d in dry.items():
        upto = F.when(F.col("queue") == q, part(d)).otherwise(upto)
    cum = F.transform(upto, lambda x: F.when(x >= 1, F.col("total")).otherwise(F.floor(x * F.col("total"))).cast("bigint"))
    steps = totals.select("queue", F.posexplode(cum).alias("phase", "upto"), cum.alias("cum"))
    first = F.when(F.col("phase") == 0, F.lit(0).cast("bigint")).otherwise(F.get("cum", F.col("phase") - 1))
    return steps.select("queue", "phase", first.alias("first"), (F.col("upto") - first).alias("n")).where("n > 0")


def queue_paths(totals: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """queue, phases array<struct<first, n, base, total, path array<struct<left, node, side>> from the root>>: a row a source."""
    parts = common.stored(phases(totals, targets), "phases")
    by = {r.phase: (r.n, r.queues) for r in parts.groupBy("phase").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("queues")).collect()}  # a row a phase
    levels = max([1, *((q - 1).bit_length() for _, q in by.values())])
    base, skip, bases = 0, 0, []
    for k in sorted(by):
        bases.append((k, base, by[k][0], skip))
        base, skip = base + by[k][0], skip + by[k][1]
    known = totals.sparkSession.createDataFrame(bases, "phase int, base long, total long, skip long")
    # One row a source, as many as there are documents at most: no task ranks them all.
    places = global_rank(parts, [F.col("phase"), F.col("queue")], "place").join(F.broadcast(known), "phase")
    ranked = common.stored(places.select(*parts.columns, (F.col("place") - 1 - F.col("skip")).alias("i")), "queues")
    nodes = (ranked.select("phase", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "i")
             .select("phase", "level", F.expr("shiftright(i, level)").alias("k"), "n").groupBy("phase", "level", "k").agg(F.sum("n").alias("t")))
    steps = ranked.select("queue", "phase", "first", "n", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "i").select(
        "queue", "phase", "first", "n", "level", F.expr("shiftright(i, level)").alias("k"), F.expr("shiftright(i, level - 1) & 1").alias("side"))
    node = nodes.select("phase", "level", "k", F.col("t").alias("node"))
    left = nodes.where("k % 2 = 0").select("phase", (F.col("level") + 1).alias("level"), F.expr("shiftright(k, 1)").alias("k"), F.col("t").alias("left"))
    step = F.struct("level", F.struct("left", "node", F.col("side").cast("long").alias("side")).alias("step"))
    paths = (steps.join(node, ["phase", "level", "k"]).join(left, ["phase", "level", "k"]).groupBy("queue", "phase", "first", "n")
             .agg(F.transform(F.reverse(F.array_sort(F.collect_list(step))), lambda x: x["step"]).alias("path")))
    told = paths.join(F.broadcast(known), "phase").select("queue", F.struct("phase", "first", "n", "base", "total", "path").alias("p"))
    return told.groupBy("queue").agg(F.array_sort(F.collect_list("p")).alias("phases"))  # a queue's phases: one a target at most


def _queue_name(source: str | None) -> str:
    return "null" if source is None else f"s{source}"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, target_length.

    targets: share of each window's tokens by source (None: that of documents without one), see the module.
    """
    table = tokenized(docs, tokenizer or tokens.vocabulary())
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sums = common.stored(table.groupBy("task", name.alias("queue")).agg(F.sum("n").alias("n")), "sums")
    # A row a source, then a row a task and source.
    paths = queue_paths(sums.groupBy("queue").agg(F.sum("n").alias("total")), targets)
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    base = sums.select("task", "queue", before.alias("base")).join(paths, "queue")
    placed = table.withColumn("queue", name).join(base, ["task", "queue"]).select(
        "doc_id", "source", "n", "ids", (F.col("base") + F.col("start")).alias("first"), "phases", "queue")

    whole = sums.agg(F.sum("n")).first()[0] or 0

    def run(batches):
        out, known = [[] for _ in range(9)], {}
        for batch in batches:
            cols = [c.to_pylist() if i not in (3, 5) else c for i, c in enumerate(batch.columns)]
            for i in range(batch.num_rows):
                n, source, queue = cols[2][i], cols[1][i], cols[6][i]
                if queue not in known:
                    if len(known) >= PATHS:
                        known.clear()
                    known[queue] = [(x["first"], x["n"], x["base"], x["total"], [(y["left"], y["node"], y["side"]) for y in x["path"]]) for x in cols[5][i].as_py()]
                raw, first = cols[3][i].as_buffer(), cols[4][i]
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for begin, m, base, total, path in known[queue]:
                    lo, hi = max(first, begin), min(first + n, begin + m)
                    if lo >= hi:
                        continue
                    for w, start, length, offset in pieces_of(lo - begin, hi - lo, path, total, window, base):
                        start += lo - first
                        size = min(window, whole - w * window)
                        row = (cols[0][i], source, start, length, zlib.crc32(ids[start:start + length].tobytes()), n, w, offset, size if size & (size - 1) == 0 else window)
                        for c, v in zip(out, row):
                            c.append(v)
                        if len(out[0]) >= ROWS:
                            yield _batch(out)
                            out = [[] for _ in range(9)]
        if out[0]:
            yield _batch(out)

    return placed.mapInArrow(common.freed(run), PIECES)


def _batch(columns: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names)

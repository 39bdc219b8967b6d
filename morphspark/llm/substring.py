"""Exact substring dedup by prefix-partitioned suffix trees.

A suffix starts at a word; two suffixes repeat each other if their first
``window`` words are equal, that is if they meet below an inner node of the
suffix tree at a depth of ``window`` words or more. The tree of the corpus is
never built at once:

1. Variable-length prefixes. The prefix of a suffix ends with the smallest
   ``GRAM``-word hash among its first ``window`` words, so its length varies,
   and equal windows have equal prefixes. Neighbouring suffixes of a text mostly
   end at the same place; such a run is one row: the hash of its end (the group)
   and the hash of all words that its windows cover (the block). Some 7 % of the
   suffixes begin a run. Rows are counted by (group, block), which folds exact
   copies of a block into one leaf for all of them: it is repeated as a whole.
2. A group with a single block that occurs once has no repeat. The groups with
   several different blocks, one of which occurs once, fetch their blocks' words.
3. A group of more than ``BUDGET`` suffixes, whose tree would not be sure to fit in
   memory, is split by prefixes of growing length (``LENGTHS`` words, counted
   each time); only parts beyond the budget grow on. A prefix as long as the
   window is itself an inner node of that depth, so its suffixes need no tree.
4. Subtrees. The suffixes of a part are put in order by doubled ranks of their
   words, and the common prefixes of neighbours (LCP) found from the same ranks.
   The LCP intervals of ``window`` words or more are the deep inner nodes; the
   leaves below them are the repeated starts.
5. Words covered by a repeated window are removed from the texts.

Texts are handled once for all their copies (a text that occurs twice is
repeated as a whole). The texts cross the network once, into a table bucketed by
their key; every later step joins small rows to it. No step gathers a group
without bound: counts are partial aggregates, joins back are sort-merge joins
whose skewed partitions Spark splits.

Words are ``[^\\x20\\x09-\\x0D]+`` and never changed. They are told apart by 64-bit
hashes, a run's words by a 64-bit hash beside that of its group; ranks are exact for
these. Null text: no words, empty result. Texts below ``window`` words lose nothing.
Windows are judged on the input. Rows with the same text, null or repeated ids each
get their result; an empty table gives an empty one. Columns besides doc_id and text
(and n_chars) are kept by strip_repeats whatever their names. A very long text is
one row; its words are worked on at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common

WINDOW, GRAM, BUDGET = 35, 8, 1 << 14
#: Words of the prefixes that split a group beyond BUDGET, before the whole window.
LENGTHS = (4, 12, 20)
SEP = common.separators()


def runs(h: np.ndarray, woff: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, group) of the runs of suffixes with the same prefix end, for all texts of a chunk."""
    n = np.maximum(np.diff(woff) - window + 1, 0)
    if not n.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = common.ngram_hashes(h, gram)
    place, size, width = np.arange(len(value), dtype=np.int32), 1, window - gram + 1

    def smaller(value, place, step):  # the left one of equals
        left = value[:-step] <= value[step:]
        return np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])

    while 2 * size <= width:  # the smallest of `size` values from each place
        value, place = smaller(value, place, size)
        size *= 2
    if size < width:
        value, place = smaller(value, place, width - size)
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(woff[:-1] - (np.cumsum(n) - n), n) + np.arange(len(text))
    at = place[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = start[np.append(new[1:], len(start)) - 1]
    return text[new], start[new], last, value[start[new]]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        one = [np.full(max(n, 1 << 20), np.uint64(b)) for b in (base, pow(base, -1, 1 << 64))]
        for x in one:
            x[0] = 1
        _POWERS[base] = tuple(np.multiply.accumulate(x) for x in one)
    return tuple(x[:n] for x in _POWERS[base])


def block_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> np.ndarray:
    """64-bit hash of the words lo..hi-1 of each run, from running sums of words times powers of a base."""
    up, down = powers(0x51ED270B76F8AD3D, len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(common.mix(h + common.K3) * up[:-1])])
    return common.mix((total[hi] - total[lo]) * down[lo] + common.mix(group + (hi - lo).astype(np.uint64)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def run_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """th, copies, start, length (suffixes of the run), g (group), b (block)."""

    def run(batches):
        for batch in batches:
            for lo, _, buf, offsets in common.chunks(batch, "text"):
                starts, ends, woff = common.word_spans(buf, offsets, SEP)
                h = common.word_hashes(buf, starts, ends)
                text, first, last, group = runs(h, woff, window, gram)
                if len(text):
                    block = block_hashes(h, first, last + window, group)
                    rows = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - woff[text]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), signed(group), signed(block)],
                        ["th", "copies", "start", "length", "g", "b"])

    return texts.select("th", "copies", "text").mapInArrow(common.freed(run), "th binary, copies bigint, start int, length int, g bigint, b bigint")


class Subtree:
    """The suffix trees of several parts at once: suffixes in order, common prefixes of neighbours, deep inner nodes.

    words: a block's word hashes; each of its places with ``window`` words from there on is a suffix.
    """

    def __init__(self, trees: np.ndarray, words: list[np.ndarray], window: int):
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        self.window, self.count = window, size - window + 1
        self.end = np.repeat(first + size, size)
        self._rank(np.concatenate(words))
        self.at = np.repeat(first - (np.cumsum(self.count) - self.count), self.count) + np.arange(self.count.sum())
        self.tree = np.repeat(trees, self.count)
        keys, k = [], 0
        for step in sorted(self.ranks, reverse=True):  # the window's words in ranks of growing places
            if window - k >= step:
                keys.append(self.ranks[step][self.at + k])
                k += step
        self.order = np.lexsort([*keys[::-1], self.tree])
        self.lcp = self._common()

    def _rank(self, flat: np.ndarray) -> None:
        """ranks[k][i]: the place of the k words from i on among all such runs of words (shorter at a block's end)."""
        _, rank = np.unique(flat, return_inverse=True)
        self.ranks, k, i = {1: rank}, 1, np.arange(len(flat))
        while 2 * k <= self.window:
            then = np.where(i + k < self.end, rank[np.minimum(i + k, len(flat) - 1)] + 1, 0)
            _, rank = np.unique(rank * np.int64(len(flat) + 1) + then, return_inverse=True)
            k *= 2
            self.ranks[k] = rank

    def _common(self) -> np.ndarray:
        """Words that each suffix but the last shares with the next one in order (0 in another tree)."""
        a, b = self.at[self.order[:-1]], self.at[self.order[1:]]
        room = np.minimum(self.end[a] - a, self.end[b] - b) if len(a) else a
        found = np.zeros(len(a), np.int64)
        live = np.flatnonzero(self.tree[self.order[:-1]] == self.tree[self.order[1:]])
        most = max(self.ranks)
        todo = live
        while len(todo):  # whole steps of the longest ranks, then shorter ones
            todo = self._step(most, a, b, room, found, todo)
        for step in sorted(self.ranks, reverse=True)[1:]:
            self._step(step, a, b, room, found, live)
        return found

    def _step(self, step: int, a, b, room, found, todo) -> np.ndarray:
        todo = todo[found[todo] + step <= room[todo]]
        x = found[todo]
        todo = todo[self.ranks[step][a[todo] + x] == self.ranks[step][b[todo] + x]]
        found[todo] += step
        return todo

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first leaf, last leaf, depth) in the order of suffixes: the topmost inner nodes of ``window`` words or more."""
        deep = np.concatenate([[False], self.lcp >= self.window, [False]])
        turn = np.flatnonzero(deep[1:] != deep[:-1])
        first, last = turn[::2], turn[1::2]
        depth = np.minimum.reduceat(np.append(self.lcp, self.window), np.stack([first, last], 1).ravel())[::2] if len(first) else first
        return first, last, depth

    def repeated(self) -> list[np.ndarray]:
        """For each block, which of its suffixes are leaves below a deep inner node."""
        cover = np.zeros(len(self.at) + 1, np.int64)
        first, last, _ = self.nodes()
        np.add.at(cover, first, 1)
        np.add.at(cover, last + 1, -1)
        deep = np.zeros(len(self.at), bool)
        deep[self.order] = np.cumsum(cover[:-1]) > 0
        return np.split(deep, np.cumsum(self.count)[:-1])


def _leaves(window: int):
    """Subtrees of a partition that is sorted by tree: as many whole trees at once as a batch holds."""
    names = ["th", "start", "length", "at", "marks"]

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        deep = Subtree(table.column("tree").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")], window).repeated()
        asks = table.column("asks").to_numpy()
        keep = [i for i, d in enumerate(deep) if asks[i] and d.any()]
        if not keep:
            return None
        part = table.take(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(part.column(x).combine_chunks() for x in names[:4]), pa.array([deep[i].astype(np.uint8).tobytes() for i in keep])], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(batch.schema.get_field_index("tree")).to_numpy()
            last = int(np.searchsorted(tree, tree[-1]))
            if last or held and held[-1].column("tree")[-1].as_py() != tree[0]:
                done = [*held, batch.slice(0, last)]
                held = [batch.slice(last)]
                if (out := flush(pa.Table.from_batches([x for x in done if x.num_rows]))) is not None:
                    yield out
            else:
                held.append(batch)
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    return run


LEAVES = "th binary, start int, length int, at int, marks binary"


def _tree_rows(rows: DataFrame, parts: int, window: int) -> DataFrame:
    """th, start, length, at, marks of the rows (tree, th, start, length, at, asks, words) that ask and have a repeated suffix."""
    rows = rows.select("tree", "th", "start", "length", "at", "asks", "words")
    return rows.repartition(parts, "tree").sortWithinPartitions("tree").mapInArrow(common.freed(_leaves(window)), LEAVES)


def split_groups(large: DataFrame, window: int, budget: int, parts: int) -> DataFrame:
    """Repeated suffixes (th, start, length, at) of groups beyond the budget, by prefixes of growing length."""
    lengths = [k for k in LENGTHS if k < window]
    keys = "".join(f", p{k} bigint" for k in [*lengths, window])
    rest = common.stored(large.mapInArrow(common.freed(_prefixes(window, lengths)), f"g bigint, th binary, start int, length int, at int, asks boolean, words binary{keys}"), "prefixes")
    found = None
    for k in lengths:
        sizes = rest.groupBy("g", f"p{k}").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = common.stored(rest.join(common.apart(sizes, "g"), ["g", f"p{k}"]), "prefixes")
        part = _tree_rows(sized.where(F.col("n") <= budget).withColumn("tree", F.xxhash64("g", f"p{k}")), parts, window).select("th", "start", "length", "at")
        found = part if found is None else found.union(part)
        rest = sized.where(F.col("n") > budget).drop("n")
    nodes = rest.groupBy("g", f"p{window}").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    deep = rest.where("asks").join(common.apart(nodes, "g"), ["g", f"p{window}"], "left_semi").select("th", "start", "length", "at")
    return deep if found is None else found.union(deep)


def repeated_runs(texts: DataFrame, window: int, gram: int, budget: int) -> DataFrame:
    """th, start, length, whole (all windows repeat), marks (else one byte a suffix, 1: repeats); only runs with repeats."""
    rows = common.stored(run_rows(texts, window, gram), "suffixes")
    # A text with copies is repeated as a whole; its blocks still take part, as occurring twice.
    blocks = rows.groupBy("g", "b").agg(F.sum(F.least("copies", F.lit(2))).alias("n"), F.max("length").alias("length"))
    groups = blocks.groupBy("g").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("most"), F.min("n").alias("least"), F.sum("length").alias("size")).where("blocks > 1 or most > 1")
    # Runs whose group may repeat, with what is known of their block and group.
    known = blocks.select("g", "b", "n").join(groups.select("g", "size", F.expr("blocks > 1 and least = 1").alias("doubt")), "g")
    open_runs = common.stored(rows.join(known, ["g", "b"]), "runs")
    whole = open_runs.where("n > 1 and copies = 1").select("th", "start", "length", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("marks"))
    # The blocks of groups in doubt, each at one place; those that occur once ask.
    places = open_runs.where("doubt").groupBy("g", "b").agg(F.min(F.struct("th", "start", "length", "size", (F.col("n") == 1).alias("asks"))).alias("x")).select("g", "x.*")
    per_text = places.groupBy("th").agg(F.collect_list(F.struct("g", "start", "length", "size", "asks")).alias("places"))
    fetched = common.stored(texts.select("th", "text").join(per_text, "th").mapInArrow(common.freed(_fetch(window)), "th binary, g bigint, start int, length int, size bigint, asks boolean, words binary"), "blocks")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = _tree_rows(fetched.where(F.col("size") <= budget).select(F.col("g").alias("tree"), "th", "start", "length", F.lit(0).alias("at"), "asks", "words"), parts, window)
    partly = small.select("th", "start", "length", F.lit(False).alias("whole"), "marks")
    large = fetched.where(F.col("size") > budget)
    if large.head(1):
        ats = split_groups(large, window, budget, parts).groupBy("th", "start", "length").agg(F.collect_set("at").alias("ats"))  # at most a run's suffixes
        marks = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.when(F.array_contains("ats", i), F.lit("01")).otherwise(F.lit("00")))
        partly = partly.union(ats.select("th", "start", "length", F.lit(False).alias("whole"), F.unhex(F.array_join(marks, "")).alias("marks")))
    return whole.union(partly)


def _fetch(window: int):
    def run(batches):
        names = ["th", "g", "start", "length", "size", "asks", "words"]
        types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            th, places = batch.column(0), batch.column(2)
            for lo, hi, buf, offsets in common.chunks(batch, "text"):
                starts, ends, woff = common.word_spans(buf, offsets, SEP)
                h = common.word_hashes(buf, starts, ends)
                out, size = [], 0
                for i in range(lo, hi):
                    own = h[woff[i - lo]:woff[i - lo + 1]]
                    for p in places[i].as_py():
                        words = own[p["start"]:p["start"] + p["length"] + window - 1].tobytes()
                        out.append((th[i].as_py(), p["g"], p["start"], p["length"], p["size"], p["asks"], words))
                        size += len(words)
                    if size > common.CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _prefixes(window: int, lengths: list[int]):
    """A row for each suffix of a block: its window's words and the hashes of its prefixes."""

    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                w = np.frombuffer(c["words"][i].as_py(), np.uint64)
                n = len(w) - window + 1
                same = lambda name, t: pa.array([c[name][i].as_py()] * n, t)  # noqa: B023, E731
                own = pa.array([w[k:k + window].tobytes() for k in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [same("g", pa.int64()), same("th", pa.binary()), same("start", pa.int32()), same("length", pa.int32()), pa.array(np.arange(n, dtype=np.int32)), same("asks", pa.bool_()), own,
                     *(signed(common.ngram_hashes(w, k)[:n]) for k in [*lengths, window])],
                    ["g", "th", "start", "length", "at", "asks", "words", *(f"p{k}" for k in [*lengths, window])])

    return run


def removal(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, budget: int = BUDGET) -> DataFrame:
    """Per different text: th, n_words, n_removed, kept (the kept words joined by a space)."""
    found = repeated_runs(texts, window, gram, budget).groupBy("th").agg(F.collect_list(F.struct("start", "length", "whole", "marks")).alias("runs"))
    joined = texts.join(found, "th", "left").select("th", "text", "copies", "runs")

    def run(batches):
        for batch in batches:
            copies, all_runs = batch.column(2).to_numpy(), batch.column(3)
            for lo, hi, buf, offsets in common.chunks(batch, "text"):
                starts, ends, woff = common.word_spans(buf, offsets, SEP)
                cover = np.zeros(len(starts) + 1, np.int64)
                for i in range(lo, hi):
                    a, n = woff[i - lo], woff[i - lo + 1] - woff[i - lo]
                    if n < window:
                        continue
                    if copies[i] > 1:
                        cover[a] += 1
                        cover[a + n] -= 1
                        continue
                    for r in all_runs[i].as_py() or ():
                        at = a + r["start"]
                        if r["whole"]:
                            cover[at] += 1
                            cover[at + r["length"] + window - 1] -= 1
                        else:
                            hit = at + np.flatnonzero(np.frombuffer(r["marks"], np.uint8))
                            np.add.at(cover, hit, 1)
                            np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept, removed = [], []
                for i in range(hi - lo):
                    a, b = woff[i], woff[i + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    removed.append(int(b - a - len(stay)))
                    raw = buf[offsets[i]:offsets[i + 1]].tobytes()
                    # bytes.split() splits at the same six bytes
                    kept.append(b" ".join(raw.split()) if len(stay) == b - a else _join(raw, starts[stay] - offsets[i], ends[stay] - offsets[i]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(woff)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["th", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(common.freed(run), "th binary, n_words bigint, n_removed bigint, kept string")


def _join(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def digests(docs: DataFrame, **params) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    texts = common.distinct_texts(docs.select("text"), "texts")
    result = removal(texts, **params).select("th", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    return docs.select("doc_id", common.text_key(F.col("text")).alias("th")).join(result, "th").drop("th")


def strip_repeats(docs: DataFrame, **params) -> DataFrame:
    """A pipeline stage: every row of docs with the repeated passages taken out of its text; n_chars follows."""
    result = removal(common.distinct_texts(docs.select("text"), "texts"), **params)
    th, kept, removed = common.free_names(docs.columns, "th", "kept", "removed")
    back = result.select(F.col("th").alias(th), F.col("kept").alias(kept), F.col("n_removed").alias(removed))
    out = docs.withColumn(th, common.text_key(F.col("text"))).join(back, th)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col(removed) > 0, F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(columns)

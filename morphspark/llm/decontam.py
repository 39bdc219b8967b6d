"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus (a table of the
   fixed size ``2**SLOTS``) give idf weights; every word weighs something.
2. A distributed randomised SVD (subspace iteration on A'A, A the TF-IDF passages
   of the benchmark, a row an item) gives the latent space, one for each ``RANK``
   items: as many directions as items, so no item loses any of its energy however
   many there are. Tasks hold rows of A; only sums of A'(A M) over words travel.
3. Every text is cut into passages of ``2 * STEP`` words at steps of ``STEP``. A passage
   has an item's length of context on either side. It is a candidate if it holds
   ``MATCH`` or more of the item's energy (the squared weights of its words): a share
   of the item alone, which other words of the passage do not lessen, so a verbatim
   item is always one. Its product with the item in the latent space bounds that share
   from above; where this is enough, the item's words are counted, and those that are
   too few for 4 in any order are left out.
4. A candidate's words are held against the item by the longest common subsequence.
   At ``SAME`` of the item's words or more it is a leak; at ``PARAPHRASE`` or more it is
   one if the item's answer (its last ``ANSWER`` words) is there as well, all but a fifth
   of it.

Items come in blocks of at most ``ITEMS`` (the bound of what is broadcast); each
block is a pass over the texts in the same job, without shuffle, and holds its
latent spaces.

Words are ASCII letters and digits and all other characters beyond ASCII, in lower
case. Null texts and items without words take no part; such documents are clean.
Rows are judged one by one, so repeated rows and null ids get their results; of
repeated items each counts. An empty table of documents gives an empty result, one of
items leaves all clean. Other columns are kept by drop_contaminated whatever their
names. Very long texts are taken a chunk of rows at a time; an item of n words needs
n * n / 8 bytes for its comparison at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common

SLOTS, RANK, STEP, MATCH, SAME, PARAPHRASE, ANSWER = 18, 192, 32, 0.3, 0.75, 0.5, 5
ITEMS, ROUNDS = 2_000, 2
#: Words whose sums of the factorisation travel in one row.
WIDE = 1024
#: Words of items that are multiplied at once there.
WORDS = 20_000
#: Passages looked at at once.
PASSAGES = 2048
PART = 256 << 10
SEP = common.separators("alnum")


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk in lower case and where each text's words start."""
    starts, ends, woff = common.word_spans(buf, offsets, SEP)
    return common.word_hashes(buf, starts, ends), woff


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by slot of a word, and all documents (rows)."""
    cut = 64

    def count(batches):
        sketch, rows = np.zeros(1 << SLOTS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, buf, offsets in common.chunks(batch, "text", 1 << 20, lower=True):
                h, woff = words(buf, offsets)
                key = np.repeat(np.arange(len(woff) - 1), np.diff(woff)) << SLOTS | slot_of(h)
                key.sort()
                if len(key):
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    sketch += np.bincount(key & ((1 << SLOTS) - 1), minlength=1 << SLOTS)
        pieces = [*np.split(sketch, cut), np.array([rows])]
        yield pa.RecordBatch.from_arrays([pa.array(range(cut + 1), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * (cut + 1), pa.int32()), pa.array([p.tobytes() for p in pieces])], ["slice", "part", "counts"])

    def total(table: pa.Table) -> pa.Table:
        acc = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([acc.tobytes()])})

    schema = "slice int, part int, counts binary"
    parts = docs.select("text").mapInArrow(common.freed(count), schema).groupBy("slice", "part").applyInArrow(total, schema).groupBy("slice").applyInArrow(total, schema)
    told = {r.slice: np.frombuffer(r.counts, np.int64) for r in parts.collect()}  # 65 rows of fixed size
    if not told:
        return np.zeros(1 << SLOTS, np.int64), 0
    return np.concatenate([told[i] for i in range(cut)]), int(told[cut][0])


def idf(df: np.ndarray, docs: int) -> np.ndarray:
    return (np.log((docs + 1.0) / (df + 1.0)) + 0.1).astype(np.float32)


def latent_space(items: DataFrame, weight: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(slots, V): the benchmark's slots and their rows of the right singular vectors."""
    spark = items.sparkSession
    told = spark.sparkContext.broadcast(weight)

    def featurize(batches):
        for batch in batches:
            for _, _, buf, offsets in common.chunks(batch, "text", lower=True):
                h, woff = words(buf, offsets)
                s = slot_of(h)
                w = told.value[s]
                norm = np.sqrt(np.maximum(np.add.reduceat(np.append(w.astype(np.float64) ** 2, 0.0), np.minimum(woff[:-1], len(w))) * (np.diff(woff) > 0), 1e-12))
                w = w / np.repeat(norm, np.diff(woff))
                off = pa.array(woff.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(off, pa.array(s.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(w.astype(np.float64)))], ["slots", "weights"])

    rows = common.stored(items.select("text").mapInArrow(common.freed(featurize), "slots array<int>, weights array<double>"), "items")
    slots = np.array(sorted(r[0] for r in rows.select(F.explode("slots").alias("s")).distinct().collect()), np.int64)  # at most 2**SLOTS
    rank = min(rank, len(slots), max(1, rows.count()))
    place = np.full(1 << SLOTS, -1, np.int64)
    place[slots] = np.arange(len(slots))
    if not len(slots):
        return slots, np.zeros((0, 1), np.float32)
    wide = min(rank + 8, len(slots))
    m = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(slots), wide)))[0]

    def apply(m: np.ndarray) -> np.ndarray:
        """A'(A m), summed over the tasks' rows."""
        sent = spark.sparkContext.broadcast((place, m))

        def run(batches):
            place, m = sent.value
            ats, sums = [], []
            for part in (x for batch in batches for x in rows_of(batch)):
                s, w = (part.column(i).flatten().to_numpy() for i in (0, 1))
                if not len(s):
                    continue
                row = np.repeat(np.arange(part.num_rows), part.column(0).value_lengths().to_numpy())
                own, at = np.unique(place[s], return_inverse=True)
                y, z = np.zeros((part.num_rows, m.shape[1])), np.zeros((len(own), m.shape[1]))
                np.add.at(y, row, w[:, None] * m[own[at]])
                np.add.at(z, at, w[:, None] * y[row])
                ats.append(own)
                sums.append(z)
            if ats:
                yield from told_in_parts(np.concatenate(ats), np.concatenate(sums))

        def rows_of(batch: pa.RecordBatch):
            """The batch in runs of rows of about WORDS words."""
            upto, lo = np.cumsum(batch.column(0).value_lengths().to_numpy()), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WORDS)))
                yield batch.slice(lo, hi - lo)
                lo = hi

        def told_in_parts(at: np.ndarray, v: np.ndarray):
            for k in np.unique(at // WIDE).tolist():
                mine = at // WIDE == k
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([at[mine].astype(np.int64).tobytes()]), pa.array([v[mine].tobytes()])], ["part", "at", "v"])

        def total(table: pa.Table) -> pa.Table:
            at = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("at")])
            v = np.concatenate([np.frombuffer(x.as_buffer()) for x in table.column("v")]).reshape(len(at), -1)
            own, where = np.unique(at, return_inverse=True)
            z = np.zeros((len(own), v.shape[1]))
            np.add.at(z, where, v)
            return pa.table({"part": table.column("part")[:1], "at": pa.array([own.tobytes()]), "v": pa.array([z.tobytes()])})

        out, schema = np.zeros_like(m), "part bigint, at binary, v binary"
        for r in rows.mapInArrow(common.freed(run), schema).groupBy("part").applyInArrow(total, schema).toLocalIterator():
            own = np.frombuffer(r.at, np.int64)
            out[own] = np.frombuffer(r.v).reshape(len(own), -1)
        sent.unpersist()
        return out

    for _ in range(rounds):
        m = np.linalg.qr(apply(m))[0]
    values, turn = np.linalg.eigh(m.T @ apply(m))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-12 * max(values.max(), 1e-30)]
    return slots, (m @ turn[:, keep]).astype(np.float32)


def lcs(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel); masks: places of each word of the first sequence."""
    v = full = (1 << n) - 1
    for x in other:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Items:
    """At most ``RANK`` items as broadcast: ids, words, latent vectors."""

    def __init__(self, ids: list[int], texts: list[str], weight: np.ndarray, slots: np.ndarray, v: np.ndarray):
        raw = [pc.utf8_lower(pa.scalar(t)).as_py().encode() for t in texts]
        h, woff = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        self.place = np.full(1 << SLOTS, -1, np.int32)
        self.place[slots] = np.arange(len(slots))
        self.ids = ids
        self.wide = v * weight[slots][:, None]
        self.square = weight[slots].astype(np.float64) ** 2
        self.words = [h[woff[i]:woff[i + 1]].tolist() for i in range(len(ids))]
        self.at = [self.place[slot_of(h[woff[i]:woff[i + 1]])] for i in range(len(ids))]
        self.latent = np.array([self.wide[x].sum(0) for x in self.at], np.float32)
        #: What a candidate holds of an item at least, and the item's norm for the rounding of products.
        self.least = np.array([MATCH * self.square[x].sum() for x in self.at])
        self.norm = np.linalg.norm(self.latent, axis=1).astype(np.float64)
        self.reach = np.array([-(-len(x) // STEP) for x in self.at])

    def prepare(self) -> None:
        self.masks = [_masks(w) for w in self.words]
        self.answers = [_masks(w[-ANSWER:]) for w in self.words]

    def candidates(self, h: np.ndarray, woff: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word of the passage in its text, item)."""
        n = np.diff(woff)
        firsts = np.repeat(woff[:-1], -(-n // STEP)) + STEP * (np.arange((-(-n // STEP)).sum()) - np.repeat(np.cumsum(-(-n // STEP)) - (-(-n // STEP)), -(-n // STEP)))
        if not len(firsts):
            return []
        text = np.repeat(np.arange(len(n)), -(-n // STEP))
        start = np.repeat(np.cumsum(-(-n // STEP)) - (-(-n // STEP)), -(-n // STEP))
        end = start + (-(-n // STEP))[text]
        at = self.place[slot_of(h)]
        used = np.flatnonzero(at >= 0)
        # Each word once for each step of STEP words.
        key = np.unique((np.searchsorted(firsts, used, side="right") - 1) * len(self.wide) + at[used])
        out, most = [], int(self.reach.max())
        for a in range(0, len(firsts), PASSAGES):
            b = min(a + PASSAGES, len(firsts))
            lo, hi = max(0, a - most), min(len(firsts), b + 1 + most)
            part = key[np.searchsorted(key, lo * len(self.wide)):np.searchsorted(key, hi * len(self.wide))] - lo * len(self.wide)
            if len(part):
                out += [(int(text[x]), int(firsts[x] - woff[text[x]]), k) for x, k in self._candidates(part, hi - lo, np.arange(a, b) - lo, start[a:b] - lo, end[a:b] - lo, lo)]
        return sorted(out)

    def _candidates(self, key: np.ndarray, m: int, own: np.ndarray, start: np.ndarray, end: np.ndarray, shift: int) -> list[tuple[int, int]]:
        """(passage, item) for the passages ``own`` of m steps; key: step and word; start, end: the steps of the passage's text."""
        step, at = np.divmod(key, len(self.wide))
        new = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        latent = np.zeros((m, self.wide.shape[1]), np.float32)
        latent[step[new]] = np.add.reduceat(self.wide[at], new)
        products, norms = np.zeros((m + 1, len(self.ids))), np.zeros(m + 1)
        np.cumsum(latent @ self.latent.T, axis=0, dtype=np.float64, out=products[1:])
        np.cumsum(np.sqrt(np.bincount(step, self.square[at], m)), out=norms[1:])
        found = []  # (item, passages, first and end step of each)
        for r in np.unique(self.reach[self.reach > 0]).tolist():
            items = np.flatnonzero(self.reach == r)
            lo, hi = np.maximum(own - r, np.maximum(start, 0)), np.minimum(own + 2 + r, np.minimum(end, m))
            got = products[hi][:, items] - products[lo][:, items] + 1e-5 * (norms[hi] - norms[lo])[:, None] * self.norm[items] >= 0.999 * self.least[items]
            j, near = np.nonzero(got.T)
            for x in np.split(np.arange(len(j)), np.flatnonzero(j[1:] != j[:-1]) + 1) if len(j) else ():
                found.append((items[j[x[0]]], near[x], lo[near[x]], hi[near[x]]))
        if not found:
            return []
        # The words of these items alone: the last step up to each that holds the word.
        words_ = np.unique(np.concatenate([self.at[k] for k, *_ in found]))
        place = np.full(len(self.wide), -1, np.int64)
        place[words_] = np.arange(len(words_))
        mine = np.flatnonzero(place[at] >= 0)
        last = np.full((m, len(words_)), -1, np.int32)
        last[step[mine], place[at[mine]]] = step[mine]
        np.maximum.accumulate(last, axis=0, out=last)
        out = []
        for k, near, lo, hi in found:
            there = last[(hi - 1)[:, None], place[self.at[k]]] >= lo[:, None]
            held, size, answer = there.sum(1), len(self.at[k]), min(ANSWER, len(self.at[k]))
            kept = near[(there @ self.square[self.at[k]] >= (1 - 1e-9) * self.least[k]) & ((held >= SAME * size) | (held >= PARAPHRASE * size) & (there[:, -answer:].sum(1) >= 0.8 * answer))]
            out += [(x, k) for x in (own[kept] + shift).tolist()]
        return out

    def leaks(self, h: np.ndarray, woff: np.ndarray) -> dict[int, dict[int, float]]:
        """Per text with leaks: item id and score."""
        found: dict[int, dict[int, float]] = {}
        for t, first, k in self.candidates(h, woff):
            own, n = self.words[k], len(self.words[k])
            if not n or found.get(t, {}).get(self.ids[k], 0.0) >= 1.0:
                continue
            near = h[woff[t] + max(0, first - n):min(woff[t + 1], woff[t] + first + 2 * STEP + n)].tolist()
            score = lcs(self.masks[k], n, near) / n
            m = min(ANSWER, n)
            if score >= SAME or score >= PARAPHRASE and lcs(self.answers[k], m, near) >= 0.8 * m:
                mine = found.setdefault(t, {})
                mine[self.ids[k]] = max(score, mine.get(self.ids[k], 0.0))
        return found


def mark(docs: DataFrame, benchmark: DataFrame, items_per_block: int = ITEMS, name: str = "__leaks") -> DataFrame:
    """docs with the column ``name`` map<item_id, score> (empty: clean); all columns and rows stay."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    weight = idf(*document_frequencies(docs))
    out = docs.withColumn(name, F.create_map().cast("map<bigint,double>"))
    schema, at = out.schema, len(docs.columns)
    text_at = docs.columns.index("text")
    kind = pa.map_(pa.int64(), pa.float64())

    def passes(ids: list[int], texts: list[str], df: DataFrame) -> DataFrame:
        blocks = []
        for i in range(0, len(ids), RANK):
            part = spark.createDataFrame([(x,) for x in texts[i:i + RANK]], "text string")
            slots, v = latent_space(part, weight)
            if len(slots):
                blocks.append(Items(ids[i:i + RANK], texts[i:i + RANK], weight, slots, v))
        sent = spark.sparkContext.broadcast(blocks)

        def run(batches):
            blocks = sent.value
            for block in blocks:
                block.prepare()
            for batch in batches:
                leaks = [dict(x) for x in batch.column(at).to_pylist()]
                one = pa.RecordBatch.from_arrays([batch.column(text_at)], ["text"])
                for lo, _, buf, offsets in common.chunks(one, "text", PART, lower=True):
                    h, woff = words(buf, offsets)
                    for block in blocks:
                        for t, found in block.leaks(h, woff).items():
                            leaks[lo + t].update(found)
                columns = [*batch.columns[:at], pa.array([sorted(x.items()) for x in leaks], kind)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return df.mapInArrow(common.freed(run), schema)

    ids, texts = [], []
    for r in items.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        if len(ids) == items_per_block:
            out, ids, texts = passes(ids, texts, out), [], []
    if ids:
        out = passes(ids, texts, out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, contaminated, items (ids of leaked items, sorted), score (best share of an item found, else 0)."""
    marked = mark(docs.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id", (F.size("__leaks") > 0).alias("contaminated"), F.array_sort(F.map_keys("__leaks")).alias("items"),
        F.coalesce(F.array_max(F.map_values("__leaks")), F.lit(0.0)).alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a leaked item."""
    name = common.free_names(docs.columns, "leaks")[0]
    return mark(docs, benchmark, name=name).where(F.size(name) == 0).drop(name)



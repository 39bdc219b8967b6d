"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (letters and digits, lower case), the first 4, 5
and 6 bytes of longer words (so that inflected and compounded forms share
weights), bigrams and skip-grams over one word, hashed into ``2**BITS`` slots.
A feature counts once per text, so length does not drown a single insult.

Training: at most ``SAMPLE`` labelled rows (the smallest hashes of doc_id; the
bound is a parameter), dealt to ``SHARDS`` tasks. Every shard runs FTRL-proximal
for ``EPOCHS`` passes and the shards' weights are averaged; only arrays of the
fixed size ``2**BITS`` travel. Scoring covers every row and whole texts; the L1
term leaves few weights, which are broadcast.

Nulls: a null text is empty and gets the score of the bias alone; a null doc_id
is never trained on and counts as not held out. Repeated rows give repeated
results. No labelled rows: every score is 0. An empty table gives an empty result. Very
long texts are taken whole, a chunk of rows at a time. drop_toxic keeps all other
columns, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common

BITS, SAMPLE, SHARDS, EPOCHS = 19, 20_000, 2, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.6, 0.5
STEMS = (4, 5, 6)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets per text): the different slots of each text of a chunk in lower case."""
    starts, ends, woff = common.word_spans(buf, offsets, common.separators("alnum"))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(woff))
    h = common.word_hashes(buf, starts, ends)
    found, where = [h], [doc]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        found.append(common.word_hashes(buf, starts[long], starts[long] + n, seed=n))
        where.append(doc[long])
    for gap in (1, 2):
        same = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
        found.append(common.mix(h[same] * common.K1 + h[same + gap] + np.uint64(gap)))
        where.append(doc[same])
    slot = np.concatenate(found) >> np.uint64(64 - bits)
    key = (np.concatenate(where).astype(np.uint64) << np.uint64(bits)) | slot
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(bits)).astype(np.int64)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(doc, np.arange(len(offsets)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def learn(rows, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (slots, label) rows, changing z and n; the last slot is the bias."""
    for slots, label in rows:
        i = np.append(slots, len(z) - 1)
        p = 1.0 / (1.0 + np.exp(-np.clip(weights(z[i], n[i]).sum(), -30, 30)))
        g = p - label
        root = np.sqrt(n[i])
        grown = np.sqrt(n[i] + g * g)
        z[i] += g - (grown - root) / ALPHA * weights(z[i], n[i])
        n[i] += g * g


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _shard(bits: int, epochs: int):
    """A shard's weights: all epochs of FTRL-proximal over its rows, each in an order of its own."""

    def shard(table: pa.Table) -> pa.Table:
        slots, toxic = table.column("slots").combine_chunks(), table.column("toxic").to_numpy()
        flat, off = slots.flatten().to_numpy(), slots.offsets.to_numpy() - slots.offsets[0].as_py()
        own = np.array([zlib.crc32(flat[off[i]:off[i + 1]].tobytes()) for i in range(len(toxic))], np.uint64)
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for epoch in range(epochs):
            learn(((flat[off[i]:off[i + 1]], toxic[i]) for i in np.argsort(common.mix(own + np.uint64(epoch)), kind="stable")), z, n)
        w = weights(z, n)
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array([at.astype(np.int32).tobytes()]), "w": pa.array([w[at].astype(np.float32).tobytes()])})

    return shard


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, 2**bits and a bias; learnt from labelled rows that are not held out."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows: the bound of this broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))

    def featurize(batches):
        for batch in batches:
            for lo, hi, buf, offsets in common.chunks(batch, "text", lower=True):
                slots, off = features(buf, offsets, bits)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(slots))], ["shard", "toxic", "slots"])

    w, seen = np.zeros((1 << bits) + 1), 0
    data = picked.mapInArrow(common.freed(featurize), "shard int, toxic double, slots array<int>")
    for r in data.groupBy("shard").applyInArrow(_shard(bits, epochs), "at binary, w binary").toLocalIterator():  # a row a shard, 2**bits weights at most
        w[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.w, np.float32)
        seen += 1
    if not seen:
        w[-1] = -np.inf
    return w / max(seen, 1)


def score(docs: DataFrame, w: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, in one pass without shuffle."""
    kept = np.flatnonzero(w)
    sparse = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), w[kept].astype(np.float64)))

    def run(batches):
        full = np.zeros((1 << bits) + 1)
        full[sparse.value[0]] = sparse.value[1]
        for batch in batches:
            for lo, hi, buf, offsets in common.chunks(batch, "text", lower=True):
                slots, off = features(buf, offsets, bits)
                total = np.concatenate([[0.0], np.cumsum(full[slots])])
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-(np.round(total[off[1:]] - total[off[:-1]], 9) + full[-1])))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(part.schema) - 1)), pa.array(p)], [*part.schema.names[:-1], "score"])

    return docs.mapInArrow(common.freed(run), "doc_id bigint, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (score >= 0.5)."""
    w = train(docs, labels, **params)
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(base, w, params.get("bits", BITS)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold."""
    w = train(docs, labels, **params)
    bits = params.get("bits", BITS)
    sparse = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)]))
    at = docs.columns.index("text")

    def run(batches):
        full = np.zeros((1 << bits) + 1)
        full[sparse.value[0]] = sparse.value[1]
        for batch in batches:
            for lo, hi, buf, offsets in common.chunks(batch, "text", lower=True):
                slots, off = features(buf, offsets, bits)
                total = np.concatenate([[0.0], np.cumsum(full[slots])])
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-(np.round(total[off[1:]] - total[off[:-1]], 9) + full[-1])))
                part = batch.slice(lo, hi - lo).filter(pa.array(p < threshold))
                if part.num_rows:
                    yield part

    assert docs.columns[at] == "text"
    return docs.mapInArrow(common.freed(run), docs.schema)

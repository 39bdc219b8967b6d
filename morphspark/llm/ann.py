"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns a unit vector by three rounds of random signs and a fast Hadamard
transform and names the nearest signed axis: 2 * d cells. A query probes in each
table the ``probes`` axes of greatest inner product; rows in a probed cell are
candidates, and candidates are ranked again by exact Euclidean distance of the
original vectors in double precision.

Every row is hashed, in the task that reads it: the tables of a batch are built,
probed by the queries and dropped, so neither the index nor candidate pairs are
ever shuffled. A task keeps its ``k`` nearest per query; one window over these
gives the result. The stated queries come in blocks of at most ``BLOCK`` (the bound of
what the driver holds and broadcasts at once); each block is a pass over the rows, whose
nearest are written to the shared folder before the next block is read.

Equal vectors of a batch are one entry with its smallest ids, as ties go to the
smaller id and no more than k + 1 can appear: a hot group of copies costs one
comparison. Null, zero and non-finite vectors, vectors of another dimension than
``dim``, and null ids take no part. Rows that repeat a vec_id are ranked as they
stand, except a query's own id; equal distances are ranked by vec_id. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphspark.llm import common

TABLES, PROBES, BLOCK, SEED = 10, 10, 4096, 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(dim: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs of three rounds for each table, over the padded dimension."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, size))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """All unit rows turned by one table's pseudo-rotation."""
    size = signs.shape[1]
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def cells(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis: axis, or axis + d for its negative."""
    axis = np.abs(y).argmax(1)
    return np.where(y[np.arange(len(y)), axis] >= 0, axis, axis + y.shape[1])


def probe_cells(y: np.ndarray, probes: int) -> np.ndarray:
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probe_lists(q: np.ndarray, signs: np.ndarray, probes: int) -> list[list[np.ndarray]]:
    """For each table and cell the queries that probe it."""
    out = []
    for s in signs:
        p = probe_cells(turned(unit(q), s), probes)
        flat, who = p.ravel(), np.repeat(np.arange(len(q)), p.shape[1])
        order = np.argsort(flat, kind="stable")
        out.append(np.split(who[order], np.searchsorted(flat[order], np.arange(1, 2 * signs.shape[2]))))
    return out


def search_batch(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, lists, signs: np.ndarray, k: int):
    """(query index, id, distance) of the k nearest candidates of each query among these rows."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))
    own = x[first]
    units = unit(own)
    at, who = [], []
    qq, oo = (q * q).sum(1), (own * own).sum(1)
    for t, s in enumerate(signs):
        cell = cells(turned(units, s))
        by = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[by], np.arange(2 * signs.shape[2] + 1))
        for c in np.unique(cell):
            rows, asked = by[bounds[c]:bounds[c + 1]], lists[t][c]
            if not len(asked):
                continue
            d = qq[asked][:, None] + oo[rows][None] - 2.0 * q[asked] @ own[rows].T
            m = min(len(rows), k + 6)  # room for rounding; the exact ranking follows
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            at.append(np.repeat(asked, m))
            who.append(rows[near.ravel()])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair = np.unique(np.concatenate(at) * np.int64(len(first)) + np.concatenate(who))
    at, who = pair // len(first), pair % len(first)
    out_q, out_id, out_d = [], [], []
    dist = np.concatenate([np.sqrt(((q[at[i:i + 65536]] - own[who[i:i + 65536]]) ** 2).sum(1)) for i in range(0, len(at), 65536)])
    count = np.minimum(last - first, k + 1)[who]
    spread = np.repeat(np.arange(len(who)), count)
    nth = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
    out_q, out_id, out_d = at[spread], ids[first[who[spread]] + nth], dist[spread]
    keep = out_id != q_ids[out_q]
    out_q, out_id, out_d = out_q[keep], out_id[keep], out_d[keep]
    order = np.lexsort((out_id, out_d, out_q))
    out_q, out_id, out_d = out_q[order], out_id[order], out_d[order]
    start = np.searchsorted(out_q, np.arange(len(q)))
    rank = np.arange(len(out_q)) - start[out_q]
    keep = rank < k
    return out_q[keep], out_id[keep], out_d[keep]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query.

    rows and queries have vec_id and embedding; a query's own vec_id is left out.
    """
    spark = rows.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = clean(queries)
    if dim is None:
        sizes = clean(rows).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if sizes is None:
            return empty
        dim = sizes["d"]
    asked, found = asked.where(F.size("v") == dim), None
    base = clean(rows).where(F.size("v") == dim)
    signs = rotations(dim, tables)

    def one(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast((q_ids, q))

        def run(batches):
            q_ids, q = told.value
            lists = probe_lists(q, signs, probes)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                    a, i, d = search_batch(batch.column(0).to_numpy(), x, q_ids, q, lists, signs, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(i), pa.array(d)], ["query_id", "vec_id", "score"])

        near = common.stored(base.mapInArrow(common.freed(run), "query_id bigint, vec_id bigint, score double"), "nearest")
        told.unpersist()
        return near

    ids, vectors = [], []
    for r in asked.toLocalIterator():
        ids.append(r.vec_id)
        vectors.append(r.v)
        if len(ids) == block:
            part = one(np.array(ids, np.int64), np.array(vectors))
            found, ids, vectors = part if found is None else found.union(part), [], []
    if ids:
        part = one(np.array(ids, np.int64), np.array(vectors))
        found = part if found is None else found.union(part)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, **params) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``."""
    return search(embeddings, embeddings.where(F.col("vec_id") % every == 0), k, **params)


def exact(embeddings: DataFrame, every: int = 100, k: int = 10) -> list[tuple[int, int, int, float]]:
    """Brute force on the driver for tests: small tables only."""
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in embeddings.select("vec_id", "embedding").collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = []
    for i, v in rows:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return out

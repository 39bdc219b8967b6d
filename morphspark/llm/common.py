"""Shared helpers: durable folders, whole-text batches and vectorised word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once by the numpy code; one longer text is one chunk.
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 512

K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xBF58476D1CE4E5B9)
K3 = np.uint64(0x94D049BB133111EB)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (or setCheckpointDir's), which every executor can reach.

    Only where neither is set and Spark runs in this one process (tests) is it a folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_morphspark_dir", None) or f"file://{tempfile.mkdtemp(prefix='morphspark-')}"
        spark._morphspark_dir = base
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made(spark)[0].append(path)
    return path


def _made(spark: SparkSession) -> tuple[list[str], list[str]]:
    """Folders and tables that this session has made."""
    if not hasattr(spark, "_morphspark_made"):
        spark._morphspark_made = ([], [])
    return spark._morphspark_made


def clean_up(spark: SparkSession) -> int:
    """Delete what the operators have stored in this session; results that still read it must be written before. Returns how many went."""
    paths, tables = _made(spark)
    n = len(paths) + len(tables)
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    for name in tables:
        spark.sql(f"drop table if exists {name}")
    paths.clear()
    tables.clear()
    return n


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *stems: str) -> list[str]:
    """A column name for each stem that is none of ``taken`` (letter case does not tell names apart)."""
    known = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name in known:
            name += "_"
        known.add(name)
        out.append(name)
    return out


def apart(df: DataFrame, key: str) -> DataFrame:
    """An aggregate by ``key``, dealt by another hash: a join back by the key then has an exchange on
    either side, so that Spark can split the rows of a hot key (it can't below an aggregate's own exchange)."""
    return df.repartition(F.xxhash64(key))


#: What a Python worker keeps from task to task: functions that give it up.
KEPT: list[Callable[[], None]] = []


def freed(run: Callable, keeps: bool = False) -> Callable:
    """``run`` (for mapInArrow), which in the end gives the memory back that a reused Python worker would keep.

    What tasks keep for each other (KEPT) goes too, unless this task is one of them.
    """

    def wrapped(batches):
        if not keeps:
            from morphspark.llm import common  # this function travels by value, the worker's own list is meant

            for give_up in common.KEPT:
                give_up()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def text_key(text: Column) -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def distinct_texts(docs: DataFrame, tag: str) -> DataFrame:
    """One row per different text: th, text, copies; a table bucketed by th.

    Copies are folded before the shuffle, so a large group of copies is one row
    per task. Later joins on th move only their other side.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    once = docs.select(text_key(F.col("text")).alias("th"), text.alias("text")).groupBy("th").agg(
        F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (once.repartition(n, "th").write.option("compression", "zstd").bucketBy(n, "th").sortBy("th").saveAsTable(name))
    _made(spark)[1].append(name)
    return spark.table(name)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty, lower: in lower case."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=texts.offset + n + 1)[texts.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="left"))
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


def separators(keep: str | None = None) -> np.ndarray:
    """Table of the bytes that end a word: ASCII white space, or with keep='alnum' every ASCII byte but letters and digits."""
    table = np.zeros(256, dtype=bool)
    if keep is None:
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[lo:hi + 1] = False
    return table


def word_spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document where its words start in them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    lens = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))
    h = mix(lens.astype(np.uint64) * K1 + np.uint64(seed))
    todo, at = np.arange(len(starts)), 0
    while True:
        todo = todo[lens[todo] > at]
        if not len(todo) or at >= LONG_WORD:
            break
        left = np.minimum(lens[todo] - at, 8).astype(np.uint64)
        piece = eights[starts[todo] + at] & (FULL >> (np.uint64(64) - np.uint64(8) * left))
        h[todo] = mix((h[todo] ^ piece) * K1)
        at += 8
    for i in todo:
        h[i] = xxhash.xxh64_intdigest(buf[starts[i]:ends[i]].tobytes(), seed=seed + 1)
    return h


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 0x41) & (buf <= 0x5A)
    return np.where(up, buf + np.uint8(32), buf)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (position i: words i to i+n-1)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * K1 + h[k:len(h) - n + 1 + k])
    return out

"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (ASCII letters in lower case); a shorter text
is one shingle. A shingle weighs tf * idf, idf = 1 + SPAN * ln(N / df) / ln(N) over
the N different texts. Document frequencies are counted in a count-min sketch of
``DEPTH`` rows whose width follows the corpus up to ``2**SLOTS`` (so its size is
bounded at any corpus size; an estimate is too great by about all shingles / width,
which only moves the idf of shingles rarer than that).

1. Texts are folded to one row for all their exact copies.
2. ``BANDS * ROWS`` improved consistent weighted samples per text; a band's
   samples are its bucket. Buckets with the same members are kept once (compared by
   count and sum of hashes, so nothing is gathered).
3. Buckets are verified in blocks of at most about ``BLOCK`` texts. Inside a block
   every pair that is not yet connected is compared by its exact weighted Jaccard
   similarity; a block yields a spanning set of links, never all pairs. A bucket
   of several blocks sends the best-linked text of each component (a text without
   links is its own) on to the next level, until one block holds what is left or
   after ``LEVELS`` levels.
4. Links become classes by distributed connected components.
5. A bucket of several blocks and classes may hold links that no block has seen.
   Which texts can have one follows from the bucket's consensus c, the shingles
   of at least half of its texts. Let M and R be the weights that a text lacks of
   c and has beyond it, e = M + t R, and s the weight that two texts' differences
   from c share. Then (t the threshold, W the weight of c)

       J(x, y) >= t  exactly if  e(x) + e(y) <= (1 - t) W + (1 + t) s.

   s is at most the part S of a text's differences that another text of the bucket
   has too, so a link needs e(y) <= g(x) and e(x) <= g(y), g = (1 + t) S - e + (1 - t) W.
   Texts that meet no such partner drop out. Those left are cut into cells by g, and a
   text outside the bucket's largest class meets, block by block, the cells that may
   hold a partner. So no link of a bucket is lost.

Two texts are linked if their weighted Jaccard similarity is ``THRESHOLD`` or more.
A large group of near copies lowers the idf of what it shares; SPAN keeps weights
within 1 and 1.25, so that such a group is not torn: a pair of plain Jaccard
similarity 0.84 or more is linked whatever its idf.

A pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8**3)**10 < 0.1 %.

Texts without words are alike only if equal. Null text is empty. Exact copies and
repeated rows share a class; class_id is the smallest doc_id (null if all are). An
empty table gives an empty result. Other columns, whatever their names, are kept by
drop_near_duplicates and ignored by near_duplicates. A very long text is one row, whose
shingles are worked on at once. Ties (equal ids) are told apart by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common
from morphspark.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK, LEVELS = 5, 0.8, 10, 3, 128, 4
SLOTS, DEPTH, SPAN = 19, 2, 0.25
#: Shingles of a bucket that one task holds in step 5, and room for rounding there.
SLICE, SLACK = 1 << 20, 1e-6
#: Cells of a bucket there, at most.
CELLS = 64
PART = 1 << 20
SEP = common.separators()


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text: hashes (56 bits), counts, offsets per text."""
    starts, ends, woff = common.word_spans(buf, offsets, SEP)
    h = common.word_hashes(common.lower_ascii(buf), starts, ends)
    n = np.diff(woff)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= size:
        g = common.ngram_hashes(h, size)
        whole = doc[:len(g)] == doc[size - 1:]
        g, gdoc = g[whole], doc[:len(g)][whole]
    else:
        g, gdoc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        g = np.concatenate([g, np.array([common.ngram_hashes(h[woff[i]:woff[i + 1]], int(n[i]))[0] for i in short], np.uint64)])
        gdoc = np.concatenate([gdoc, short])
    order = np.lexsort((g, gdoc)) if len(short) or len(n) > 256 else None
    if order is None:
        key = (gdoc.astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))
        key.sort()
        g, gdoc = (key << np.uint64(8)) >> np.uint64(8), (key >> np.uint64(56)).astype(np.int64)
    else:
        g, gdoc = (g >> np.uint64(8))[order], gdoc[order]
    if not len(g):
        return g, np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (gdoc[1:] != gdoc[:-1])]))
    return g[new], np.diff(np.append(new, len(g))), np.searchsorted(gdoc[new], np.arange(len(n) + 1))


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slot of each shingle in each row of the sketch."""
    own = [g, *(common.mix(g + np.uint64(d)) >> np.uint64(8) for d in range(1, DEPTH))]
    return [(x >> np.uint64(56 - bits)).astype(np.int64) for x in own]


def document_frequencies(texts: DataFrame, most: int = SLOTS) -> tuple[np.ndarray, int]:
    """(DEPTH x slots counts of different texts by slot, all different texts)."""
    known = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bits = min(most, max(12, int(known[1] or 0).bit_length() - 2))  # a slot or two for each shingle
    size, cut = DEPTH << bits, 64

    def count(batches):
        sketch = np.zeros((DEPTH, 1 << bits), np.int64)
        for batch in batches:
            for _, _, buf, offsets in common.chunks(batch, "text", PART):
                g, _, _ = shingles(buf, offsets)
                for row, slots in zip(sketch, _slots(g, bits)):
                    row += np.bincount(slots, minlength=1 << bits)
        pieces, part = np.split(sketch.ravel(), cut), TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(range(cut), pa.int32()), pa.array([part] * cut, pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in pieces])], ["slice", "part", "counts"])

    def total(table: pa.Table) -> pa.Table:
        acc = np.zeros(size // cut, np.int64)
        for x in table.column("counts"):
            acc += np.frombuffer(x.as_buffer(), np.int64 if len(x.as_buffer()) == 8 * len(acc) else np.int32)
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([acc.tobytes()])})

    schema = "slice int, part int, counts binary"
    parts = texts.select("text").mapInArrow(common.freed(count), schema).groupBy("slice", "part").applyInArrow(total, schema).groupBy("slice").applyInArrow(total, schema)
    sketch = np.zeros((cut, size // cut), np.int64)
    for r in parts.collect():  # 64 rows of bounded size
        sketch[r.slice] = np.frombuffer(r.counts, np.int64)
    return sketch.reshape(DEPTH, 1 << bits), int(known[0])


def idf(sketch: np.ndarray, docs: int) -> np.ndarray:
    """DEPTH x slots; a shingle's idf is the greatest of its slots' (the least count)."""
    return (1.0 + SPAN * np.log(max(docs, 1) / np.clip(sketch, 1, max(docs, 1))) / np.log(max(docs, 2))).astype(np.float32)


def rarity(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The idf of each shingle."""
    slots = _slots(g, table.shape[1].bit_length() - 1)
    return np.max([row[x] for row, x in zip(table, slots)], axis=0) if len(g) else np.zeros(0, np.float32)


def weigh(g: np.ndarray, tf: np.ndarray, table: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * rarity(g, table)


def samples(g: np.ndarray, w: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each text (all have shingles) ``count`` hashes of (shingle, level)."""
    lnw, out = np.log(w), np.empty((len(off) - 1, count), np.uint32)
    low, unit = np.uint64(0xFFFFFF), np.float32(2.0 ** -24)
    half = np.float32(2.0 ** -25)
    for k in range(count):
        x = common.mix(g ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        y = common.mix(x + common.K1)
        u = lambda z, s: ((z >> np.uint64(s)) & low).astype(np.float32) * unit + half
        r = -np.log(u(x, 40) * u(x, 16))
        beta = (x & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0 ** -16)
        t = np.floor(lnw / r + beta)
        ln_a = np.log(-np.log(u(y, 40) * u(y, 16))) - r * (t - beta) - r
        bits = ln_a.view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))  # the order of the floats
        what = common.mix(x + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | what, off[:-1]).astype(np.uint32)
    return out


def signatures(texts: DataFrame, table: np.ndarray, bands: int, rows: int) -> DataFrame:
    """th, size (shingles) and buckets array<bigint> (one a band) of every text with words."""
    told = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in common.chunks(batch, "text", PART):
                g, tf, off = shingles(buf, offsets)
                has = np.flatnonzero(np.diff(off))
                if not len(has):
                    continue
                s = samples(g, weigh(g, tf, told.value), np.append(off[has], len(g)), bands * rows).astype(np.uint64)
                h = np.zeros((len(has), bands), np.uint64)
                for b in range(bands):
                    acc = np.full(len(has), b, np.uint64)
                    for k in range(rows):
                        acc = common.mix(acc * common.K1 + s[:, b * rows + k])
                    h[:, b] = acc
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(has + lo)), pa.array(np.add.reduceat(tf, off[has]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * bands + 1, bands, dtype=np.int32)), pa.array(h.ravel().view(np.int64)))], ["th", "size", "buckets"])

    return texts.select("th", "text").mapInArrow(common.freed(run), "th binary, size bigint, buckets array<bigint>")


def nearness(texts: list[str], table: np.ndarray, threshold: float):
    """(count, near): shingles per text; near(i, first) gives the texts from ``first`` on that are linked to text i."""
    raw = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    g, tf, off = shingles(np.frombuffer(b"".join(raw), np.uint8), offsets)
    w = weigh(g, tf, table).astype(np.float64)
    n = len(texts)
    total = np.add.reduceat(np.append(w, 0.0), off[:-1]) * (np.diff(off) > 0)
    count = np.diff(off)
    _, ids = np.unique(g, return_inverse=True)
    mine = np.zeros(ids.max() + 1 if len(ids) else 1)
    owner = np.repeat(np.arange(n), count)

    def near(i: int, first: int) -> np.ndarray:
        own = slice(off[i], off[i + 1])
        mine[ids[own]] = w[own]
        rest = slice(off[first], len(g))
        there = mine[ids[rest]]
        hit = there > 0
        least = np.bincount(owner[rest][hit], np.minimum(there[hit], w[rest][hit]), n)
        mine[ids[own]] = 0.0
        linked = least >= threshold * (total[i] + total - least) - 1e-9
        linked &= count > 0
        linked[:first] = False
        linked[i] = False
        return np.flatnonzero(linked)

    return count, near


def block_links(texts: list[str], table: np.ndarray, threshold: float):
    """(links, degree, root): a spanning set of verified links of a block, links seen per text, component per text."""
    count, near = nearness(texts, table, threshold)
    n = len(texts)
    root, degree, links = np.arange(n), np.zeros(n, np.int64), []
    for i in range(n - 1):
        if not count[i] or (root[i + 1:] == root[i]).all():
            continue
        found = near(i, i + 1)
        degree[i] += len(found)
        degree[found] += 1
        for j in found:
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links, degree, root


def verified_links(texts: DataFrame, members: DataFrame, table: np.ndarray, threshold: float, block: int, levels: int) -> DataFrame:
    """members (bucket, n, th) -> links a, b (keys of texts)."""
    told = texts.sparkSession.sparkContext.broadcast(table)
    schema = "bucket bigint, th binary, other binary"

    def verify(t: pa.Table) -> pa.Table:
        """Links (th, other), and with other null the texts that go on to the next level."""
        order = np.argsort(np.array([x.as_py() for x in t.column("th")], dtype=object), kind="stable")
        th = [t.column("th")[int(i)].as_py() for i in order]
        keep = [k for k in range(len(th)) if not k or th[k] != th[k - 1]]
        th = [th[k] for k in keep]
        links, degree, root = block_links([t.column("text")[int(order[k])].as_py() for k in keep], told.value, threshold)
        out = [(th[i], th[j]) for i, j in links]
        if t.column("blocks")[0].as_py() > 1:
            for r in np.unique(root):
                inside = np.flatnonzero(root == r)
                out.append((th[inside[degree[inside].argmax()]], None))
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int64()), "th": pa.array([x for x, _ in out], pa.binary()), "other": pa.array([y for _, y in out], pa.binary())})

    links, now = None, members
    for level in range(levels):
        dealt = now.withColumn("blocks", F.ceil(F.col("n") / block).cast("bigint")).withColumn("one", F.pmod(F.xxhash64("th", F.lit(level)), "blocks"))
        with_text = dealt.select("bucket", "blocks", "one", "th").join(texts.select("th", "text"), "th")
        out = common.stored(with_text.groupBy("bucket", "one").applyInArrow(verify, schema), "links")
        found = out.where("other is not null").select(F.col("th").alias("a"), F.col("other").alias("b"))
        links = found if links is None else links.union(found)
        going = out.where("other is null").select("bucket", "th")
        if level == levels - 1 or not going.head(1):
            break
        now = common.stored(going.join(going.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket"), "members")
    return links


def _profiles(texts: DataFrame, members: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """members (bucket, slices, th) -> bucket, th, e, g (see the module): what a link of a text needs of its partner.

    The shingles of a bucket are dealt over ``slices`` groups by their hash; a task packs what it
    has of a group into one row, and each group tells its part of every text's e and g.
    """
    told = texts.sparkSession.sparkContext.broadcast(table)
    names = ["bucket", "slice", "keys", "sizes", "shingles", "weights"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def packed_rows(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
        out = [(bucket, one, [p[0] for p in parts], [len(p[1]) for p in parts], np.concatenate([p[1] for p in parts]).tobytes(), np.concatenate([p[2] for p in parts]).tobytes())
               for (bucket, one), parts in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def pack(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in batches:
            th, asked = batch.column(0).to_pylist(), batch.column(2)
            for lo, hi, buf, offsets in common.chunks(batch, "text", PART):
                g, tf, off = shingles(buf, offsets)
                unit = rarity(g, told.value)
                for i in range(lo, hi):
                    own = slice(off[i - lo], off[i - lo + 1])
                    # The k-th occurrence of a shingle is an element of its own, so texts are sets.
                    nth = np.arange(tf[own].sum()) - np.repeat(np.cumsum(tf[own]) - tf[own], tf[own])
                    x, w = np.repeat(g[own], tf[own]), np.repeat(unit[own], tf[own])
                    x = np.where(nth > 0, common.mix(x + nth.astype(np.uint64) * common.K1), x)
                    for b in asked[i].as_py():
                        part = (x % np.uint64(b["slices"])).astype(np.int64)
                        for k in range(b["slices"]):
                            held.setdefault((b["bucket"], k), []).append((th[i], x[part == k], w[part == k]))
                        size += len(x)
                    if size > SLICE:
                        yield packed_rows(held)
                        held, size = {}, 0
        if held:
            yield packed_rows(held)

    def profile(t: pa.Table) -> pa.Table:
        keys = [k for x in t.column("keys").to_pylist() for k in x]
        n, sizes = len(keys), np.array([k for x in t.column("sizes").to_pylist() for k in x], np.int64)
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("shingles")])
        w = np.concatenate([np.frombuffer(b.as_buffer(), np.float32) for b in t.column("weights")]).astype(np.float64)
        owner = np.repeat(np.arange(n), sizes)
        _, first, ids, df = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
        weight, agreed = w[first], 2 * df >= n
        last, alone = agreed & (df == n - 1), ~agreed & (df == 1)  # one text differs here, alone
        has = lambda what: np.bincount(owner, w * what[ids], n)
        whole = weight[agreed].sum()
        lacks, more = whole - has(agreed), has(~agreed)
        shared = lacks - (weight[last].sum() - has(last)) + more - has(alone)
        e = lacks + threshold * more
        g = (1 + threshold) * shared - e + (1 - threshold) * whole
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * n, pa.int64()), "th": pa.array(keys, pa.binary()), "e": pa.array(e), "g": pa.array(g)})

    asked = members.groupBy("th").agg(F.collect_list(F.struct("bucket", "slices")).alias("asked"))  # at most one a band
    packed = texts.select("th", "text").join(asked, "th").mapInArrow(common.freed(pack), "bucket bigint, slice bigint, keys array<binary>, sizes array<bigint>, shingles binary, weights binary")
    parts = packed.groupBy("bucket", "slice").applyInArrow(profile, "bucket bigint, th binary, e double, g double")
    return parts.groupBy("bucket", "th").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))


def _partners(rows: DataFrame) -> DataFrame:
    """rows (bucket, th, root, minor, e, g) that may link a minor text (outside the largest class, x) with another one (y)."""
    rows = rows.select("*", F.col("minor").alias("x"), F.lit(True).alias("y"))
    for side, other in (("y", "x"), ("x", "y"), ("y", "x")):
        reach = common.apart(rows.where(other).groupBy("bucket").agg(F.min("e").alias("least"), F.max("g").alias("most")), "bucket")
        meets = (F.col("g") + SLACK >= F.col("least")) & (F.col("e") <= F.col("most") + SLACK)
        rows = rows.join(reach, "bucket").withColumn(side, F.col(side) & meets).drop("least", "most")
    return rows.where("x or y")


def _dealt(rows: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """(xs, ys): minor texts and possible partners in the cells where they meet, with the blocks of either side there.

    A bucket's partners are cut into cells of about ``half`` (at most ``CELLS``) by g. A minor text goes
    to the cells that hold a g of its e or more and an e of its g or less.
    """
    cuts = F.percentile_approx(F.when(F.col("y"), F.col("g")), [(k + 1) / CELLS for k in range(CELLS - 1)], 10_000)
    known = rows.groupBy("bucket").agg(cuts.alias("cuts"), F.greatest(F.lit(1), F.floor(CELLS * half / F.greatest(F.count_if("y"), F.lit(1)))).cast("int").alias("stride"))
    known = known.select("bucket", F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % F.col("stride") == 0)).alias("cuts"))
    at = lambda c: F.size(F.filter("cuts", lambda x: x <= c))
    placed = common.stored(rows.join(common.apart(known, "bucket"), "bucket").select("bucket", "th", "root", "e", "g", "x", "y", at(F.col("g")).alias("cell"), at(F.col("e") - SLACK).alias("low"), F.size("cuts").alias("high")), "placed")
    blocks = F.ceil(F.count(F.lit(1)) / half).cast("bigint")
    cells = placed.where("y").groupBy("bucket", "cell").agg(blocks.alias("all"), F.min("e").alias("least"))
    asked = placed.where("x and low <= high").select("bucket", "th", "root", "e", "g", F.explode(F.sequence("low", "high")).alias("cell"))
    xs = common.stored(asked.join(common.apart(cells, "bucket"), ["bucket", "cell"]).where(F.col("g") + SLACK >= F.col("least")).drop("least"), "minor")
    few = common.apart(xs.groupBy("bucket", "cell", "all").agg(blocks.alias("few")), "bucket")
    return xs.join(few.drop("all"), ["bucket", "cell"]), placed.where("y").join(few, ["bucket", "cell"])


def cross_links(texts: DataFrame, members: DataFrame, found: DataFrame, table: np.ndarray, threshold: float, block: int) -> DataFrame | None:
    """Links a, b (roots of classes) between texts of one bucket in different classes of ``found``; None if no bucket can hold one.

    Buckets of one block were compared whole, and those of one class have nothing to add.
    """
    told = texts.sparkSession.sparkContext.broadcast(table)
    rooted = members.where(F.col("n") > block).join(found.select(F.col("node").alias("th"), "root"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    rows = common.stored(rooted.select("bucket", "th", "size", "root"), "rooted")
    sizes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("size").alias("all")).where("roots > 1")
    mixed = mixed.select("bucket", F.col("main.root").alias("main"), F.ceil(F.col("all") / SLICE).cast("bigint").alias("slices"))
    dealt = common.stored(rows.join(common.apart(mixed, "bucket"), "bucket").select("bucket", "th", "root", (F.col("root") != F.col("main")).alias("minor"), "slices"), "mixed")
    if not dealt.head(1):
        return None
    known = common.stored(dealt.join(_profiles(texts, dealt, table, threshold), ["bucket", "th"]), "profiles")
    rows = common.stored(_partners(known), "partners")
    xs, ys = _dealt(rows, max(block // 2, 1))
    if not xs.head(1):
        return None

    def meet(t: pa.Table) -> pa.Table:
        few = t.column("minor").to_numpy()
        links: list[tuple[bytes, bytes]] = []
        roots = t.column("root").to_pylist()
        known = {r: k for k, r in enumerate(sorted(set(roots)))}
        label = np.array([known[r] for r in roots])
        if few.any() and len(known) > 1:
            e, g = t.column("e").to_numpy(), t.column("g").to_numpy() + SLACK
            count, near = nearness(t.column("text").to_pylist(), told.value, threshold)
            for i in np.flatnonzero(few & (count > 0)):
                if not ((label != label[i]) & (e <= g[i]) & (g >= e[i])).any():
                    continue
                for j in near(i, 0):
                    if label[j] != label[i]:
                        links.append((roots[i], roots[j]))
                        label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    to = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    where = lambda c: F.pmod(F.xxhash64("th", F.lit(-1)), F.col(c))
    every = ys.select("bucket", "cell", "th", "root", "e", "g", F.lit(False).alias("minor"), where("all").alias("one"), to("few").alias("two"))
    minor = xs.select("bucket", "cell", "th", "root", "e", "g", F.lit(True).alias("minor"), to("all").alias("one"), where("few").alias("two"))
    with_text = every.union(minor).join(texts.select("th", "text"), "th")
    return common.stored(with_text.groupBy("bucket", "cell", "one", "two").applyInArrow(meet, "a binary, b binary"), "cross")


def bucket_members(signed: DataFrame) -> DataFrame:
    """bucket, n, th, size: every text of every bucket of several texts, buckets with the same texts once."""
    entries = signed.select("th", "size", F.posexplode("buckets").alias("band", "hash")).select("th", "size", F.xxhash64("band", "hash").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("th").cast("decimal(38,0)")).alias("members")).where("n > 1")
    kept = sizes.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return entries.join(kept, "bucket").select("bucket", "n", "th", "size")


def classes(texts: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """node, root (keys of texts) for every text that is near another one."""
    table = idf(*document_frequencies(texts))
    members = common.stored(bucket_members(common.stored(signatures(texts, table, bands, rows), "signatures")), "members")
    found = components(verified_links(texts, members, table, threshold, block, levels))
    cross = cross_links(texts, members, found, table, threshold, block)
    if cross is None or not cross.head(1):
        return found
    joined = components(cross)
    top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return found.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(joined.join(found, "node", "left_anti").select("node", "root"))


def _with_class(docs: DataFrame, found: DataFrame, key: str, root: str) -> DataFrame:
    """docs with the columns key (of its text) and root (the key of its class)."""
    keyed = docs.withColumn(key, common.text_key(F.col("text")))
    back = found.select(F.col("node").alias(key), F.col("root").alias(root))
    return keyed.join(back, key, "left").withColumn(root, F.coalesce(root, key))


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its class) and class_size (its rows)."""
    found = classes(common.distinct_texts(docs.select("text"), "texts"), **params)
    rows = common.stored(_with_class(docs.select("doc_id", "text"), found, "th", "root").select("doc_id", "root"), "classes")
    known = common.apart(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "root")
    return rows.join(known, "root").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One row of each class stays: the one of the smallest doc_id (null last), then text key, then other columns' hash."""
    texts = common.distinct_texts(docs.select("text"), "texts")
    found = classes(texts, **params)
    key, root, empty, row = common.free_names(docs.columns, "key", "root", "empty", "row")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = _with_class(docs.select(*others, "text", F.col("text").isNull().alias(empty)), found, key, root).drop("text")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", key, F.xxhash64(*others))
    kept = rows.groupBy(root).agg(F.min_by(F.struct(key, empty, *others), first).alias(row)).select(f"{row}.*")
    joined = kept.join(texts.select(F.col("th").alias(key), "text"), key)
    return joined.select([F.when(~F.col(empty), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])

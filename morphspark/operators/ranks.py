"""Places of rows in a total order, and totals up to a row, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose keys bound the ranges, one less than there are ranges; a fixed number at any size.
BOUNDS = 255


#: Aggregates that can be added up over parts, and how two parts (either may be null) make one.
MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def _bounds(keyed: DataFrame, key: str, name: str, bounds: int) -> DataFrame:
    """One row: the keys of the rows with the smallest hashes, in order."""
    return keyed.select(key).orderBy(F.xxhash64(key), key).limit(bounds).agg(F.array_sort(F.collect_list(key)).alias(name))


def in_ranges(keyed: DataFrame, chosen: DataFrame, key: str, cut: str) -> DataFrame:
    """keyed with the column ``cut``: the number of bounds (fewer than 65,536) below the row's key, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(16))])
    steps = F.filter(steps, lambda s: s <= F.size(cut))
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(cut, n + s - 1) < F.col(f"`{key}`"), n + s).otherwise(n))
    return keyed.crossJoin(F.broadcast(chosen)).withColumn(cut, below)


def global_rank(df: DataFrame, order: list[Column], name: str, bounds: int = BOUNDS) -> DataFrame:
    """df with the column ``name``: the 1-based place of each row by ``order``.

    The keys of ``bounds`` rows (those of the smallest hashes, so the same ones in every run) cut the
    order into ranges. Rows are ranked inside their range, one exchange; the sizes of the
    ranges, one row, are then added up to the ranges' first places.
    """
    key, cut, size = f"{name}$key", f"{name}$range", f"{name}$sizes"
    keyed = df.withColumn(key, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    ranged = in_ranges(keyed, _bounds(keyed, key, cut, bounds), key, cut)
    sizes = ranged.groupBy(cut).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct(F.col(f"`{cut}`").alias("range"), "n")).alias(size))
    inside = F.row_number().over(Window.partitionBy(cut).orderBy(key))
    before = F.aggregate(F.filter(size, lambda s: s["range"] < F.col(f"`{cut}`")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    return ranged.withColumn(name, inside).crossJoin(F.broadcast(sizes)).withColumn(name, F.col(f"`{name}`") + before).drop(key, cut, size)


def totals_upto(asking: DataFrame, given: DataFrame, groups: list[str], how: str, op: str, spread: bool = True, bounds: int = BOUNDS, less: tuple[str, ...] = ()) -> DataFrame:
    """asking with the column ``total``: ``how`` over the ``x`` of the given rows of its group with ``given.v op asking.v``.

    Both have the columns ``groups`` and ``v``, without nulls, and ``tie``, by which equal rows are told apart. Rows of both sides
    are ordered by group and v, so a total is one pass over a sorted group, however many pairs it stands for. With ``spread`` the
    order is cut into ranges, else a group is one task's; only then rows of equal columns ``less`` can be taken off a sum. A range's total of a group counts for those behind it: only
    the group at a range's end goes on behind it, so each range hands on one total.
    """
    fn, merge = MERGE[how]
    up, kind = op in ("<", "<="), given.agg(fn("x")).schema[0].dataType
    # of equal v the given rows come first if they count
    first = (0 if up else 1) if op in ("<=", ">=") else (1 if up else 0)
    given = given.withColumn("side", F.lit(first))
    rows = asking.withColumn("side", F.lit(1 - first)).withColumn("asks", F.lit(True)).unionByName(given.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    order = [F.col("v"), F.col("side")] if up else [F.col("v").desc(), F.col("side").desc()]
    by = [*groups]
    if spread:
        key = F.struct(*groups, "v", "side", "tie")
        rows = rows.withColumn("key", key)
        chosen = _bounds(rows, "key", "range", bounds)
        rows, by = in_ranges(rows, chosen, "key", "range").drop("key"), ["range", *groups]
        parts = rows.where("not asks").groupBy(*by).agg(fn("x").alias("part"))
        end = F.struct(*groups) if groups else F.lit(0)
        parts = parts.groupBy("range").agg((F.max_by if up else F.min_by)(F.struct(*groups, "part"), end).alias("e")).select(F.col("range").alias("from"), "e.*")
        later = parts.sparkSession.range(bounds + 1).select(F.col("id").cast("int").alias("range"))
        before = parts.join(F.broadcast(later), F.col("from") < F.col("range") if up else F.col("from") > F.col("range")).groupBy(*by).agg(fn("part").alias("before"))

    def upto(columns: list[str]) -> Column:
        return fn("x").over(Window.partitionBy(*columns).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    total = upto(by) - F.coalesce(upto([*by, *less]), F.lit(0)) if less else upto(by)
    rows = rows.withColumn("total", total).where("asks")
    if spread:
        rows = rows.join(F.broadcast(before), by, "left").withColumn("total", merge(F.col("total"), F.col("before")))
    return rows.withColumn("total", F.col("total").cast(kind))

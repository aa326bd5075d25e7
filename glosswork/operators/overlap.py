"""Joins of intervals and of rects that overlap, as relations: many selections against many glyphs of a page, spans against lines.

Boxes are laid on grids of doubling width, each on the finest one whose cells are no smaller than its longest side, so it meets
two cells a dimension at most however long it is. Two boxes meet on the coarser of their grids: each box is also laid on the coarser
grids that boxes of its key are on. A pair counts in the cell that holds its lower corner only, so it comes once. Cells are join
keys; one with many boxes on the left is split, its right boxes going to each part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 4096
SIDES = ("l", "r")


def _finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _level(longest: Column, cell: float) -> Column:
    """The finest grid on which a box this long meets at most two cells a dimension."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(cell)) / cell))).cast("int")


def _cell(x: Column, level: Column, cell: float) -> Column:
    return F.floor(x / (cell * F.pow(F.lit(2.0), level))).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bounds: list[tuple[str, str]], cell: float, tolerance: float = 0.0, touching: bool = True, hot: int = HOT) -> DataFrame:
    """keys, l and r: structs of all columns of each pair of rows that agree in the keys and overlap in every dimension.

    bounds names the columns of the low and high end of each dimension in both tables; ends that are out of order are exchanged. Boxes
    overlap if left.low <= right.high + tolerance and right.low <= left.high + tolerance in each (strictly, unless touching
    counts). Rows with a null key, or an end that is null or not finite, overlap nothing; equal rows are rows of their own. cell is the
    width of the finest grid: about the size of common boxes.
    """
    low, high = (lambda d: f"__low{d}"), (lambda d: f"__high{d}")
    n = len(bounds)

    def laid(rows: DataFrame, side: str) -> DataFrame:
        fine = reduce(and_, [_finite(F.col(c).cast("double")) for b in bounds for c in b] + [F.col(k).isNotNull() for k in keys])
        wider = tolerance if side == "l" else 0.0
        ends = {}
        for d, (a, b) in enumerate(bounds):
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            ends |= {low(d): F.least(x, y) - wider, high(d): F.greatest(x, y) + wider}
        out = rows.filter(fine).select(*keys, F.struct(*rows.columns).alias(side), *[c.alias(k) for k, c in ends.items()])
        return out.withColumn("__own", _level(F.greatest(*[F.col(high(d)) - F.col(low(d)) for d in range(n)], F.lit(cell)), cell))

    a, b = laid(left, "l"), laid(right, "r")
    levels = a.select(*keys, "__own").unionByName(b.select(*keys, "__own")).groupBy(*keys).agg(F.sort_array(F.collect_set("__own")).alias("__levels"))

    def spread(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.join(levels, keys).withColumn("__level", F.explode(F.filter("__levels", lambda v: v >= F.col("__own")))).drop("__levels")
        for d in range(n):
            rows = rows.withColumn(f"__cell{d}", F.explode(F.sequence(_cell(F.col(low(d)), F.col("__level"), cell), _cell(F.col(high(d)), F.col("__level"), cell))))
        return rows.withColumnsRenamed({c: f"{c}_{side}" for c in rows.columns if c.startswith(("__low", "__high", "__own"))})

    at = [*keys, "__level", *[f"__cell{d}" for d in range(n)]]
    a, b = spread(a, "l"), spread(b, "r")
    parts = a.groupBy(*at).count().filter(F.col("count") > hot).select(*at, F.ceil(F.col("count") / hot).cast("int").alias("__parts"))
    many = F.coalesce("__parts", F.lit(1))
    a = a.join(parts, at, "left").withColumn("__part", F.pmod(F.xxhash64("l", F.monotonically_increasing_id()), many).cast("int")).drop("__parts")
    b = b.join(parts, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
    rows = a.join(b, [*at, "__part"])
    tests = [F.col("__level") == F.greatest("__own_l", "__own_r")]
    for d in range(n):
        ends = [(F.col(f"{low(d)}_l"), F.col(f"{high(d)}_r")), (F.col(f"{low(d)}_r"), F.col(f"{high(d)}_l"))]
        tests += [x <= y if touching else x < y for x, y in ends]
        tests.append(F.col(f"__cell{d}") == _cell(F.greatest(f"{low(d)}_l", f"{low(d)}_r"), F.col("__level"), cell))
    return rows.filter(reduce(and_, tests)).select(*keys, "l", "r")

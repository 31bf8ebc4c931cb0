"""Cells in rectangles: a join of points with two-dimensional ranges by equal keys.

Both sides of a rectangle are cut into the fewest dyadic intervals (those of 2 ** level numbers that begin at a multiple of it): at
most two of each level. A point lies in one interval of each level, and in exactly one piece of each rectangle that holds it. So points
and rectangles meet by equal pieces, each pair once, and no pair is formed that is not in the result: what is written follows
the result, not the product of a sheet's cells and its ranges. Points are written once for each pair of levels that some rectangle has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of numbers up to 2 ** 20 (rows of a sheet) and 2 ** 14 (its columns).
ROW_LEVELS, COLUMN_LEVELS = 21, 15


def dyadic(first: Column, last: Column, levels: int) -> Column:
    """array<struct<level, node>>: the dyadic intervals, of `levels` levels at most, that make up first to last (from 0)."""
    none = F.expr("cast(array() as array<struct<level:int,node:bigint>>)")
    start = F.struct(first.cast("bigint").alias("a"), (last + 1).cast("bigint").alias("b"), none.alias("out"))
    at = lambda level, node: F.struct(level.cast("int").alias("level"), node.alias("node"))

    def climb(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        low, high = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        top = level == levels - 1
        all_ = F.transform(F.when(a < b, F.sequence(a, b - 1)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda n: at(level, n))
        left = F.when(low, F.array(at(level, a))).otherwise(none)
        right = F.when(high & (~low | (b - 1 > a)), F.array(at(level, b - 1))).otherwise(none)
        step = F.struct(F.floor((a + low.cast("int")) / 2).alias("a"), F.floor((b - high.cast("int")) / 2).alias("b"), F.concat(s["out"], left, right).alias("out"))
        return F.when(top, F.struct(b.alias("a"), b.alias("b"), F.concat(s["out"], all_).alias("out"))).otherwise(step)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, climb, lambda s: s["out"])


def _pieces(ranges: DataFrame, row_levels: int, column_levels: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(`ranges` with a row for each dyadic piece, the pairs of levels that there are)."""
    spans = [F.coalesce(F.max(F.col(z).cast("bigint") - F.col(a).cast("bigint") + 1), F.lit(1)) for a, z in (("row1", "row2"), ("col1", "col2"))]
    high, wide = (max(1, int(x).bit_length()) if x > 0 else 1 for x in ranges.agg(*spans).first())  # no range has pieces of more levels
    spread = ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ranges.columns)
    both = spread.withColumns({"_rs": dyadic(F.col("row1"), F.col("row2"), min(row_levels, high)), "_cs": dyadic(F.col("col1"), F.col("col2"), min(column_levels, wide))})
    pieces = both.withColumn("_r", F.explode("_rs")).withColumn("_c", F.explode("_cs"))
    pieces = pieces.select(*ranges.columns, F.col("_r.level").alias("_rl"), F.col("_r.node").alias("_rn"), F.col("_c.level").alias("_cl"), F.col("_c.node").alias("_cn"))
    levels = [(r["_rl"], r["_cl"]) for r in pieces.select("_rl", "_cl").distinct().collect()]  # row_levels x column_levels at most
    # Spark takes a table of pieces for as small as its ranges and would send it to the driver
    return pieces.hint("merge"), sorted(levels) or [(0, 0)]


def _placed(cells: DataFrame, levels: list[tuple[int, int]], row: str, col: str) -> DataFrame:
    """`cells` with a row for each pair of levels and the piece in which they lie there."""
    own = F.array(*[F.struct(F.lit(a).alias("rl"), F.lit(b).alias("cl")) for a, b in levels])
    return cells.withColumn("_l", F.explode(own)).withColumns({
        "_rl": F.col("_l.rl"), "_cl": F.col("_l.cl"), "_rn": F.expr(f"shiftright(cast({row} as bigint), _l.rl)"), "_cn": F.expr(f"shiftright(cast({col} as bigint), _l.cl)")}).drop("_l")


_PIECE = ["_rl", "_cl", "_rn", "_cn"]


def cells_in_ranges(cells: DataFrame, ranges: DataFrame, by: list[str], row: str = "row", col: str = "col", row_levels: int = ROW_LEVELS,
    column_levels: int = COLUMN_LEVELS) -> DataFrame:
    """A row for each cell and range that agree in `by` (nulls agree with nothing) and of which the range (row1, col1, row2, col2,
    ends included, numbers from 0 up) holds the cell: the columns of both. Ranges that end before they begin hold nothing."""
    pieces, levels = _pieces(ranges, row_levels, column_levels)
    return _placed(cells, levels, row, col).join(pieces, [*by, *_PIECE]).drop(*_PIECE)


def sums_in_ranges(cells: DataFrame, ranges: DataFrame, by: list[str], value: str, row: str = "row", col: str = "col", row_levels: int = ROW_LEVELS,
    column_levels: int = COLUMN_LEVELS) -> DataFrame:
    """The ranges that hold a cell, as `cells_in_ranges` finds them, with n (how many) and total (the sum of their `value`).

    Cells of one place are summed up first, then the places of each piece; a range adds up its pieces. So cells meet ranges as sums, and
    the work follows the cells and the ranges, however many cells the ranges hold. Rows of `ranges` that are equal are one.
    """
    pieces, levels = _pieces(ranges.distinct(), row_levels, column_levels)
    add = [F.sum("_n").alias("_n"), F.sum("_v").alias("_v")]
    places = cells.groupBy(*by, row, col).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    sums = _placed(places, levels, row, col).groupBy(*by, *_PIECE).agg(*add)
    return pieces.join(sums, [*by, *_PIECE]).groupBy(*ranges.columns).agg(F.sum("_n").alias("n"), F.sum("_v").alias("total"))

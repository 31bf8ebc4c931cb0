"""Mixing sources to target weights by Pareto order sampling, with DataFrame expressions only.

A source's target, in words, follows from the weights (`targets`). Within a source each document has an expected number
of copies in proportion to its preference (a small integer), up to `most` copies, so that the expected words make the
target. Its whole copies are certain. For the fraction p that remains, documents are ranked by random odds divided by
inclusion odds, (U / (1 - U)) / (p / (1 - p)), U from a hash of the id and a seed, and are taken from the smallest rank on
until the words that the target lacks are reached: a sample of fixed size, in words, with unequal probabilities. What a document that
is too long for the rest leaves open is filled in the same order by shorter ones; the last of them is taken if that
comes nearer to the target.

A hot source is spread over many ranges of the ranking; what a range adds to the next ones is one row of it and source.

Null and empty texts have no words: their size is 0 and nothing of them is taken. Null sources are one source, the
last. Rows with one id share their random number, ties go by id, then size; rows that agree in all are interchangeable and
are judged one by one. Null ids hash like an empty text. An empty table gives an empty one. Lengths of texts play no
part beyond counting words in one pass. Only the columns named are read, so that others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._cluster import BROADCAST_ROWS, checkpointed
from corpusloom.operators.ordered import ranged, running

#: Bits of a random number.
_BITS = 52
#: How often the rest of a target is filled.
PASSES = 3


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): the words `[^\\x20\\x09-\\x0D]+` of each text."""
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words.cast("bigint").alias("size"))


def cyclic_weights(sources: DataFrame, pattern: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sources` (a row for each source) with weight: the pattern's numbers in turn, by code points, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(int(w)) for w in pattern])
    return sources.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(pattern)))).cast("bigint"))


def level(items: DataFrame, by: list[str], weight: str, cap: str, total: Column) -> DataFrame:
    """`items` with _full (whether the item is held at its cap) and _open, _weights: what the others share, and their weights.

    Items of a key share `total` by weight; what passes an item's cap is shared anew by the others. In the order of cap
    / weight the first items are full. Each key has few items: one task sorts them.
    """
    order = Window.partitionBy(*by).orderBy(F.try_divide(cap, weight).asc_nulls_first(), F.col(cap), *[c for c in items.columns if c not in by])
    earlier = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = items.withColumns({"_at": F.row_number().over(order), "_open": total - earlier, "_weights": later})
    fits = (F.col("_weights") > 0) & (F.col("_open") * F.col(weight) <= F.col(cap) * F.col("_weights"))
    first = F.min(F.when(fits, F.struct("_at", "_open", "_weights"))).over(Window.partitionBy(*by))
    found = placed.withColumn("_first", first)
    return found.withColumns({"_full": F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), "_open": F.col("_first._open"),
        "_weights": F.col("_first._weights")}).drop("_at", "_first")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size, weight): all words are shared by weight, a source is repeated
    `most` times at most, and what it leaves is shared anew by weight among the others."""
    sums = sources.withColumns({"_all": F.sum("source_size").over(Window.partitionBy()), "_cap": F.col("source_size") * most})
    shared = level(sums, [], "weight", "_cap", F.col("_all"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_open") * F.col("weight") / F.col("_weights"))
    return shared.select("source", "source_size", target.alias("target"))


def _joined(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """`rows` with the columns of its source; `table` has n rows and is sent to all tasks where these are few."""
    own = table.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(own) if n <= BROADCAST_ROWS else own, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def uniform(seed: int) -> Column:
    """A number between 0 and 1 from doc_id, exact in a double, as is 1 minus it."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(_BITS // 4)), 16, 10).cast("bigint") + 0.5) / float(1 << _BITS)


def by_length(size: Column, step: int = 8, levels: int = 8) -> Column:
    """A preference of 1 to `levels`: a level more for each `step` words."""
    return F.least(F.lit(levels), 1 + F.floor(size / step)).cast("bigint")


def mix(rows: DataFrame, weights=cyclic_weights, prefer=by_length, most: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of rows (doc_id, source, size); taken is copies times size.

    weights: adds `weight` to a table of sources; prefer: the preference, a small positive integer, from the size.
    """
    rows = checkpointed(rows.withColumn("level", prefer(F.col("size"))))
    classes = rows.groupBy("source", "level").agg(F.sum("size").alias("words"))
    sources = weights(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = checkpointed(targets(sources, most))
    n = goal.count()
    # expected copies by source and preference
    each = _joined(classes, goal, n).withColumns({"_w": F.col("words") * F.col("level"), "_cap": F.col("words") * most})
    shared = level(each, ["source"], "_w", "_cap", F.col("target"))
    expected = F.when(F.col("words") == 0, 0.0).when(F.col("_full"), float(most)).otherwise(F.col("_open") * F.col("level") / F.col("_weights"))
    told = shared.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    plan = checkpointed(told.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        (F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("gap"),
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("expected", "whole")))).alias("copies")))
    own = F.element_at("copies", F.col("level"))
    p = own["expected"] - own["whole"]
    u = uniform(seed)
    ranked = _joined(rows, plan, n).select(
        "doc_id", "source", "size", "source_size", "target", "gap", own["whole"].alias("whole"),
        F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p))).alias("rank"))
    order = ["rank", "doc_id", "size"]
    held = ranged(ranked, ["source"], order)
    # the first documents that fit; then, of those behind them, the first that fit into what is left; the last time to the nearest
    size = F.col("size")
    filled = held.withColumns({"_rest": F.col("gap"), "_in": F.lit(False)})
    for k in range(PASSES):
        near = 2 if k == PASSES - 1 else 1  # may pass the rest by as much as it would lack otherwise
        fits = F.col("rank").isNotNull() & ~F.col("_in") & (size <= near * F.col("_rest"))
        summed = running(filled, ["source"], order, F.when(fits, size), "_words")
        filled = summed.withColumn("_in", F.col("_in") | (fits & (near * F.col("_words") + size <= near * F.col("_rest"))))
        if k < PASSES - 1:
            left = filled.groupBy("source").agg((F.max("gap") - F.sum(F.when(F.col("_in"), size).otherwise(0))).alias("_rest"))
            filled = _joined(filled.drop("_words", "_rest"), left, n)
    copies = F.col("whole") + F.col("_in").cast("bigint")
    return filled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * size).alias("taken"))

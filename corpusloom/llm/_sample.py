"""Bounded, reproducible samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._cluster import BROADCAST_ROWS, checkpointed

_SPAN = 1 << 30
#: Cells that a label's likely rows are counted in before any of them are ranked.
_CELLS = 256


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most `per_label` rows of each label, the first by a hash of the id.

    labels: (id_col, label_col) of the rows that may be learned from; null ids and labels are left out, and an id
    with several labels counts with the largest. An id with several texts counts with the smallest.

    No label's rows meet in one task: hashes are uniform, so about twice `per_label` rows a label pass a threshold,
    these are counted by cells of the hash, whole cells are taken, and only the rows of the one cell in which a
    label's last place falls are ranked. Small tables (labels, cells, chosen ids) are broadcast where their counted
    size allows it; for more labels or rows the joins go without a hint.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label")).withColumn("place", F.pmod(F.xxhash64("id"), F.lit(_SPAN)))
    )
    sizes = known.groupBy("label").agg(F.count("*").alias("size")).withColumn(
        "below", F.least(F.lit(float(_SPAN)), F.lit(2.0 * (per_label + 50) * _SPAN) / F.col("size"))).drop("size")
    n_labels = sizes.count()
    cell = F.floor(F.col("place") / F.col("below") * _CELLS).cast("int")
    likely = known.join(_hinted(sizes, n_labels), "label").where(F.col("place") < F.col("below")).select("id", "label", "place", cell.alias("cell"))
    counts = likely.groupBy("label", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("left", F.lit(per_label) - before).where("left > 0")
    dealt = likely.join(_hinted(cells, n_labels * _CELLS), ["label", "cell"])
    order = Window.partitionBy("label").orderBy("place", "id")
    last = dealt.where("n > left").withColumn("rank", F.row_number().over(order)).where("rank <= left")
    chosen = dealt.where("n <= left").select("id", "label").unionByName(last.select("id", "label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = texts.join(_hinted(chosen, n_labels * per_label), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return checkpointed(joined)

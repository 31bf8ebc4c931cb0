"""Work that follows the order of rows within a key, without a task that holds a whole key.

Rows are sorted into ranges of (key, order) and stored, so that a key of any size is spread over many partitions. Each
partition does its own part; what has to be known about the partitions before it is a row or less for each of them.
"""

from __future__ import annotations

import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


#: A setting of Spark 4.1 and later.
_UNIONS = "spark.sql.unionOutputPartitioning"


def stored(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage by a reliable checkpoint in the shared folder of the session.

    spark.checkpoint.dir is used; a folder of our own is made only where that is unset and all runs in one process.
    Unions are no longer planned as partitioned like their parts in this session: adaptive plans store fewer partitions
    than they promise, and such a union of them then fails ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    spark.conf.set(_UNIONS, "false")
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(?:\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint()


def _order(by: list[str], order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*by, *order)]


def spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`df` in ranges of (by, order), nulls first, not sorted within them."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_order(by, order))


def ranged(df: DataFrame, by: list[str], order: list[str], is_spread: bool = False) -> DataFrame:
    """`df` sorted by (by, order), nulls first, in stored ranges, with _part: the number of the range. is_spread: `df` is in
    such ranges already."""
    rows = df if is_spread else spread(df, by, order)
    return stored(rows.sortWithinPartitions(*_order(by, order)).withColumn("_part", F.spark_partition_id()))


def _carried(rows: DataFrame, sums: DataFrame, by: list[str], value: str) -> DataFrame:
    """`rows` with _before: `value` of `sums` (_part, by) summed over the earlier parts of the row's key, or 0.

    A range continues one key at most, that of its first row, so the table that is joined has a row for a range at most.
    """
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_before", F.sum(value).over(earlier)).where("_before is not null").select("_part", F.struct(*by).alias("_key"), "_before")
    joined = rows.join(F.broadcast(base), (rows["_part"] == base["_part"]) & F.struct(*[rows[c] for c in by]).eqNullSafe(base["_key"]), "left")
    return joined.drop(base["_part"]).drop("_key").withColumn("_before", F.coalesce("_before", F.lit(0)))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """`df` with `name`: the number of a row, from 1, among the rows of its key in their order.

    Null keys are a key of their own, nulls come first in the order; rows that agree in key and order are numbered in
    any order. Columns of `df` named _part, _n, _key or _before give way.
    """
    rows = ranged(df, by, order)
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    counts = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    return _carried(rows.withColumn("_n", place), counts, by, "_n").withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before", "_part")


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`rows`, made by `ranged`, with `name`: the sum of `value` (bigint, null counts as 0) over the earlier rows of the key.

    The ranges are kept, so that sums of several values take one sort. Columns named _v, _n, _key or _before give way.
    """
    own = Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_v", F.coalesce(value, F.lit(0)).cast("bigint"))
    sums = valued.groupBy("_part", *by).agg(F.sum("_v").alias("_n"))
    carried = _carried(valued.withColumn("_n", F.coalesce(F.sum("_v").over(own), F.lit(0))), sums, by, "_n")
    return carried.withColumn(name, F.col("_n") + F.col("_before")).drop("_v", "_n", "_before")


def runs(df: DataFrame, keys: list[str], by: list[str], order: str) -> DataFrame:
    """`df` with run: a number, from 1, that grows wherever a row differs from the one before it in `keys` (null-safe).

    Order values are unique within `by`; of rows that agree, any may come first. Null keys are a key of their own.
    """
    rows = ranged(df, by, [order])
    own = Window.partitionBy("_part", *by).orderBy(F.col(order).asc_nulls_first())
    same = F.struct(*keys).eqNullSafe(F.lag(F.struct(*keys)).over(own))
    first = F.row_number().over(own) == 1
    steps = rows.withColumn("_step", (~same & ~first).cast("int")).withColumn("_n",
        F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at, value = F.struct(F.col(order).isNotNull(), F.col(order)), F.struct(*keys)
    ends = steps.groupBy("_part", *by).agg(F.sum("_step").alias("_n"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    parts = Window.partitionBy(*by).orderBy("_part")
    # a part adds the steps in it and the one, if any, to the next part
    differs = ~F.col("_last").eqNullSafe(F.lead("_first").over(parts)) & F.lead("_part").over(parts).isNotNull()
    sums = ends.withColumn("_sum", F.col("_n") + differs.cast("int")).select("_part", *by, "_sum")
    return _carried(steps.drop("_step"), sums, by, "_sum").withColumn("run", F.col("_n") + F.col("_before") + 1).drop("_n", "_before", "_part")


#: A group that began in an earlier range.
_BEFORE = int(np.iinfo(np.int64).min)


class Greedy:
    """Greedy grouping of lengths in order. A state is the joined length of the open group, or -1 without one.

    A length is added to the open group unless the joined length would pass `most`; a group ends once it has `full`.
    """

    def __init__(self, most: int, full: int, glue: int):
        self.most, self.full, self.glue = most, full, glue

    def step(self, state: int, n: int) -> tuple[int, bool]:
        """(next state, whether this length begins a group)."""
        joined = state + self.glue + n
        begins = state < 0 or joined > self.most
        size = n if begins else joined
        return (-1 if size >= self.full else size), begins

    def steps(self, states: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """`step` from many states."""
        joined = states + self.glue + n
        begins = (states < 0) | (joined > self.most)
        size = np.where(begins, n, joined)
        return np.where(size >= self.full, -1, size), begins


def greedy_groups(df: DataFrame, by: list[str], keys: list[str], order: str, length: str, alone: str, most: int, full: int,
    glue: int = 2, is_spread: bool = False) -> DataFrame:
    """`df` with first: the `order` value (bigint, unique within `by`) of the first row of a row's group.

    Neighbours in order are grouped while they agree in `by` and `keys` (null-safe) and their joined length (with `glue`
    between them) allows it, see `Greedy`; a row that is `alone` is a group by itself. Greedy groups depend on all rows
    before them. A range that lies inside one run of equal keys is therefore described by what it makes of each
    possible state at its begin, of which few different ones are left after some rows; from these descriptions, one for
    each range, the state at the begin of every range follows. Null lengths count as 0.
    """
    rule = Greedy(most, full, glue)
    mark = F.md5(F.to_json(F.struct(*by, *keys)))
    rows = ranged(df.withColumn("_mark", mark), by, [order], is_spread)
    slim = rows.select("_part", "_mark", F.coalesce(F.col(length), F.lit(0)).cast("int").alias("n"),
        F.coalesce(F.col(alone), F.lit(False)).alias("alone"), F.col(order).cast("bigint").alias("at"))

    def described(batches):
        """One row a range: whole (one run without a row that is alone), the marks at its ends, the last state and the first row of
        its group, or for a whole range these for each state at the begin (place in exits, compressed)."""
        part = first_mark = mark = None
        state, start, whole, seen = -1, None, True, 0
        states = np.arange(-1, rule.full, dtype=np.int64)  # different states so far ..
        starts = np.full(len(states), _BEFORE, np.int64)  # .. the row at which the group began ..
        kind = np.arange(len(states))  # .. and which of them each state at the begin has become
        for batch in batches:
            for p, m, n, single, at in zip(*[c.to_pylist() for c in batch.columns]):
                if part is None:
                    part, first_mark = p, m
                    whole = not single
                elif whole and (m != mark or single):
                    whole = False
                if m != mark or single:
                    state = -1
                mark = m
                if single:
                    start = at
                    continue
                state, begins = rule.step(state, n)
                start = at if begins else start
                if whole:
                    states, begun = rule.steps(states, n)
                    starts = np.where(begun, at, starts)
                    seen += 1
                    if len(states) <= 8 and seen % 64:
                        continue
                    pairs, inverse = np.unique(np.stack([states, starts]), axis=1, return_inverse=True)
                    states, starts, kind = pairs[0], pairs[1], inverse.ravel()[kind]
        if part is not None:
            table = zlib.compress(kind.astype(np.uint16).tobytes()) if whole else b""
            yield pa.RecordBatch.from_pylist([{
                "part": part, "whole": whole, "first_mark": first_mark, "mark": mark, "state": state, "start": start,
                "kind": table, "states": states.tolist() if whole else [], "starts": starts.tolist() if whole else []}], schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("whole", pa.bool_()), ("first_mark", pa.string()), ("mark", pa.string()), ("state", pa.int32()),
                       ("start", pa.int64()), ("kind", pa.binary()), ("states", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    found = slim.mapInArrow(described,
        "part int, whole boolean, first_mark string, mark string, state int, start bigint, kind binary, states array<bigint>, starts array<bigint>")
    entry: dict[int, tuple] = {}
    mark_, state, start = None, -1, None
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # a row for each range
        if r["first_mark"] != mark_:
            state, start = -1, None
        entry[r["part"]] = (mark_, state, start)
        if r["whole"]:
            k = int(np.frombuffer(zlib.decompress(r["kind"]), np.uint16)[state + 1])
            state, start = r["states"][k], (start if r["starts"][k] == _BEFORE else r["starts"][k])
        else:
            state, start = r["state"], r["start"]
        mark_ = r["mark"]
    shared = df.sparkSession.sparkContext.broadcast(entry)

    def grouped(batches):
        part = None
        for batch in batches:
            out = []
            for p, m, n, single, at in zip(*[batch.column(c).to_pylist() for c in ("_part", "_mark", "_len", "_alone", "_at")]):
                if part is None:
                    part, (mark, state, start) = p, shared.value[p]
                if m != mark or single:
                    state = -1
                mark = m
                if single:
                    start = at
                else:
                    state, begins = rule.step(state, n)
                    start = at if begins else start
                out.append(start)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())], ["row", "first"])

    packed = rows.select(
        F.struct(*df.columns).alias("row"), "_part", "_mark", F.coalesce(F.col(length), F.lit(0)).cast("int").alias("_len"),
        F.coalesce(F.col(alone), F.lit(False)).alias("_alone"), F.col(order).cast("bigint").alias("_at"),
    )
    done = packed.mapInArrow(grouped, StructType([packed.schema["row"], StructField("first", LongType())]))
    return done.select("row.*", "first")


def first_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row of each key (nulls are equal): that with the smallest order; of rows that tie, the smallest row."""
    least = F.min(F.struct(order.isNotNull().alias("there"), order.alias("order"), F.struct(*df.columns).alias("row")))  # a row is held once
    return df.groupBy(*keys).agg(least["row"].alias("_row")).select("_row.*")

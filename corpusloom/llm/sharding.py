"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in the order of their keys; a keyed Feistel network permutes the numbers below the next
power of four, and a number that falls outside the table is permuted again until it falls inside, which makes a
permutation of the table. Number p goes to shard p mod n, slot p div n, so that shard sizes differ by one row at
most and anybody can compute a row's place, and the row of a place, from its number alone.

Null texts have no bytes, null ids sort first, and rows that agree in all key columns are interchangeable. Every
row keeps a place of its own. An empty table has no shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import checkpointed

_MASK31 = (1 << 31) - 1
#: Multipliers of the round function. Fixed values, so that shards stay the same between versions.
_MULTIPLIERS = (1103515245, 1597334677, 747796405, 1181783497)
_STEP = 1442695041


def half_bits(n: int) -> int:
    """Bits of each half of the network for n rows."""
    return max(1, ((max(1, n - 1)).bit_length() + 1) // 2)


def round_keys(seed: int, rounds: int = 4) -> list[int]:
    return [(seed * 2654435761 + (k + 1) * _STEP) & _MASK31 for k in range(rounds)]


def _round(right: np.ndarray, k: int, key: int, bits: int) -> np.ndarray:
    x = (right * _MULTIPLIERS[k % 4] + key) & _MASK31
    x = x ^ (x >> 15)
    return ((x * _MULTIPLIERS[(k + 1) % 4]) >> 16) & ((1 << bits) - 1)


def permute(numbers: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The places of row numbers 0 to n - 1 (below 2**62), or with `inverse` the row numbers of places."""
    bits, keys = half_bits(n), round_keys(seed)
    low = (1 << bits) - 1
    out = np.array(numbers, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> bits, x & low
        for k in range(len(keys)):
            if inverse:
                k = len(keys) - 1 - k
                left, right = right ^ _round(left, k, keys[k], bits), left
            else:
                left, right = right, left ^ _round(right, k, keys[k], bits)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(`df` with row_number from 0 in the order of `order`, rows). The rows are sorted into ranges and checkpointed,
    so that the count of each range, the only thing that reaches the driver, is that of the very rows numbered.
    Rows that agree in all of `order` are dealt out by where they were read, so that no range has to hold them all.
    Columns of `df` named row_number, _part, _at or _tie give way.
    """
    sort = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(int(parts), *sort).sortWithinPartitions(*sort).drop("_tie")
    stored = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["_part"], r["n"], r["first"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n"),
        F.min("_at").alias("first")).collect())
    base, rows = [], 0
    for part, n, first in sizes:
        base.append((part, rows - first))
        rows += n
    offsets = df.sparkSession.createDataFrame(base or [(-1, 0)], "_part int, _base bigint")
    out = stored.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_at") + F.col("_base"))
    return out.drop("_part", "_at", "_base"), rows


def shard(df: DataFrame, n_shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """`df` with row_number, shard and slot; columns of these names, or named _place, give way."""
    rows, n = numbered(df, order)

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = rows.withColumn("_place", place("row_number"))
    return placed.withColumn("shard", F.pmod("_place", F.lit(n_shards)).cast("int")).withColumn("slot",
        F.expr(f"_place div {int(n_shards)}")).drop("_place")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, size (UTF-8 bytes plus 16) and text_crc32 of each row; the text itself is not carried on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))

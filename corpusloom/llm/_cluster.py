"""Cluster plumbing shared by the operators: checkpoints, Arrow batches, hash bitmaps, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpusloom.operators.ordered import stored

#: Rows of a table that is broadcast; larger ones are joined without a hint.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch that goes to a Python worker (a single longer row goes alone).
BATCH_BYTES = 2 << 20
#: Rows that a Parquet reader decodes at once: the usual 4,096 whole texts fill a small heap where many tasks share it.
READ_ROWS = 256
#: Text bytes handled by numpy at once; temporaries are some 10 x 8 bytes for each of them.
SLICE_BYTES = 1 << 19


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage by a reliable checkpoint in the shared folder of the session; see `ordered.stored`."""
    return stored(df)


def packed_rows(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(row, text): the `keep` columns as one struct, so that none of their names can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def packed_filter_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): as `packed_rows`, for filters, which give back whole rows: a text column of strings is not held
    in the struct too, so that texts go through Python once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if not _carried(docs, text_col, c)]
    return docs.select(F.struct(*rest or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def filtered_rows(judged: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of `docs`, in its order, of (row, text) rows made by `packed_filter_rows`."""
    return judged.select(*[F.col("text").alias(c) if _carried(docs, text_col, c) else F.col(f"row.`{c}`") for c in docs.columns])


def _carried(docs: DataFrame, text_col: str, column: str) -> bool:
    return column.lower() == text_col.lower() and docs.schema[column].dataType == StringType()


def with_row(df: DataFrame, rest: str, column: str = "row") -> StructType:
    """The schema of one column of `df` followed by the columns `rest`; names of any characters are kept."""
    return StructType([df.schema[column], *StructType.fromDDL(rest)])


def unpacked(df: DataFrame, *own: str) -> DataFrame:
    """The columns of `row`, but for those that are named like one of the operator's `own`, and then those."""
    taken = {c.lower() for c in own}
    rest = [c for c in df.schema["row"].dataType.names if c.lower() not in taken]
    return df.select(*[F.col(f"row.`{c}`") for c in rest], *own)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with `fn` called for each batch; batches are bounded in bytes as well as in rows, also where they are read."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = str(conf.get(name)).rstrip("bB")
        if not now.isdigit() or int(now) > most:  # a session's own lower bound is left alone
            conf.set(name, str(most))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory of a worker process, which waits for the next task, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that keeps it
        pass


def utf8_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; null is empty, and U+FFFD stands for bytes that are none."""
    for x in column.cast(pa.large_binary()):
        data = x.as_py() or b""
        if not data.isascii():
            try:
                data.decode()
            except UnicodeDecodeError:
                data = data.decode("utf-8", "replace").encode()
        yield data


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) for runs of rows of about SLICE_BYTES; null is empty, and
    U+FFFD stands for bytes that are no UTF-8."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    for a, b, data, offsets in _slices(column):
        try:
            data.tobytes().decode()
            yield a, b, data, offsets
        except UnicodeDecodeError:
            texts = list(utf8_texts(column.slice(a, b - a)))
            yield a, b, np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: A bitmap is sent to every executor; this bounds it whatever the number of keys.
MAX_BITMAP_BITS = 1 << 28


def hash_bitmap(keys: DataFrame, column: str, n_keys: int) -> tuple[bytes, int]:
    """One-hash Bloom bitmap of a column, built by aggregation: at most MAX_BITMAP_BITS / 8 bytes reach the driver.

    It only thins out what an exact join sees afterwards, so a full bitmap costs time, never results.
    """
    bits = 1 << max(20, min(MAX_BITMAP_BITS.bit_length() - 1, (16 * max(1, n_keys)).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1  # bitmap functions number bits from 1
    rows = (
        keys.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        .collect()
    )
    out = bytearray(bits // 8)
    for r in rows:
        at = (r.b - 1) * 4096
        out[at : at + 4096] = bytes(r.m)[: len(out) - at]
    return bytes(out), bits


def in_bitmap(column: str, bitmap, bits: int):
    """Boolean column: the key's bit is set. `bitmap` is a broadcast variable."""
    @F.pandas_udf("boolean")
    def test(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        m = np.frombuffer(bitmap.value, np.uint8)
        return pd.Series((m[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return test(F.pmod(F.xxhash64(column), F.lit(bits)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node that it reaches.

    Alternating large-star and small-star passes over the edge table. Minima are aggregated before the
    shuffle and joined back, so a hub is never gathered in one task; each pass is checkpointed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Links each neighbour of u (the larger ones, or the smaller ones and u) to u's smallest."""
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            out = (
                down.join(low, "a")
                .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    before = state(e)
    while before[0]:
        e = checkpointed(star(star(e, True), False))
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


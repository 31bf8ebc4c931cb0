"""A stored index of postings for BM25 searches, in buckets with snapshots.

Documents are dealt into buckets by a hash of their id. Within a bucket those with equal filter columns, sorted by length, are cut
into shards; a shard's row has its documents' ids and lengths, its terms in order, each term's postings (document and count), and for
each term the greatest count and the least length, which bound what the term can add to a score whatever the statistics
of the corpus are. Document frequencies and the mean length are sums over the shards. An upsert reads and writes the buckets of its ids alone.

A search is exact, see `search`: shards are judged by their bounds, without their postings; only shards that may hold one of
the k best rows of some question are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from corpusloom.operators import snapshots
from corpusloom.operators.ordered import first_of, stored
from corpusloom.operators.retrieval import _Best, term_blocks, term_part, tokens, top_k

#: Documents of a shard, and terms with repeats in it (a single longer document is a shard of its own).
SHARD, SHARD_TERMS = 256, 1 << 20
#: Shards that are named to all tasks; more are joined without a hint.
_NAMED = 1_000_000
#: Sums in another order differ by less than this.
_SLACK = 1e-6


@dataclass(frozen=True)
class Found:
    """rows: (query_id, id, bm25, rank); read: (shards, postings) that were read, a row for each block of questions."""

    rows: DataFrame
    read: DataFrame


def _rows(docs: DataFrame, id_col: str, text_col: str, filters: tuple[str, ...], buckets: int) -> DataFrame:
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"), *filters)
    return own.withColumn("bucket", snapshots.bucket_of(["id"], buckets))


def _shards(rows: DataFrame, filters: tuple[str, ...], partitions: int) -> DataFrame:
    """Shards of rows (id, ts, filters, bucket)."""
    dealt = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", *filters, F.size("ts"), "id")
    ints = ArrayType(IntegerType())
    schema = StructType([
        StructField("bucket", IntegerType()), StructField("shard", IntegerType()), *[rows.schema[f] for f in filters], StructField("n_texts", IntegerType()),
        StructField("n_terms", LongType()), StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("lengths", ints),
        StructField("terms", ArrayType(rows.schema["ts"].dataType.elementType)), *[StructField(c, ints) for c in ("begin", "docs", "tf", "max_tf", "min_length")]])

    def cut(batches):
        held: list[pa.RecordBatch] = []
        key, n, words, number = None, 0, 0, 0
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", *filters)]))
            sizes = pc.fill_null(pc.list_value_length(batch.column("ts")), 0).to_pylist()
            at = 0
            for k in range(batch.num_rows):
                if n and (keys[k] != key or n >= SHARD or words + sizes[k] > SHARD_TERMS):
                    yield _shard([*held, batch.slice(at, k - at)], number, filters)
                    number = number + 1 if keys[k][0] == key[0] else 0
                    held, n, words, at = [], 0, 0, k
                key, n, words = keys[k], n + 1, words + sizes[k]
            held.append(batch.slice(at))
        if n:
            yield _shard(held, number, filters)

    return dealt.mapInArrow(cut, schema)


def _shard(parts: list[pa.RecordBatch], number: int, filters: tuple[str, ...]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    ids, ts = (rows.column(c).combine_chunks() for c in ("id", "ts"))
    lengths = pc.list_value_length(ts)
    size, n = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64), rows.num_rows
    coded = pc.dictionary_encode(pc.list_flatten(ts))
    names = coded.dictionary
    order = pc.sort_indices(names)
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    key, tf = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), size), return_counts=True)
    term, doc = key // n, key % n
    begin = np.searchsorted(term, np.arange(len(names) + 1))
    top = np.maximum.reduceat(tf, begin[:-1]) if len(names) else tf
    low = np.minimum.reduceat(size[doc], begin[:-1]) if len(names) else size[:0]
    one = lambda x: pa.array([x])
    ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
    columns = [rows.column("bucket").combine_chunks().slice(0, 1), pa.array([number], pa.int32()), *[rows.column(f).combine_chunks().slice(0, 1) for f in filters],
        pa.array([n - lengths.null_count], pa.int32()), one(int(size.sum())), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lengths.cast(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.take(order)),
        *[ints(x) for x in (begin, doc, tf, top, low)]]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "shard", *filters, "n_texts", "n_terms", "ids", "lengths", "terms", "begin", "docs", "tf", "max_tf", "min_length"])


def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "content", filters: tuple[str, ...] = (), buckets: int = 64) -> snapshots.Change:
    """Version 1 of the index of `docs` at `path`. filters: columns by which searches choose shards (a search may ask for any
    condition on them). Documents without an id are left out; null texts have no terms and count as documents."""
    rows = _shards(_rows(docs, id_col, text_col, filters, buckets), filters, buckets)
    return snapshots.create_raw(rows, path, ["id"], buckets)


def upsert(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "id", text_col: str = "content", deletes: DataFrame | None = None) -> snapshots.Change:
    """The next version: `docs` replace those of their ids or are added (of several of an id the smallest counts), the ids that `deletes` has go.

    Documents of the buckets that change are put together from their postings again; no text is read twice and no other
    bucket is touched.
    """
    m = snapshots.manifest(spark, path)
    own = ("bucket", "shard", "n_texts", "n_terms", "ids", "lengths", "terms", "begin", "docs", "tf", "max_tf", "min_length")
    filters = tuple(c for c in m.schema.names if c not in own)
    new = first_of(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *filters), ["id"], F.lit(0))
    new = stored(_rows(new, "id", "text", filters, m.buckets))
    gone = new.select("id", "bucket")
    if deletes is not None:
        gone = gone.unionByName(deletes.select(F.col(id_col).alias("id")).withColumn("bucket", snapshots.bucket_of(["id"], m.buckets)))
    buckets = sorted(r.bucket for r in gone.select("bucket").distinct().collect())  # numbers of buckets, of which there are few
    old = _documents(snapshots.load(spark, path, buckets=buckets, with_bucket=True, of=m), filters).join(gone.select("id").distinct(), "id", "left_anti")
    if deletes is not None:
        new = new.join(deletes.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti")
    rows = _shards(old.select(*new.columns).unionByName(new), filters, max(1, len(buckets)))
    return snapshots.replace(spark, path, rows, buckets, m)


def _documents(shards: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(id, ts, filters, bucket) of shards; terms in another order than in the texts."""
    schema = StructType([StructField("id", shards.schema["ids"].dataType.elementType), StructField("ts", shards.schema["terms"].dataType),
        *[shards.schema[f] for f in filters], shards.schema["bucket"]])

    def undo(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
                ids, lengths, terms = (row[c].flatten() for c in ("ids", "lengths", "terms"))
                begin, docs, tf = (row[c].flatten().to_numpy().astype(np.int64) for c in ("begin", "docs", "tf"))
                term, n = np.repeat(np.arange(len(terms)), np.diff(begin)), len(ids)
                by = np.argsort(docs, kind="stable")
                flat = np.repeat(term[by], tf[by])
                ends = np.r_[0, np.cumsum(np.bincount(docs, weights=tf, minlength=n).astype(np.int64))].astype(np.int32)
                offsets = pa.array(ends, mask=np.r_[lengths.is_null().to_numpy(zero_copy_only=False), False]) if lengths.null_count else pa.array(ends)
                ts = pa.ListArray.from_arrays(offsets, terms.take(pa.array(flat)))
                yield pa.RecordBatch.from_arrays([ids, ts, *[pa.array([row[c][0].as_py()] * n, row[c].type) for c in (*filters, "bucket")]], ["id", "ts", *filters, "bucket"])

    return shards.select("ids", "lengths", "terms", "begin", "docs", "tf", *filters, "bucket").mapInArrow(undo, schema)


def statistics(shards: DataFrame) -> tuple[int, float, int]:
    """(documents, mean number of terms of a text, postings)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, texts, terms, postings = shards.agg(total(F.size("ids")), total("n_texts"), total("n_terms"), total(F.element_at("begin", -1))).first()
    return n, (terms / texts if terms else 1.0), postings


def frequencies(shards: DataFrame) -> DataFrame:
    """(term, df)."""
    counted = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("begin", i + 1) - F.get("begin", i)).cast("bigint").alias("n")))
    return shards.select(F.explode(counted).alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("t.n").alias("df"))


def _bounds(batch: pa.RecordBatch, block, k1: float, b: float, mean: float, live) -> tuple[np.ndarray, list]:
    """(what each question can score at most in each shard, -inf where its period is another; places of the asked terms in each shard)."""
    starts = np.flatnonzero(np.r_[True, block.question[1:] != block.question[:-1]])
    asked = block.question[starts]
    out, places = np.full((batch.num_rows, block.n), -np.inf), []
    for i in range(batch.num_rows):
        terms = batch.column("terms").slice(i, 1).flatten()
        place = pc.fill_null(pc.index_in(block.terms, value_set=terms), -1).to_numpy()
        tf, low = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("max_tf", "min_length"))
        part = np.zeros(len(place))
        has = place >= 0
        part[has] = block.idf[has] * term_part(tf[place[has]], low[place[has]], k1, b, mean)
        out[i, asked] = np.add.reduceat(part[block.term], starts)
        places.append(place)
    return np.where((out > 0) & live(batch), out, -np.inf), places


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 24, k1: float = 1.2, b: float = 0.75, where: str | None = None,
    period: str | None = None, version: int | None = None) -> Found:
    """The k best documents of each question (query_id, query_text), as `retrieval.bm25_top` ranks them.

    where: a condition on the filter columns of the index; the statistics stay those of all documents. period: a filter column and a
    column of the questions: only shards of the period that is asked for, or of none, take part, where a period is asked for.

    For a block of questions, in one plan: the bounds of all shards are formed from their terms; the shard with the
    highest bound of each question is searched for that question, and the k-th best score there is one that the k-th best of all reaches; then the shards whose
    bound reaches it, and no others, are read and scored for the questions that need them. Bounds hold a slack for rounding.
    """
    m = snapshots.manifest(spark, path, version)
    shards = snapshots.load(spark, path, with_bucket=True, of=m)
    n, mean, _ = statistics(shards)
    own = shards.where(where) if where else shards
    keys = ["bucket", "shard"]
    told = own.select(*keys, *[period] * bool(period), "terms", "max_tf", "min_length")
    id_type, query_field = shards.schema["ids"].dataType.elementType, questions.schema["query_id"]
    out, read = [], []
    for block, ids, periods in term_blocks(questions, frequencies(shards), n, period):
        if not ids:
            continue
        shared = spark.sparkContext.broadcast(block)

        def live(batch, periods=periods):
            if periods is None:
                return True
            have = np.array([p or "" for p in batch.column(period).to_pylist()], object)[:, None]
            want = np.array([p or "" for p in periods], object)[None, :]
            return (have == "") | (want == "") | (have == want)

        def best_shards(batches, shared=shared, live=live):
            block = shared.value
            top, at = np.full(block.n, -np.inf), np.zeros((block.n, 2), np.int64)
            for batch in batches:
                bound, _ = _bounds(batch, block, k1, b, mean, live)
                if len(bound):
                    i = bound.argmax(0)
                    better = bound[i, np.arange(block.n)] > top
                    top[better] = bound[i, np.arange(block.n)][better]
                    at[better] = np.stack([batch.column(c).to_numpy() for c in keys], 1)[i[better]]
            q = np.flatnonzero(top > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, top[q], at[q, 0].astype(np.int32), at[q, 1].astype(np.int32))], ["q", "bound", *keys])

        def reached(batches, least=None, shared=shared, live=live):
            for batch in batches:
                bound, _ = _bounds(batch, shared.value, k1, b, mean, live)
                yield batch.select(keys).filter(pa.array((bound >= least - _SLACK).any(1)))

        def scored(batches, least=None, shared=shared, live=live):
            """The best rows of a task, and last a row of question -1 with the shards (id null) and postings read. Without `least` a shard
            is searched for the questions that are named beside it (asked)."""
            block = shared.value
            best, n_shards, n_postings = _Best(block.n, k, 0.0), 0, 0
            if least is not None:
                best.least = least - _SLACK
            for batch in batches:
                bound, places = _bounds(batch, block, k1, b, mean, live)
                for i in range(batch.num_rows):
                    need = bound[i] > -np.inf
                    if least is not None:
                        need &= bound[i] >= best.least
                    else:
                        need &= np.isin(np.arange(block.n), batch.column("asked").slice(i, 1).flatten().to_numpy())
                    if not need.any():
                        continue
                    row = {c: batch.column(c).slice(i, 1).flatten() for c in ("ids", "lengths", "begin", "docs", "tf")}
                    begin, docs, tf = (row[c].to_numpy().astype(np.int64) for c in ("begin", "docs", "tf"))
                    length = pc.fill_null(row["lengths"], 0).to_numpy(zero_copy_only=False)
                    used = np.zeros(len(block.idf), bool)
                    used[block.term[need[block.question]]] = True
                    term = np.flatnonzero(used & (places[i] >= 0))
                    at = places[i][term]
                    count = begin[at + 1] - begin[at]
                    flat = np.repeat(begin[at] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                    term = np.repeat(term, count)
                    most = need.sum() * 4 > block.n  # then the scores of all questions are formed as well
                    scores, step = block.ready() if most else block.prepare(need)
                    value = block.idf[term] * term_part(tf[flat], length[docs[flat]], k1, b, mean)
                    doc, ids = docs[flat], row["ids"].to_numpy(zero_copy_only=False)
                    for low in range(0, len(length), step):
                        own = (doc >= low) & (doc < low + step)
                        found = scores(doc[own] - low, term[own], value[own], min(step, len(length) - low))
                        best.add(np.where(need, found, -np.inf) if most else found, ids[low : low + step], None if most else np.flatnonzero(need))
                    n_shards, n_postings = n_shards + 1, n_postings + len(flat)
            q, score, doc = best.rows or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[q, -1].astype(np.int32)), pa.array([*doc.tolist(), None], kind), pa.array([*score.tolist(), float(n_shards)]),
                pa.array(np.r_[np.zeros(len(q), np.int64), n_postings])], ["q", "id", "bm25", "postings"])

        kind = to_arrow_type(id_type)
        result = StructType([StructField("q", IntegerType()), StructField("id", id_type), StructField("bm25", DoubleType()), StructField("postings", LongType())])
        first = told.mapInArrow(best_shards, "q long, bound double, bucket int, shard int").groupBy("q").agg(F.max_by(F.struct(*keys), "bound").alias("s"))
        payload = own.select(*keys, *[period] * bool(period), "ids", "lengths", "terms", "begin", "docs", "tf", "max_tf", "min_length")
        asked = stored(first.groupBy("s").agg(F.collect_list("q").alias("asked")).select("s.*", "asked"))
        some = payload.join(F.broadcast(asked), keys)
        tried = top_k(some.mapInArrow(scored, result).where("q >= 0").withColumnRenamed("q", "query_id"), "bm25", k, "id")
        least = np.full(len(ids), -np.inf)
        for r in tried.where(F.col("rank") == k).select("query_id", "bm25").collect():  # a row for each question of the block
            least[r.query_id] = r.bm25
        needed = stored(told.mapInArrow(lambda x, f=reached, v=least: f(x, v), "bucket int, shard int"))
        wanted = F.broadcast(needed) if needed.count() <= _NAMED else needed
        found = stored(payload.join(wanted, keys, "left_semi").mapInArrow(lambda x, f=scored, v=least: f(x, v), result))
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), query_field]))
        out.append(top_k(found.where("q >= 0").join(F.broadcast(names), "q").select("query_id", "id", "bm25"), "bm25", k, "id"))
        read.append(found.where("q < 0").agg(F.sum("bm25").cast("bigint").alias("shards"), F.sum("postings").alias("postings")))
    if not out:
        rows = StructType([query_field, StructField("id", id_type), *StructType.fromDDL("bm25 double, rank int")])
        return Found(spark.createDataFrame([], rows), spark.createDataFrame([(0, 0)], "shards bigint, postings bigint"))
    return Found(reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, read))

"""A stored index of vectors in cells, for cosine searches that read some cells only.

Cells are fitted on a bounded sample (`SAMPLE` vectors by a hash of the id, a spherical k-means of `ROUNDS` rounds; the sample and
the centroids are all that reaches the driver), and every vector goes to the cell of its nearest centroid. A cell is a bucket of a
snapshot, whatever its size; an upsert rewrites the cells that it changes.

A vector of a cell is at most the cell's radius (an angle) away from the centroid, so that its angle to a question is the question's
angle to the centroid less the radius at least. A search probes the cells nearest to each question; an exact one then reads
the cells, and no others, that by this bound can hold a vector as near as the k-th best found so far. How many cells have to be probed for
a wanted recall depends on the vectors alone, and `calibrate` finds it from exact searches for some of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corpusloom.operators import snapshots
from corpusloom.operators.ordered import first_of, stored
from corpusloom.operators.retrieval import _CELLS, QUERY_BLOCK, _Best, _blocks, _unit, top_k

#: Vectors of the sample, at most twice this, rounds of the fit, and cells.
SAMPLE, ROUNDS, MOST_CELLS = 8192, 12, 1024
#: Angles and products in another order differ by less than this.
_SLACK = 1e-7


@dataclass(frozen=True)
class Found:
    """rows: (query_id, id, cosine, rank); compared: pairs of question and vector that were compared; of: all such pairs."""

    rows: DataFrame
    compared: int
    of: int


def _valid(vectors: DataFrame, id_col: str, vec_col: str, filters: tuple[str, ...] = ()) -> DataFrame:
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull()))
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *filters)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have `dim` numbers and a direction, these as vectors of length one)."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = np.r_[0, np.cumsum(size, dtype=np.int64)]
    own = np.flatnonzero(size == dim)
    v = _unit(flat[offsets[own][:, None] + np.arange(dim)]) if len(own) else np.zeros((0, dim))
    fine = np.isfinite(v).all(1)
    return own[fine], v[fine]


def fit_cells(v: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of length one of vectors of length one."""
    rng = np.random.default_rng(seed)
    centroids = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(ROUNDS):
        of = (v @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, v)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def _celled(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows` (id, v, ..) with near, the cosine to the centroid, and bucket, the cell; without rows that have no direction."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = StructType([*rows.schema, StructField("near", DoubleType()), StructField("bucket", IntegerType())])

    def assign(batches):
        for batch in batches:
            c = shared.value
            own, v = _matrix(batch.column("v"), c.shape[1])
            cell, near = np.zeros(len(own), np.int64), np.zeros(len(own))
            step = max(1, _CELLS // len(c))
            for a in range(0, len(own), step):
                s = v[a : a + step] @ c.T
                cell[a : a + step], near[a : a + step] = s.argmax(1), s.max(1)
            kept = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near), pa.array(cell.astype(np.int32))], [*kept.schema.names, "near", "bucket"])

    return rows.mapInArrow(assign, schema)


def build(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", filters: tuple[str, ...] = (), cells: int | None = None) -> snapshots.Change:
    """Version 1 of the index at `path`. Vectors without a direction (null, with a null, NaN or infinity, or of length zero), those
    without an id and those of another dimension than most of the sample are left out. cells: by default the root of the
    number of vectors, MOST_CELLS at most. filters: columns that searches may put conditions on."""
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vec_col, filters)
    n = rows.count()
    share = max(1, -(-n // SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(share)) == 0).limit(2 * SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sizes = some.value_lengths().to_numpy() if len(some) else np.zeros(0, np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    sample = _matrix(some, dim)[1] if len(some) else np.zeros((0, 0))
    centroids = fit_cells(sample, cells or max(1, min(MOST_CELLS, int(n**0.5)))) if len(sample) else np.zeros((1, dim))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    return snapshots.create_raw(_celled(rows, centroids), path, ["id"], len(centroids), split="id")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])


def upsert(spark: SparkSession, path: str, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", deletes: DataFrame | None = None) -> snapshots.Change:
    """The next version: `vectors` replace those of their ids or are added, the ids that `deletes` has go. An id's new vector
    that has no direction leaves it without one. Cells stay as they were fitted; those that hold none of the ids, before or
    after, are not rewritten (their ids are read)."""
    m = snapshots.manifest(spark, path)
    filters = tuple(c for c in m.schema.names if c not in ("id", "v", "near"))
    new = _celled(first_of(_valid(vectors, id_col, vec_col, filters), ["id"], F.lit(0)), _centroids(spark, path))
    gone = vectors.select(F.col(id_col).alias("id"))
    if deletes is not None:
        gone = gone.unionByName(deletes.select(F.col(id_col).alias("id")))
        new = new.join(deletes.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti")
    gone = gone.where("id is not null").distinct()
    had = snapshots.load(spark, path, with_bucket=True, of=m).select("id", "bucket").join(gone, "id", "left_semi")
    cells = sorted(r.bucket for r in had.select("bucket").unionByName(new.select("bucket")).distinct().collect())  # numbers of cells
    old = snapshots.load(spark, path, buckets=cells, with_bucket=True, of=m).join(gone, "id", "left_anti")
    return snapshots.replace(spark, path, old.select(*new.columns).unionByName(new), cells, m, split="id")


def _scan(rows: DataFrame, questions: np.ndarray, asks: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(q, id, cosine): the k best rows of each question within each task, of the cells that it asks for (cells x questions)."""
    shared = rows.sparkSession.sparkContext.broadcast((questions, asks, least))
    id_type = rows.schema["id"].dataType
    kind = to_arrow_type(id_type)

    def run(batches):
        questions, asks, least = shared.value
        best = _Best(len(questions), k)
        best.least = least.copy()
        for batch in batches:
            ids, cell = batch.column("id").to_numpy(zero_copy_only=False), batch.column("bucket").to_numpy()
            own, v = _matrix(batch.column("v"), questions.shape[1])
            for c in np.unique(cell[own]).tolist():
                q = np.flatnonzero(asks[c])
                here = np.flatnonzero(cell[own] == c)
                step = max(1, _CELLS // max(1, len(questions)))
                for a in range(0, len(here) if len(q) else 0, step):
                    at = here[a : a + step]
                    scores = np.full((len(at), len(questions)), -np.inf)
                    scores[:, q] = np.round(v[at] @ questions[q].T, 9)
                    best.add(scores, ids[own[at]])
        q, score, doc = best.rows or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(doc.tolist(), kind), pa.array(score)], ["q", "id", "cosine"])

    return rows.mapInArrow(run, StructType([StructField("q", IntegerType()), StructField("id", id_type), StructField("cosine", DoubleType())]))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 24, probe: int | None = None, exact: bool = False, where: str | None = None,
    version: int | None = None) -> Found:
    """The k best vectors of each question (query_id, query_vec), ties to the smaller id; scores are rounded to 9 places.

    probe: the number of cells nearest to a question that are read for it (a quarter of them by default); exact: cells go on to
    be read until none is left that can hold a better vector, so that the result is that of `retrieval.cosine_top`. where: a
    condition on the filter columns. Questions without a direction, or of another dimension, find nothing.
    """
    m = snapshots.manifest(spark, path, version)
    centroids, every = _centroids(spark, path), snapshots.load(spark, path, with_bucket=True, of=m)
    told = every.groupBy("bucket").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect()  # a row for each cell
    size, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in told:
        size[r.bucket], radius[r.bucket] = r.n, np.arccos(min(1.0, max(-1.0, r.near)))
    asked = questions.where(F.col("query_vec").isNotNull() & ~F.exists("query_vec", lambda x: x.isNull())).select("query_id", F.col("query_vec").cast("array<double>").alias("v"))
    n_probe = min(len(centroids), probe or max(1, len(centroids) // 4))
    out, compared, pairs = [], 0, 0

    def rows_of(asks: np.ndarray) -> DataFrame:
        cells = snapshots.load(spark, path, buckets=np.flatnonzero(asks.any(1)).tolist(), with_bucket=True, of=m)
        return (cells.where(where) if where else cells).select("id", "v", "bucket")

    for block in _blocks(asked, max(1, -(-asked.count() // QUERY_BLOCK))):
        own, q = _matrix(pa.array([r["v"] for r in block], pa.list_(pa.float64())), centroids.shape[1]) if block else (np.zeros(0, int), None)
        if not len(own) or not size.sum():
            continue
        ids = [block[i]["query_id"] for i in own]
        near = q @ centroids.T
        asks = np.zeros((len(centroids), len(ids)), bool)
        asks[np.argsort(-near, axis=1, kind="stable")[:, :n_probe].T, np.arange(len(ids))] = True
        least = np.full(len(ids), -np.inf)
        found = top_k(_scan(rows_of(asks), q, asks, least, k).withColumnRenamed("q", "query_id"), "cosine", k, "id")
        compared, pairs = compared + int(size @ asks.sum(1)), pairs + int(size.sum()) * len(ids)
        if exact and n_probe < len(centroids):
            found = stored(found)
            for r in found.where(F.col("rank") == k).select("query_id", "cosine").collect():  # a row for each question of the block
                least[r.query_id] = r.cosine
            angle = np.arccos(np.clip(near, -1, 1)) - radius[None, :]
            bound = np.cos(np.clip(angle - _SLACK, 0, np.pi))
            more = (bound >= least[:, None] - _SLACK).T & ~asks & (size > 0)[:, None]
            if more.any():
                rest = _scan(rows_of(more), q, more, least, k).withColumnRenamed("q", "query_id")
                found = top_k(found.drop("rank").unionByName(rest), "cosine", k, "id")
                compared += int(size @ more.sum(1))
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), questions.schema["query_id"]]))
        out.append(found.withColumnRenamed("query_id", "q").join(F.broadcast(names), "q").select("query_id", "id", "cosine", "rank"))
    if not out:
        out = [spark.createDataFrame([], StructType([questions.schema["query_id"], every.schema["id"], *StructType.fromDDL("cosine double, rank int")]))]
    return Found(reduce(DataFrame.unionByName, out), compared, pairs)


def calibrate(spark: SparkSession, path: str, recall: float = 0.95, k: int = 24, questions: int = 256) -> int:
    """The number of cells to probe for a recall: so many that the share `recall` of the exact answers to some stored vectors, chosen
    by a hash of their ids, lies in them."""
    every = snapshots.load(spark, path, with_bucket=True)
    centroids, n = _centroids(spark, path), every.count()
    share = max(1, n // questions)
    some = stored(every.where(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(share)) == 0).limit(4 * questions).select(F.col("id").alias("query_id"),
        F.col("v").alias("query_vec")))
    if not some.count():
        return 1
    answers = search(spark, path, some, k, exact=True).rows.join(every.select("id", "bucket"), "id").join(some, "query_id")
    rows = answers.select("bucket", "query_vec").collect()  # k rows for each of a bounded number of questions
    near = _unit(np.array([r.query_vec for r in rows])) @ centroids.T
    own = near[np.arange(len(rows)), [r.bucket for r in rows]]
    rank = (near > own[:, None]).sum(1) + 1
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])

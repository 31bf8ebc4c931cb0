"""Hybrid retrieval for tables of questions: BM25, cosine search, rank fusion, metadata rerank, diversity.

Questions are batches, keyed by query_id. A stated set of questions is searched against all rows in blocks: a block of
bounded size is broadcast, each task scores its rows against it with matrix products and keeps the k best rows of each
question, and k rows a question and task are shuffled and ranked. No pair of question and row is ever a Spark row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.functions import vocab
from corpusloom.operators.ordered import stored
from corpusloom.operators.query import matches

#: Questions of a block with vectors.
QUERY_BLOCK = 4096
#: Questions of a block with terms, and pairs of question and term in it.
TERM_BLOCK, TERM_PAIRS = 4096, 2_000_000
#: Scores that a task holds at once, and what a pair of question and term costs in numbers of the matrix product.
_CELLS, _PAIR_COST = 1 << 20, 150
#: Of how many documents one is tried first, for the least score of each question, and from how many tasks on.
_TRIED, _TRIED_FROM = 16, 32
#: Equal texts are ranked once where one of so many rows is a copy.
_COPIES = 8
#: Ids that are broadcast; more are joined without a hint.
_NAMED = 1_000_000
#: Places that scores are rounded to, and what rounding changes at most.
_PLACES, _ROUNDING = 9, 1e-8


def tokens(c: Column) -> Column:
    """Runs of letters and digits. What lies between them is split off, which takes half the time of extracting them."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), "")


def _blocks(queries: DataFrame, n: int) -> Iterator[list]:
    """`queries` in n parts by a hash of query_id, each collected for itself."""
    for k in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        yield part.collect()


class _Best:
    """The k best rows of each question so far: larger scores first, ties to the smaller id. Scores are rounded, those not greater than
    `above` don't count. Rows that may be among the best are held, and put in order when there are k for each question."""

    def __init__(self, n: int, k: int, above: float = -np.inf):
        self.n, self.k, self.above, self.least = n, k, above, np.full(n, -np.inf)
        self._rows: tuple = ()
        self._held: list[tuple] = []
        self._n_held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """scores: a row for each id, a column for each question (of `of`, if given); -inf is no score."""
        least = self.least if of is None else self.least[of]
        row, query = self._may(scores, least)
        if len(row) > self.k * scores.shape[1] and len(ids) > self.k:
            cut = len(ids) - self.k
            least = np.maximum(least, np.partition(scores, cut, axis=0)[cut])
            row, query = self._may(scores, least)
        self._held.append((query if of is None else of[query], np.round(scores[row, query], _PLACES), ids[row]))
        self._n_held += len(row)
        if self._n_held > self.n * self.k:
            self._order()

    def _may(self, scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.maximum(least - _ROUNDING, np.nextafter(self.above, np.inf))  # one comparison of what may be millions of scores
        return np.divmod(np.flatnonzero(scores >= least), max(1, scores.shape[1]))

    def _order(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(*([self._rows] if self._rows else []), *self._held))
        place = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((place, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.r_[np.flatnonzero(np.r_[True, query[1:] != query[:-1]]), len(query)] if len(query) else np.zeros(1, np.int64)
        rank = np.arange(len(query)) - np.repeat(first[:-1], np.diff(first))
        full = query[rank == self.k - 1]
        self.least[full] = np.maximum(self.least[full], score[rank == self.k - 1])
        self._rows = tuple(x[rank < self.k] for x in (query, score, ids))
        self._held, self._n_held = [], 0

    @property
    def rows(self) -> tuple:
        """(question, score, id), in order."""
        if self._held:
            self._order()
        return self._rows


def _codes(periods: list, of: list) -> np.ndarray:
    """The place of each period in `of`; -1 for null and -2 for one that is not there."""
    place = {p: k for k, p in enumerate(of)}
    return np.array([-1 if p is None else place.get(p, -2) for p in periods], np.int64)


def _task_best(rows: DataFrame, query_ids: list, query_field: StructField, k: int, name: str, score, periods: list | None = None,
    above: float = -np.inf, least: np.ndarray | None = None) -> DataFrame:
    """(query_id, id, name) of the k best rows of each question within each task. rows: id first, without null ids;
    score(batch) yields (first row, scores) for runs of rows. With periods, one of each question, the last column of `rows`
    is the period of the row, and rows of another period than the question's (where both have one) are no candidates. least: a
    score for each question that k rows are known to reach; lower ones are left out."""
    id_field = rows.schema[0]
    schema = StructType([StructField("query_id", query_field.dataType), StructField(id_field.name, id_field.dataType),
        StructField(name, DoubleType())])
    kinds: list = []
    query_kind = to_arrow_type(query_field.dataType)
    known = sorted({p for p in periods or () if p is not None})
    asked = _codes(periods or (), known)

    def run(batches):
        best = _Best(len(query_ids), k, above)
        if least is not None:
            best.least = least.copy()
        for batch in batches:
            kinds[:] = [batch.column(0).type]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own = _codes(batch.column(batch.num_columns - 1).to_pylist(), known)[:, None] if periods is not None else None
            for at, part in score(batch):
                if own is not None:
                    of = own[at : at + len(part)]
                    part = np.where((of == -1) | (asked == -1) | (of == asked), part, -np.inf)
                best.add(part, ids[at : at + len(part)])
        if best.rows and len(best.rows[0]):
            query, value, ids = best.rows
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[q] for q in query], query_kind), pa.array(ids, kinds[0]), pa.array(value)],
                ["query_id", id_field.name, name])

    return rows.mapInArrow(run, schema)


class TermBlock:
    """Questions 0 to n - 1 with their terms: idf of each term and pairs (question, term), by question."""

    def __init__(self, terms: list | pa.Array, idf: np.ndarray, question: np.ndarray, term: np.ndarray, n: int):
        self.terms, self.idf, self.question, self.term, self.n = pa.array(terms, pa.string()), idf, question, term, n
        self._ready = None

    def ready(self):
        """`prepare` for all questions, once in a worker."""
        if self._ready is None:
            self._ready = self.prepare()
        return self._ready

    def prepare(self, live: np.ndarray | None = None):
        """(a function that turns parts of scores (row, term, value), in any order, of n_rows rows into scores, 0 without a common term, with
        a column for each question, or each `live` one; rows to be taken at once). A term that many questions and many documents have takes part
        in a matrix product, where it costs the same for each pair of them; the others are added up one by one."""
        q, t, n = self.question, self.term, self.n
        n_of = np.bincount(t, minlength=len(self.terms))
        common = np.flatnonzero(n_of * np.exp(-self.idf) * _PAIR_COST > n)  # exp(-idf): the part of the documents that have it
        if live is not None:  # the same terms are common, so that a sum does not depend on who else asks
            mine = live[q]
            q, t, n = (np.cumsum(live) - 1)[q[mine]], t[mine], int(live.sum())
            n_of = np.bincount(t, minlength=len(self.terms))
        column = np.full(len(self.terms), -1)
        column[common] = np.arange(len(common))
        dense = np.zeros((len(common), n))
        often = column[t] >= 0
        dense[column[t[often]], q[often]] = 1.0
        rare = np.argsort(t[~often], kind="stable")
        rare_q, n_of = q[~often][rare], np.where(column >= 0, 0, n_of)
        begins = np.cumsum(n_of) - n_of

        def scores(row: np.ndarray, term: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
            weight = np.zeros((n_rows, len(common)))
            hit = column[term] >= 0
            weight[row[hit], column[term[hit]]] = value[hit]
            out = weight @ dense
            hit = n_of[term] > 0
            row, term, value = row[hit], term[hit], value[hit]
            if (row[1:] < row[:-1]).any():
                order = np.argsort(row, kind="stable")
                row, term, value = row[order], term[order], value[order]
            count, begin = n_of[term], begins[term]
            at = np.searchsorted(row, np.arange(n_rows + 1))
            for r in np.flatnonzero(np.diff(at)):  # a row at a time, so that what is added up, the pairs of the block at most, stays in the cache
                own = slice(at[r], at[r + 1])
                n_own = count[own]
                ends = np.cumsum(n_own)
                place = np.repeat(begin[own] - (ends - n_own), n_own)
                place += np.arange(ends[-1])
                out[r] += np.bincount(rare_q.take(place, mode="clip"), weights=np.repeat(value[own], n_own), minlength=n)
            return out

        return scores, max(1, _CELLS // 2 // max(1, n, len(common)))


def counted(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """`rows` with its column `ts` of terms in place of (n_terms, terms, tf): how many there are (null: none given), the
    distinct ones and how often each is there."""
    others = [f for f in rows.schema if f.name != ts]
    schema = StructType([*others, *StructType.fromDDL("n_terms int, terms array<string>, tf array<int>")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                column = batch.column(ts)
                length = pc.list_value_length(column)
                size = pc.fill_null(length, 0).to_numpy().astype(np.int64)
                coded = pc.dictionary_encode(pc.list_flatten(column))
                n = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(batch.num_rows), size) * n + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * n).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % n)))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], length.cast(pa.int32()), terms,
                    pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], schema.names)

    return rows.mapInArrow(run, schema)


def _term_scorer(shared, k1: float, b: float, mean: float):
    """Scores of batches (id, n_terms, terms, tf) against a broadcast `TermBlock`."""

    def score(batch):
        block = shared.value
        scores, step = block.ready()
        size = pc.fill_null(batch.column(1), 0).to_numpy().astype(np.int64)
        own = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy().astype(np.int64)
        offsets = np.r_[0, np.cumsum(own)]
        place = pc.fill_null(pc.index_in(pc.list_flatten(batch.column(2)), value_set=block.terms), -1).to_numpy()
        tf = pc.list_flatten(batch.column(3)).to_numpy()
        for a in range(0, batch.num_rows, step):
            z = min(batch.num_rows, a + step)
            at = slice(offsets[a], offsets[z])
            has = place[at] >= 0
            row, term = np.repeat(np.arange(z - a), own[a:z])[has], place[at][has]
            order = np.argsort(row * len(block.terms) + term)  # equal documents are added up in one order and tie
            row, term = row[order], term[order]
            yield a, scores(row, term, block.idf[term] * term_part(tf[at][has][order], size[a:z][row], k1, b, mean), z - a)

    return score


def term_part(tf: np.ndarray, length: np.ndarray, k1: float, b: float, mean: float) -> np.ndarray:
    """What a term found tf times in a document of so many terms adds for each unit of its idf: grows with tf, falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def term_blocks(queries: DataFrame, frequencies: DataFrame, n: int, period: str | None = None) -> Iterator[tuple[TermBlock, list, list | None]]:
    """(block, query ids, periods) of the questions (query_id, query_text) that have a term of `frequencies` (term, df) of n documents."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).distinct()
    found = asked.join(frequencies, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    if period:
        found = found.join(queries.groupBy("query_id").agg(F.max(period).alias("period")), "query_id")
    found = stored(found)  # a question's own terms, with the number of documents that have them
    n_queries, n_pairs = found.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_blocks = max(1, -(-n_queries // TERM_BLOCK), -(-n_pairs // TERM_PAIRS))
    for k in range(n_blocks):
        part = found if n_blocks == 1 else found.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == k)
        rows = part.toArrow().combine_chunks()
        if not rows.num_rows:
            yield TermBlock([], np.zeros(0), *[np.zeros(0, np.int64)] * 2, 0), [], [] if period else None
            continue
        terms = rows.column("terms").chunk(0)
        size, flat = pc.list_value_length(terms).to_numpy().astype(np.int64), terms.flatten()
        coded = flat.field("term").dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        df = np.zeros(len(coded.dictionary))
        df[place] = flat.field("df").to_numpy()
        block = TermBlock(coded.dictionary, idf(n, df), np.repeat(np.arange(rows.num_rows), size), place, rows.num_rows)
        yield block, rows.column("query_id").to_pylist(), rows.column("period").to_pylist() if period else None


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 24, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75,
    among: DataFrame | None = None, period: str | None = None) -> DataFrame:
    """(query_id, id, bm25, rank) of the k best documents of each question (query_id, query_text), by its distinct terms.

    With `among` (a table of ids), only its documents are ranked; the statistics stay those of all documents. Null
    texts have no terms and count as documents; documents without a term of the question, and those with a null id,
    are not ranked; ties go to the smaller id. Scores are rounded to 9 places, so that ranks don't depend on the order
    of sums. Questions of one id are one question. Of equal texts (of one period) the first is ranked for all of them, and of equal questions the
    first is asked, where there are many. Where there are many tasks, a part of the documents is tried first: what lies below the k best of it is
    not passed on. period: a column of both tables; a document that has another period than
    the question asks for is not ranked, where neither is null. Any number of periods are searched at once.
    """
    own_period = [F.col(period)] if period else []
    apart = [F.col(period).cast("string") if period else F.lit(None).cast("string")]
    asked = queries.select("query_id", "query_text", *own_period)
    same_asked = _copies(asked, "query_id", _digest("query_text"), *apart)
    words = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("ts"), _digest(text_col).alias("_text"), *own_period)
    words = stored(counted(words)).select(id_col, "n_terms", "terms", "tf", *own_period, "_text")  # texts are read once
    n, mean = words.agg(F.count("*"), F.avg("n_terms")).first()
    df = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    own = words.where(F.col(id_col).isNotNull()) if among is None else stored(words.join(among.select(id_col).distinct(), id_col, "left_semi"))
    same = _copies(own.where("_text is not null"), id_col, F.col("_text"), *apart)
    if same is not None:
        own = stored(own.join(_small(same.where(F.col(id_col) == F.col("_first")).select(id_col)), id_col, "left_semi"))
    own = own.drop("_text")
    if same_asked is not None:
        asked = asked.join(_small(same_asked.where("query_id = _first").select("query_id")), "query_id", "left_semi")
    tried = stored(own.where(F.pmod(F.xxhash64(id_col), F.lit(_TRIED)) == 0)) if own.rdd.getNumPartitions() >= _TRIED_FROM else None
    out = []
    for block, ids, periods in term_blocks(asked, df, n, period):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def best(rows, least=None, shared=shared, ids=ids, periods=periods):
            return _task_best(rows, ids, queries.schema["query_id"], k, "bm25", _term_scorer(shared, k1, b, mean or 1.0), periods, 0.0, least)

        out.append(best(own, None if tried is None else _least(top_k(best(tried), "bm25", k, id_col), "bm25", k, ids)))
    found = top_k(reduce(DataFrame.unionByName, out), "bm25", k, id_col)
    if same is not None:  # a copy has the score of the first, of which k are enough
        copies = top_k(same.withColumnsRenamed({"_first": "query_id"}).withColumn("s", F.lit(0)), "s", k, id_col).select(F.col("query_id").alias("_first"), id_col)
        found = top_k(found.select("query_id", F.col(id_col).alias("_first"), "bm25").join(copies, "_first").drop("_first"), "bm25", k, id_col)
    if same_asked is not None:
        found = found.withColumnRenamed("query_id", "_first").join(same_asked.select("query_id", "_first"), "_first").drop("_first")
    return found.select("query_id", id_col, "bm25", "rank")


def _least(ranked: DataFrame, score: str, k: int, ids: list) -> np.ndarray:
    """The k-th best score of each question, or -inf: a row for each question of a block."""
    found = {r.query_id: r[score] for r in ranked.where(F.col("rank") == k).select("query_id", score).collect()}
    return np.array([found.get(q, -np.inf) for q in ids])


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= _NAMED else ids


def _digest(text_col: str) -> Column:
    return F.sha2(F.col(text_col).cast("binary"), 256)


def _copies(rows: DataFrame, id_col: str, *keys: Column) -> DataFrame | None:
    """(id, _first: the smallest id of a row with equal keys), for all rows; None if few are copies, or ids repeat or are null."""
    known = rows.select(id_col, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k), F.lit("-")) for k in keys]), 256).alias("_key"))
    known = stored(known)
    n, n_ids, n_keys = known.agg(F.count("*"), F.count_distinct(id_col), F.count_distinct("_key")).first()
    if n_ids < n or (n - n_keys) * _COPIES < n:
        return None
    return stored(known.join(known.groupBy("_key").agg(F.min(id_col).alias("_first")), "_key").select(id_col, "_first"))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 24, id_col: str = "vec_id", vec_col: str = "embedding",
    period: str | None = None) -> DataFrame:
    """(query_id, id, cosine, rank) of the k best vectors of each question (query_id, query_vec); exact. period: as in `bm25_top`.

    Vectors without a direction (null, with a null, NaN or infinity, or of length zero), those of another dimension
    than the question's and those with a null id are not ranked; ties go to the smaller id. Scores are rounded to 9 places.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull())).select(id_col,
        F.col(vec_col).cast("array<double>").alias("v"), *[F.col(c) for c in [period] if c])
    asked = queries.where(F.col("query_vec").isNotNull() & ~F.exists("query_vec", lambda x: x.isNull())).select("query_id",
        F.col("query_vec").cast("array<double>").alias("v"), *[F.col(c).alias("period") for c in [period] if c])
    out = []
    for block in _blocks(asked, max(1, -(-asked.count() // QUERY_BLOCK))):
        sizes = [len(r["v"]) for r in block]
        by_size = {d: [i for i, n in enumerate(sizes) if n == d] for d in set(sizes)}
        shared = vectors.sparkSession.sparkContext.broadcast({d: (np.array(at), _unit(np.array([block[i]["v"] for i in at]).reshape(-1, d))) for d,
            at in by_size.items()})
        n = len(block)

        def score(batch, shared=shared, n=n):
            size = batch.column(1).value_lengths().to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(size, dtype=np.int64)]
            step = max(1, _CELLS // max(1, n))
            for a in range(0, batch.num_rows, step):
                z = min(batch.num_rows, a + step)
                out = np.full((z - a, n), -np.inf)
                for d, (at, q) in shared.value.items():
                    own = np.flatnonzero(size[a:z] == d)
                    v = _unit(flat[(offsets[a:z][own][:, None] + np.arange(d))])
                    out[own[:, None], at[None, :]] = v @ q.T
                    out[own[np.isnan(v).any(1)]] = -np.inf
                    out[:, at[np.isnan(q).any(1)]] = -np.inf
                yield a, out

        out.append(_task_best(rows, [r["query_id"] for r in block], queries.schema["query_id"], k, "cosine", score,
            [r["period"] for r in block] if period else None))
    return top_k(reduce(DataFrame.unionByName, out), "cosine", k, id_col)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; NaN where there is no direction."""
    with np.errstate(all="ignore"):
        out = v / np.sqrt((v * v).sum(1, keepdims=True))
    return np.where(np.isfinite(v).all(1, keepdims=True), out, np.nan)


def top_k(scored: DataFrame, score: str, k: int, id_col: str, rank: str = "rank") -> DataFrame:
    """The k best rows of each question with their rank from 1; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(id_col))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def fuse(lists: list[tuple[DataFrame, str]], id_col: str, k: int = 60) -> DataFrame:
    """(query_id, id, rrf): reciprocal rank fusion, the sum of 1 / (k + rank) over the lists."""
    parts = [d.select("query_id", id_col, (1.0 / (k + F.col(r))).alias("s")) for d, r in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", id_col).agg(F.sum("s").alias("rrf"))


def hybrid(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, top: int = 24, images: bool = False) -> DataFrame:
    """(query_id, score, original_rank from 0 and the columns of the chunk) of the `top` best chunks of each question, by words and vectors.

    questions: query_id, query_text, query_vec (either may be null), tax_year; chunks: see `evidence_filter`; vectors: id,
    embedding. The filter comes before the searches, the period of each question within them, so that any number of
    periods is one plan.
    """
    fit = evidence_filter(chunks, images=images)
    words = bm25_top(chunks.select("id", "content", "tax_year"), questions.where("query_text is not null"), top, "id", "content", among=fit.select("id"),
        period="tax_year")
    near = cosine_top(vectors.select("id", "embedding").join(fit.select("id", "tax_year"), "id"), questions, top, "id", period="tax_year")
    fused = fuse([(words, "rank"), (near, "rank")], "id").withColumn("score", F.round("rrf", 9))
    best = top_k(fused, "score", top, "id", "original_rank").select("query_id", "id", "score", (F.col("original_rank") - 1).alias("original_rank"))
    return best.join(fit, "id")


def evidence_filter(chunks: DataFrame, language: str = "en", tax_year: Column | None = None, images: bool = False) -> DataFrame:
    """Rows that may be evidence: right kind, language and period where they have one, status not excluded."""
    kind = F.coalesce(F.col("content_type"), F.lit("text"))
    keep = (kind == "guide_image") if images else (kind != "guide_image")
    keep &= F.col("language").isNull() | (F.col("language") == language)
    keep &= F.col("status").isNull() | (F.col("status") != "excluded")
    if tax_year is not None:
        keep &= tax_year.isNull() | F.col("tax_year").isNull() | (F.col("tax_year") == tax_year)
    return chunks.where(keep)


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def period_score(asked: Column) -> Column:
    year = F.expr("try_cast(substr(q_tax_year, 1, 4) AS int)")
    covers = (F.year("effective_from") <= year) & (F.col("effective_to").isNull() | (F.year("effective_to") >= year))
    return (
        F.when(asked.isNull() | (asked == ""), F.when(F.lower(F.col("status")) == "current", 1).otherwise(0))
        .when(F.col("tax_year") == asked, 3).when(year.isNull(), 1).when(covers, 2)
        .when(F.col("tax_year").isNull() & F.col("effective_from").isNull(), 1).otherwise(0)
    )


def scored_rows(candidates: DataFrame) -> DataFrame:
    """`candidates` with s_period, s_exact, s_status, s_tax and s_authority, see `rerank` for the columns."""
    status = F.coalesce(F.lower(F.col("status")), F.lit("unknown"))
    low = lambda a: F.transform(F.coalesce(F.col(a), F.expr("cast(array() as array<string>)")), F.lower)
    level = F.coalesce(F.lower(F.col("authority_level")), F.lit(""))
    own = F.least(F.floor(F.greatest(F.coalesce(F.col("authority_rank"), F.lit(0)), F.lit(0)) / 10).cast("int"), F.lit(8))
    legal = matches(F.lower(F.col("q_text")), vocab.LEGAL)
    preference = (
        F.when(legal, _lookup(vocab.AUTHORITY_LEGAL, level)).when(F.col("q_procedural"), _lookup(vocab.AUTHORITY_PROCEDURAL, level))
        .otherwise(_lookup(vocab.AUTHORITY_DEFAULT, level))
    )
    return candidates.withColumns({
        "s_period": period_score(F.col("q_tax_year")),
        "s_exact": F.when((F.col("q_tax_year") != "") & (F.col("tax_year") == F.col("q_tax_year")), 1).otherwise(0),
        "s_status": F.coalesce(F.when(F.col("q_historical"), _lookup(vocab.STATUS_PAST, status)).otherwise(_lookup(vocab.STATUS_NOW, status)),
            F.lit(0)),
        "s_tax": F.when(F.size(low("q_tax_types")) == 0, 0).when(F.size(low("tax_types")) == 0, 1)
        .when(F.arrays_overlap(low("tax_types"), low("q_tax_types")), 2).otherwise(0),
        "s_authority": F.coalesce(preference, own),
    })


def rerank(candidates: DataFrame, limit: int = 8, per_source: int = 2) -> DataFrame:
    """The evidence of each question, ranked from 1.

    candidates: query_id, original_rank, id, source_id, status, tax_year, effective_from, effective_to, tax_types,
    authority_level, authority_rank, and of the question q_tax_year, q_tax_types, q_text, q_procedural, q_historical.
    Excluded rows go; superseded rows go too where others remain and the question is not about the past. Null labels
    are empty, a null status is unknown, a null source is one source; ties go to the smaller original rank, then id.
    A question's candidates are few (top-k lists), so its windows are small.
    """
    status = F.coalesce(F.lower(F.col("status")), F.lit("unknown"))
    live = F.max((status != "superseded").cast("int")).over(Window.partitionBy("query_id"))
    scored = scored_rows(candidates.where(status != "excluded")).withColumn("_live", live)
    scored = scored.where(F.col("q_historical") | (F.col("_live") == 0) | (status != "superseded")).drop("_live")
    keys = [F.col(c).desc() for c in ("s_period", "s_exact", "s_status", "s_tax", "s_authority")] + [F.col("original_rank"), F.col("id")]
    capped = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy(*keys))).where(F.col("_n") <= per_source)
    best = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))
    return best.where(F.col("rank") <= limit).drop("_n")


def rerank_images(images: DataFrame, evidence: DataFrame, limit: int = 4) -> DataFrame:
    """Guide images that share page (source_id, page) or workflow with a question's evidence, ranked from 1.

    images: as `rerank`'s candidates, with content_type, page and workflow_id; evidence: query_id, source_id, page,
    workflow_id. Excluded, superseded and historical images go, and those of another period where one is asked for.
    Order: association (2 page, 1 workflow as it is written, 0 workflow but for blanks), period, tax types, authority,
    original rank, id. Empty and null keys associate nothing. Two equi-joins, no OR join.
    """
    pages = evidence.where("source_id <> '' and page is not null").select("query_id", "source_id", "page").distinct().withColumn("_p", F.lit(2))
    flows = evidence.where("trim(workflow_id) <> ''").select("query_id", F.trim("workflow_id").alias("_flow")).distinct().withColumn("_w", F.lit(1))
    status = F.coalesce(F.lower(F.col("status")), F.lit(""))
    own = images.where((F.col("content_type") == "guide_image") & ~status.isin("excluded", "superseded", "historical")).withColumn("_flow",
        F.trim("workflow_id"))
    joined = own.join(pages, ["query_id", "source_id", "page"], "left").join(flows, ["query_id", "_flow"], "left")
    written = F.when(F.col("_flow") == F.col("workflow_id"), 1).otherwise(0)
    tied = scored_rows(joined.where("_p is not null or _w is not null").withColumn("association", F.coalesce("_p", written)))
    tied = tied.where("q_tax_year is null or q_tax_year = '' or s_period > 0")
    keys = [F.col(c).desc() for c in ("association", "s_period", "s_tax", "s_authority")] + [F.col("original_rank"), F.col("id")]
    return tied.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).where(F.col("rank") <= limit).drop("_p", "_w",
        "_flow")


def row_defaults(rows: DataFrame) -> DataFrame:
    """Rows of an index as typed rows: old ones may lack columns, and hold numbers, dates and lists as texts.

    Columns that `rows` lacks are added; texts that must be there are empty, content_type is `document`, numbers that
    are none are null, dates are those of the first ten characters, a text in place of a list is a list of it, and
    lists are never null.
    """
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    col = lambda name: F.col(name) if name in have else F.lit(None)
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit("document" if name == "content_type" else "")).alias(name)
    number = lambda name: F.expr(f"try_cast({name} as int)").alias(name) if name in have else F.lit(None).cast("int").alias(name)
    day = lambda name: (F.expr(f"try_cast(substr(cast({name} as string), 1, 10) as date)") if name in have else F.lit(None).cast("date")).alias(name)

    def many(name: str) -> Column:
        none = F.expr("cast(array() as array<string>)")
        if name not in have:
            return none.alias(name)
        own = F.filter(name, lambda x: x.isNotNull()) if have[name].startswith("array") else F.array(F.col(name).cast("string"))
        return F.when(F.col(name).isNull(), none).otherwise(own).alias(name)

    plain = ("source_url", "blob_path", "section", "sheet", "cell_range", "tax_year", "document_version", "workflow_id", "authority_level",
        "language", "status",
             "form_code", "source_hash", "chunk_hash", "image_id", "image_url", "image_alt_text", "image_caption")
    return rows.select(
        *map(text, ("id", "content", "content_type", "title", "source_id")), *[col(c).cast("string").alias(c) for c in plain],
            *map(number, ("page", "page_end", "authority_rank")),
        *map(day, ("published_date", "effective_from", "effective_to")), *map(many, ("tax_types", "taxpayer_types", "supersedes", "tags")),
    )


def retrieve(questions: DataFrame, found: DataFrame, image_found: DataFrame, min_score: float = 0.01, max_evidence: int = 8,
    max_images: int = 4) -> tuple[DataFrame, DataFrame]:
    """(evidence, images) of analysed questions from the rows that searches found.

    questions: query_id, tax_year, tax_types, procedural_intent, historical_intent, retrieval_text (see `query.analyze`);
    found, image_found: query_id, score, original_rank and the columns of the rows. Images are ranked only for
    questions with procedural intent that have evidence. Questions without evidence give no row.
    """
    asked = questions.select(
        "query_id", F.col("tax_year").alias("q_tax_year"), F.col("tax_types").alias("q_tax_types"), F.col("retrieval_text").alias("q_text"),
        F.col("procedural_intent").alias("q_procedural"), F.col("historical_intent").alias("q_historical"),
    )
    evidence = rerank(found.where(F.col("score") >= min_score).join(asked, "query_id"), max_evidence)
    wanted = evidence.where("q_procedural").select("query_id").distinct()
    own = image_found.where(F.col("score") >= min_score).join(wanted, "query_id", "left_semi").join(asked, "query_id")
    return evidence, rerank_images(own, evidence, max_images)


def with_year(questions: DataFrame, tax_year: Column) -> DataFrame:
    """Questions with the given period where they name none."""
    return questions.withColumn("tax_year", F.coalesce("tax_year", tax_year))

"""Ranked lexical search over documents that recursive graph bisection has reordered.

Documents that share terms are brought together: a set of documents is halved, and documents of the two halves are swapped as long as
that lowers the cost of writing down, for each term, the gaps between its documents; the halves are halved again. The first
levels are fitted on a bounded sample (`SAMPLE_ROWS` rows by a hash of the id, terms folded into `FEATURES` numbers); each node of
that tree sends a document to the half whose terms it shares, so that every row reaches a leaf. Leaves are dealt out in
ranges of bounded size, and within a range documents themselves are bisected down to shards of `SHARD` documents. A shard
holds its documents' ids and lengths, the postings of its terms and the best that each term reaches in it.

A block of questions is sent to all tasks. The sum of what its terms reach at best bounds a question's score in a shard.
A task visits shards by this bound, the highest first, and stops for a question once the bound is below its k-th
best score; so the result is exact. A first pass visits only the best shard of some, which gives a lower bound of the k-th score over all
tasks; the second takes it from there. Equal scores are ranked by doc_id, not by the place in the index, and a shard whose bound
equals the k-th score is visited for that reason.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, told apart by 64-bit hashes. With
N documents that have a term, L terms in all, n of them in a document and a term's df and tf, all in integers but w:
w = floor(1000 ln((2N+2) / (2df+1))), m = 75 + (25nN) div L, and a document's score is the sum over the question's terms,
repeats included, of w ((10^9 tf) div (1000 tf + 12 m)).

Null and empty texts have no terms: such documents are not counted and not found, such questions find nothing. Documents
with a null id count in the statistics and are not ranked. Each row is a document and each row of the questions a question, also
where ids repeat. Empty tables give empty results. Only the columns named are read. No text is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.llm._cluster import MAX_BITMAP_BITS, checkpointed, map_arrow, release_memory, text_slices
from corpusloom.llm._text import word_hashes

#: Bytes that end a term.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Rows of the sample on which the first levels are fitted, at most; numbers into which their terms are folded.
SAMPLE_ROWS, FEATURES = 8192, 1 << 13
#: Levels that are fitted on the sample, at most: their weights (8 MB) are sent to all tasks.
MAX_DEPTH = 8
#: Documents that are bisected at once, bytes of their terms, and documents of a shard.
CHUNK, CHUNK_BYTES, SHARD = 4096, 16 << 20, 128
#: Times that documents are swapped between two halves.
ROUNDS = 8
#: Questions of a block, and pairs of question and term in it.
BLOCK, BLOCK_PAIRS = 512, 1_000_000
#: Bytes of shards that a task puts in order at once.
HELD_BYTES = 16 << 20
_EXACT = 1 << 53


# Bisection


def halves(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, first: np.ndarray) -> np.ndarray:
    """Whether each of n_docs documents goes to the right half, from pairs (doc, term) sorted by doc; first: where they start."""
    right = np.zeros(n_docs, bool)
    right[n_docs // 2 :] = True
    sizes = (n_docs // 2, n_docs - n_docs // 2)
    begin = np.r_[0, np.cumsum(np.bincount(doc, minlength=n_docs))]
    if not len(doc):
        return right

    def cost(count: np.ndarray, side: int) -> np.ndarray:
        return count * np.log2(max(sizes[side], 1.0) / (count + 1.0))

    order = np.argsort(first, kind="stable")
    right[order] = right.copy()
    for _ in range(ROUNDS):
        on_right = np.bincount(term, weights=right[doc], minlength=n_terms)
        on_left = np.bincount(term, minlength=n_terms) - on_right
        now = cost(on_left, 0) + cost(on_right, 1)
        to_right = now - cost(np.maximum(on_left - 1, 0), 0) - cost(on_right + 1, 1)
        to_left = now - cost(on_left + 1, 0) - cost(np.maximum(on_right - 1, 0), 1)
        sums = np.r_[0.0, np.cumsum(np.where(right[doc], to_left[term], to_right[term]))]
        gain = sums[begin[1:]] - sums[begin[:-1]]
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = int(np.count_nonzero(np.logical_and.accumulate(gain[a[:n]] + gain[b[:n]] > 1e-9)))
        if not swap:
            break
        right[a[:swap]], right[b[:swap]] = True, False
    return right


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, leaf: int) -> np.ndarray:
    """The documents in an order in which those with like terms are near each other; leaves of `leaf` are left as they are."""
    lowest = np.full(n_docs, np.iinfo(np.int64).max)
    np.minimum.at(lowest, doc, (term * 0x9E3779B1) & 0xFFFFFFFF)
    todo, out = [(np.arange(n_docs), doc, term)], []
    while todo:
        docs, d, t = todo.pop()
        if len(docs) <= leaf:
            out.append(docs)
            continue
        right = halves(d, t, len(docs), n_terms, lowest[docs])
        place = np.where(right, np.cumsum(right) - 1, np.cumsum(~right) - 1)
        there = right[d]
        todo.append((docs[right], place[d[there]], t[there]))
        todo.append((docs[~right], place[d[~there]], t[~there]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fit_tree(features: list[np.ndarray], depth: int) -> np.ndarray:
    """Weights of the features at each node of a tree of `depth` levels (node k has the children 2k + 1 and 2k + 2): a
    document goes right where the weights of its features sum to more than 0."""
    weights = np.zeros(((1 << depth) - 1, FEATURES), np.float32)
    size = np.array([len(f) for f in features], np.int64)
    doc = np.repeat(np.arange(len(features)), size)
    term = np.concatenate(features).astype(np.int64) if features else np.zeros(0, np.int64)
    todo = [(0, np.arange(len(features)), doc, term)]
    while todo:
        node, docs, d, t = todo.pop()
        if node >= len(weights) or len(docs) < 2:
            continue
        lowest = np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(lowest, d, (t * 0x9E3779B1) & 0xFFFFFFFF)
        right = halves(d, t, len(docs), FEATURES, lowest)
        there = right[d]
        r, le = (np.bincount(t[x], minlength=FEATURES) for x in (there, ~there))
        weights[node] = np.log((r + 1.0) / (right.sum() + 1.0)) - np.log((le + 1.0) / ((~right).sum() + 1.0))
        place = np.where(right, np.cumsum(right) - 1, np.cumsum(~right) - 1)
        todo.append((2 * node + 2, docs[right], place[d[there]], t[there]))
        todo.append((2 * node + 1, docs[~right], place[d[~there]], t[~there]))
    return weights


def route(weights: np.ndarray, depth: int, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """The leaf, 0 to 2 ** depth - 1, of n documents with pairs (doc, feature)."""
    node = np.zeros(n, np.int64)
    for _ in range(depth):
        right = np.bincount(doc, weights=weights[node[doc], feature], minlength=n) > 0
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


# Index


@dataclass
class Index:
    """shards: the stored table of shards; unnamed: terms of the documents without an id; n_docs and n_terms: N and L."""

    shards: DataFrame
    unnamed: DataFrame
    n_docs: int
    n_terms: int


def _term_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all terms, each row's first term) of runs of rows."""
    for a, b, data, offsets in text_slices(column):
        words, first = word_hashes(data, offsets, BETWEEN)
        yield a, b, words, first


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column one after another, and where each row begins."""
    data = column.to_pylist()
    size = np.array([len(x) for x in data], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(data), kind), np.r_[0, np.cumsum(size)]


def term_bitmap(questions: DataFrame, text_col: str = "text") -> tuple[bytes, int]:
    """Bits of the hashes of all terms of the questions. Terms without their bit are not asked for; that some others have
    it costs room, never results, so that its size is bounded."""

    def hashes(batch):
        for _, _, words, _ in _term_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words).view(np.int64))], ["h"])

    found = checkpointed(map_arrow(questions.select(F.col(f"`{text_col}`").cast("string")), hashes, "h bigint").distinct())
    bits = 1 << max(20, min(MAX_BITMAP_BITS.bit_length() - 1, (16 * max(1, found.count())).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1  # bitmap functions number bits from 1
    out = bytearray(bits // 8)
    for r in found.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect():
        at = (r.b - 1) * 4096
        out[at : at + 4096] = bytes(r.m)[: len(out) - at]
    return bytes(out), bits


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: tuple[bytes, int] | None = None) -> Index:
    """The index of all rows; with `only` (see `term_bitmap`) it holds the postings of those terms alone."""
    sc = docs.sparkSession.sparkContext
    kept = sc.broadcast(only)

    def tokenised(batch):
        ids = batch.column(0)
        for a, b, words, first in _term_slices(batch.column(1)):
            if kept.value is not None:
                data, bits = kept.value
                place = words & np.uint64(bits - 1)
                has = (np.frombuffer(data, np.uint8)[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                bound = np.r_[0, np.cumsum(has)][first]
                words = words[has]
            else:
                bound = first
            terms, counts = [], []
            for i in range(b - a):
                t, c = np.unique(words[bound[i] : bound[i + 1]], return_counts=True)
                terms.append(t.tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = checkpointed(map_arrow(rows, tokenised, "doc_id bigint, n bigint, terms binary, tf binary"))
    n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranked = rows.where("doc_id is not null and n > 0")
    depth = min(MAX_DEPTH, (n_docs // CHUNK).bit_length())
    tree = sc.broadcast(fit_tree(_sampled(ranked, n_docs), depth) if depth else None)

    def routed(batch):
        leaf = np.zeros(batch.num_rows, np.int64)
        if depth:
            terms, begin = _flat(batch.column(2), np.uint64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            leaf = route(tree.value, depth, doc, (terms & np.uint64(FEATURES - 1)).astype(np.int64), batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    leaves = map_arrow(ranked, routed, StructType([*ranked.schema, StructField("leaf", IntegerType())])).withColumn("h", F.xxhash64("doc_id", "n"))
    dealt = leaves.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "leaf", "h").sortWithinPartitions("leaf", "h")
    shards = dealt.select("doc_id", "n", "terms", "tf").mapInArrow(lambda batches: _shards(batches, n_docs, n_terms), _SHARD_SCHEMA)
    return Index(checkpointed(shards), rows.where("doc_id is null").select("terms"), n_docs, n_terms)


def _sampled(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Folded terms of some SAMPLE_ROWS rows, chosen by a hash of their id."""

    def folded(batch):
        terms, begin = _flat(batch.column(0), np.uint64)
        f = (terms & np.uint64(FEATURES - 1)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([np.unique(f[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())], ["f"])

    share = -(-n // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(max(1, share))) == 0).select("terms")
    return [np.frombuffer(r.f, np.uint16) for r in map_arrow(some, folded, "f binary").limit(2 * SAMPLE_ROWS).collect()]


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if not len(n) or 25 * int(n.max()) * n_docs < 1 << 63:
        return 75 + (25 * n.astype(np.int64) * n_docs) // max(1, n_terms)
    return np.array([75 + 25 * int(x) * n_docs // max(1, n_terms) for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


_SHARD_SCHEMA = "ids binary, terms binary, begin binary, docs binary, impact binary, best binary"


def _shards(batches, n_docs: int, n_terms: int):
    """Rows of `_SHARD_SCHEMA`: shards of documents, bisected in chunks of bounded size."""
    ids, n, terms, tf, held = [], [], [], [], 0

    def made():
        size = np.array([len(t) // 8 for t in terms], np.int64)
        doc = np.repeat(np.arange(len(ids)), size)
        flat, count = np.frombuffer(b"".join(terms), np.uint64), np.frombuffer(b"".join(tf), np.int32)
        names, term = np.unique(flat, return_inverse=True)
        order = bisected(doc, term, len(ids), len(names), SHARD)
        value = impacts(count, lengths(np.array(n, np.int64), n_docs, n_terms)[doc])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        by = np.lexsort((rank[doc], term, rank[doc] // SHARD))
        at, term, value = rank[doc][by], term[by], value[by]
        own = np.array(ids, np.int64)[order]
        bounds = np.searchsorted(at // SHARD, np.arange(-(-len(ids) // SHARD) + 1))
        rows = []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            begin = np.flatnonzero(np.r_[True, term[a:b][1:] != term[a:b][:-1]]) if b > a else np.zeros(0, np.int64)
            best = np.maximum.reduceat(value[a:b], begin) if b > a else value[a:b]
            rows.append((own[k * SHARD : (k + 1) * SHARD].tobytes(), names[term[a:b][begin]].tobytes(), np.r_[begin, b - a].astype(np.int32).tobytes(),
                (at[a:b] - k * SHARD).astype(np.uint8 if SHARD <= 256 else np.uint16).tobytes(), value[a:b].tobytes(), best.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["ids", "terms", "begin", "docs", "impact", "best"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            ids.append(row[0]), n.append(row[1]), terms.append(row[2]), tf.append(row[3])
            held += len(row[2])
            if len(ids) >= CHUNK or held >= CHUNK_BYTES:
                yield made()
                ids, n, terms, tf, held = [], [], [], [], 0
    if ids:
        yield made()
    release_memory()


# Search


@dataclass(frozen=True)
class Block:
    """Questions 0 to n - 1: their terms (sorted hashes) and pairs (question, term, weight times repeats), sorted by question;
    least: a score that the k-th best of each reaches."""

    n: int
    terms: np.ndarray
    question: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    least: np.ndarray


class Best:
    """The k best documents of each question so far."""

    def __init__(self, block: Block, k: int):
        self.k, self.least = k, np.maximum(block.least, 1)
        self.question, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, question: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        q, s, d = (np.r_[a, b] for a, b in ((self.question, question), (self.score, score), (self.doc, doc)))
        by = np.lexsort((d, -s, q))
        q, s, d = q[by], s[by], d[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])
        self.question, self.score, self.doc = (x[rank < self.k] for x in (q, s, d))


class Shard:
    """A row of `_SHARD_SCHEMA` with its terms found among those of a block."""

    def __init__(self, row: tuple, block: Block):
        ids, terms, begin, docs, impact, best = row
        self.ids, self.begin = np.frombuffer(ids, np.int64), np.frombuffer(begin, np.int32).astype(np.int64)
        self.docs, self.impact = np.frombuffer(docs, np.uint8 if SHARD <= 256 else np.uint16), np.frombuffer(impact, np.int64)
        own = np.frombuffer(terms, np.uint64)
        at = np.minimum(np.searchsorted(own, block.terms), max(0, len(own) - 1))
        has = own[at] == block.terms if len(own) else np.zeros(len(block.terms), bool)
        self.place = np.where(has, at, -1)
        self.best = np.where(has, np.frombuffer(best, np.int64)[at] if len(own) else 0, 0)

    def scores(self, block: Block, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, score, doc id) of the scores above 0 of the questions for which `asked` is true."""
        number = np.cumsum(asked) - 1
        use = asked[block.question] & (self.place[block.term] >= 0)
        q, t, w = number[block.question[use]], self.place[block.term[use]], block.weight[use]
        count = self.begin[t + 1] - self.begin[t]
        flat = np.repeat(self.begin[t] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(t) else np.zeros(0, np.int64)
        n = len(self.ids)
        cell, value = np.repeat(q, count) * n + self.docs[flat], np.repeat(w, count) * self.impact[flat]
        if float(value.sum(dtype=float)) < _EXACT:  # sums of whole numbers below this are exact
            total = np.bincount(cell, weights=value, minlength=int(asked.sum()) * n).astype(np.int64)
        else:
            total = np.zeros(int(asked.sum()) * n, np.int64)
            np.add.at(total, cell, value)
        at = np.flatnonzero(total > 0)
        return np.flatnonzero(asked)[at // n], total[at], self.ids[at % n]


def visit(rows: list[tuple], block: Block, best: Best, first_only: bool = False) -> int:
    """Searches shards for all questions, each by falling bound until it stops; returns the number of visits."""
    shards = [Shard(r, block) for r in rows]
    starts = np.flatnonzero(np.r_[True, block.question[1:] != block.question[:-1]])
    bound = np.zeros((len(shards), block.n), np.int64)
    for k, s in enumerate(shards):
        bound[k, block.question[starts]] = np.add.reduceat(block.weight * s.best[block.term], starts)
    order = np.argsort(-bound, axis=0, kind="stable")
    visits, at, step = 0, 0, 1
    while at < len(shards):
        chosen = order[at : at + step]
        live = np.take_along_axis(bound, chosen, 0) >= best.least
        if not live.any():
            break
        found = []
        for k in np.unique(chosen[live]).tolist():
            asked = ((chosen == k) & live).any(0)
            visits += int(asked.sum())
            q, s, d = shards[k].scores(block, asked)
            keep = s >= best.least[q]
            found.append((q[keep], s[keep], d[keep]))
        best.add(*(np.concatenate(x) for x in zip(*found)))
        if first_only:
            break
        at, step = at + step, 2 * step
    return visits


def _task_best(index: Index, shared, k: int, first_only: bool) -> DataFrame:
    """(q, doc_id, score): the k best of each question within each task."""

    def run(batches):
        block = shared.value
        best, held, size = Best(block, k), [], 0
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            size += batch.nbytes
            if size >= HELD_BYTES:
                visit(held, block, best, first_only)
                held, size = [], 0
        if held:
            visit(held, block, best, first_only)
        yield pa.RecordBatch.from_arrays([pa.array(best.question.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], ["q", "doc_id", "score"])
        release_memory()

    return index.shards.mapInArrow(run, "q int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, k: int, by: list) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_frequencies(index: Index) -> DataFrame:
    """(term, df) of the terms of an index, as signed numbers."""

    def counted(batches):
        for batch in batches:
            for terms, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(begin, np.int32)).astype(np.int64))],
                    ["term", "n"])

    def once(batch):
        terms, _ = _flat(batch.column(0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.ones(len(terms), np.int64))], ["term", "n"])

    found = index.shards.select("terms", "begin").mapInArrow(counted, "term bigint, n bigint")
    return found.unionByName(map_arrow(index.unnamed, once, "term bigint, n bigint")).groupBy("term").agg(F.sum("n").alias("df"))


def _question_blocks(questions: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """(ids, [(terms, repeats)]) of blocks of questions, each collected for itself: all questions are never on the driver."""

    def hashed(batch):
        at, terms, counts = [], [], []
        for a, b, words, first in _term_slices(batch.column(1)):
            for i in range(b - a):
                if first[i + 1] > first[i]:
                    t, c = np.unique(words[first[i] : first[i + 1]], return_counts=True)
                    at.append(a + i), terms.append(t.tobytes()), counts.append(c.astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
            ["item_id", "terms", "counts"])

    rows = questions.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([rows.schema[0], *StructType.fromDDL("terms binary, counts binary")])
    rows = checkpointed(map_arrow(rows, hashed, schema))
    n, pairs = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("terms") / 8), F.lit(0.0))).first()
    parts = max(1, -(-n // BLOCK), math.ceil(pairs / BLOCK_PAIRS))
    for p in range(parts):
        own = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == p)).collect()
        for a in range(0, len(own), 2 * BLOCK):  # equal rows have equal hashes
            some = own[a : a + 2 * BLOCK]
            yield [r["item_id"] for r in some], [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in some]


def search(index: Index, questions: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each question with a score above 0."""
    spark = questions.sparkSession
    frequencies = checkpointed(document_frequencies(index))
    item = StructField("item_id", questions.schema[id_col].dataType)
    out = []
    for ids, asked in _question_blocks(questions, id_col, text_col):
        terms = np.unique(np.concatenate([t for t, _ in asked]))
        names = spark.createDataFrame([(x,) for x in terms.view(np.int64).tolist()], "term bigint")
        df = {r.term: r.df for r in frequencies.join(F.broadcast(names), "term", "left_semi").collect()}
        w = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[x] + 1))) if x in df else 0 for x in terms.view(np.int64).tolist()], np.int64)
        size = np.array([len(t) for t, _ in asked])
        term = np.searchsorted(terms, np.concatenate([t for t, _ in asked]))
        block = Block(len(asked), terms, np.repeat(np.arange(len(asked)), size), term, w[term] * np.concatenate([c for _, c in asked]), np.zeros(len(asked), np.int64))
        # a first visit of each task gives what the k-th best score is at least
        seen = _task_best(index, spark.sparkContext.broadcast(block), k, True).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        least = np.zeros(len(asked), np.int64)
        for r in _ranked(_ranked(seen, k, ["q", "part"]), k, ["q"]).where(F.col("rank") == k).collect():
            least[r.q] = r.score
        found = _task_best(index, spark.sparkContext.broadcast(replace(block, least=least)), k, False)
        own = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), item]))
        out.append(_ranked(found, k, ["q"]).join(F.broadcast(own), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], StructType([item, *StructType.fromDDL("rank int, doc_id bigint, score bigint")]))
    return reduce(DataFrame.unionByName, out)

"""N-gram Jaccard self-join of texts, exact, with count-vector R-trees.

1. A text's set holds the hashes of its distinct word shingles; texts with equal sets form a class, which goes on
   as one row. Links between different classes are sought as follows.
2. Blocking. Shingles are hashed into G groups. Sets that meet the threshold differ in at most D shingles, so with
   more than D non-empty groups one group at least has the same content in both: a class emits a signature of each
   group's content, and similar classes share one. G depends on the size (two sizes' worth near a border between
   size ranges). Very frequent shingles, found in a bounded sample, are left out of groups so that common passages
   don't make signatures; any set of such shingles gives the same result. A class with too few non-empty groups
   also emits the shingles of a prefix of its set, of which two similar sets share one.
3. The counts of a class's shingles in hashed groups are a point. The overlap of two sets is at most the sum of the
   smaller of each two counts. Points have enough groups for their set, some 2 to 8 shingles in each, for with
   fuller groups unrelated sets of like size pass the bound. Within a signature's classes the pairs that the bound
   allows are connected by a spanning forest; the forests' components are candidates, and their sets are gathered by
   component. Signatures of more than `FOREST` classes are dealt out as pairs of blocks of that many, components as
   pairs of blocks that are bounded in classes and in bytes, so no key makes a task large.
4. In a task the points are packed into an R-tree, whose nodes keep the largest counts below them, so that the
   bound rules out whole nodes; surviving pairs are verified on the sets. A task returns link counts and a spanning
   forest, never pairs.

Two texts link when den * |A & B| >= num * |A | B|. Null texts and texts without words have an empty set, are
linked with nothing and are their own component. Texts of any length are read whole; broken UTF-8 is read with U+FFFD
for broken bytes. Equal rows link with one another. Null ids take part; a component
is named by its smallest id that is not null. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import BROADCAST_ROWS, checkpointed, connected_components, hash_bitmap, in_bitmap, map_arrow, packed_rows, text_slices, with_row
from corpusloom.llm._text import mix, shingle_sets


@dataclass(frozen=True)
class Spec:
    """width: words of a shingle; num / den: the threshold; seed: of the hashes that name classes."""

    width: int = 5
    num: int = 80
    den: int = 100
    seed: int = 0

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which sets of these sizes that link can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def partner(self, a: int) -> int:
        """The largest set that can link with one of size a."""
        return a * self.den // self.num

    def overlap(self, a, b):
        """The least overlap of sets of these sizes that link."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def overlap_of_self(self, n: int) -> int:
        """The least overlap of a set of size n with any set that links with it."""
        return -(-self.num * n // self.den)

    def level(self, size: int) -> int:
        """The range of sizes: [2**k, 2**(k + 1))."""
        return size.bit_length() - 1

    def groups(self, level: int) -> int:
        """Groups for pairs whose smaller set is in this range."""
        top = (2 << level) - 1
        d = self.differ(top, self.partner(top))
        return d + 4 + d // 6 if d else 1


def signatures(u: np.ndarray, spec: Spec, hot: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set of shingle hashes; `hot` are sorted hashes that groups leave out."""
    n = len(u)
    if n == 0 or spec.differ(n, spec.partner(n)) == 0 and (n < 2 or spec.differ(n - 1, n) == 0):
        return np.zeros(0, np.uint64)
    cold = u
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        cold = u[hot[at] != u]
    need = spec.differ(n, spec.partner(n)) + 1
    level = spec.level(n)
    levels = [level]
    if level and n * spec.num <= ((1 << level) - 1) * spec.den:
        levels.append(level - 1)
    out, short = [], False
    content = mix(cold + np.uint64(spec.width))
    for k in levels:
        g = spec.groups(k)
        group = ((cold >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(cold) else np.zeros(0, np.int64)
        short |= len(first) < need
        if len(first):
            out.append(mix(np.add.reduceat(content, first) + (group[first] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 50)))
    if short:
        late = np.zeros(n, bool)
        if len(hot):
            late = hot[at] == u
        order = np.lexsort((u, late))
        out.append(mix(u[order[: n - spec.overlap_of_self(n) + 1]] ^ np.uint64(0x5DEECE66D1234567)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _name(u: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(u.tobytes(), digest_size=16, salt=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def named_sets(docs: DataFrame, spec: Spec, id_col: str, text_col: str, with_set: bool) -> DataFrame:
    """(doc, n, k1, k2, shingles or point): each row's id, size of its set, the set's 128-bit name and the set itself
    or its group counts."""
    extra = "shingles" if with_set else "point"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batch):
        for a, b, data, offsets in text_slices(batch.column(1)):
            sets = list(shingle_sets(data, offsets, spec.width))
            names = [_name(u, spec.seed) for u in sets]
            cols = [batch.column(0).slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()),
                    pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64())]
            cols.append(pa.array([u.tobytes() if with_set else point_of(u) for u in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc", "n", "k1", "k2", extra])

    return map_arrow(rows, run, with_row(rows, f"n bigint, k1 bigint, k2 bigint, {extra} binary", "doc"))


def frequent_shingles(docs: DataFrame, spec: Spec, id_col: str, text_col: str, sample: int, share: float) -> np.ndarray:
    """Sorted hashes of shingles in more than `share` of about `sample` texts, picked by a hash of the id."""
    n = docs.count()
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < F.lit(int(min(1, sample / max(1, n)) * (1 << 30)))).select(id_col, text_col)
    least = max(4, int(share * min(n, sample)))

    def run(batch):
        parts = [u for _, _, data, offsets in text_slices(batch.column(1)) for u in shingle_sets(data, offsets, spec.width)]
        uniq, count = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(count, pa.int64())], ["h", "c"])

    counted = map_arrow(rows.select(F.col(id_col), F.col(text_col).cast("string")), run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    found = counted.where(F.col("c") >= least).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def _signature_rows(docs: DataFrame, spec: Spec, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(sig, k1) of every class. Copies of a class within a task are passed over, with a memory of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    seen: set[int] = set()

    def run(batch):
        for _, _, data, offsets in text_slices(batch.column(1)):
            sig, key = [], []
            for u in shingle_sets(data, offsets, spec.width):
                k1 = _name(u, spec.seed)[0]
                if k1 in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(k1)
                s = signatures(u, spec, shared.value)
                sig.append(s)
                key.append(np.full(len(s), k1, np.int64))
            if sig:
                flat = np.concatenate(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(key))], ["sig", "k1"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, "sig bigint, k1 bigint")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, k1): the classes of every signature that several have; equal lists of classes are one bucket.

    One shuffle of the signatures. A signature's classes are hashed to name its bucket; beyond `_LONG` of them they
    are streamed on under the signature's own name.
    """
    ordered = rows.repartition("sig").sortWithinPartitions("sig", "k1")

    def run(batches):
        for sig, (key,), whole in _aligned(batches, 1):
            new = np.r_[True, sig[1:] != sig[:-1]]
            fresh = new | np.r_[True, key[1:] != key[:-1]]
            sig, key = sig[fresh], key[fresh]
            first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[first, len(sig)])
            if whole:
                name = mix(np.add.reduceat(mix(key.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
                keep = np.repeat(size > 1, size)
            else:
                name, keep = mix(sig[first].view(np.uint64) + np.uint64(1)).view(np.int64), np.ones(len(sig), bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep]), pa.array(key[keep])], ["bucket", "k1"])

    return ordered.mapInArrow(run, "bucket bigint, k1 bigint").distinct()


#: Rows of one group that a task holds at once.
_LONG = 200_000


def _aligned(batches, width: int):
    """(keys, other columns, whole) with all rows of a key together, from batches sorted by their first column.

    A key with more than _LONG rows comes in parts, with whole = False, all of which begin with its first row.
    """
    hold, torn = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        hold = table if hold is None else pa.concat_tables([hold, table])
        key = hold.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        if torn and key[0] != key[-1]:
            end = int(np.searchsorted(key, key[0], side="right"))
            yield key[:end], _columns(hold.slice(0, end), width), False
            hold, torn = hold.slice(end), False
            key, at = key[end:], at - end
        if at:
            yield key[:at], _columns(hold.slice(0, at), width), True
            hold, key = hold.slice(at), key[at:]
        if len(key) > _LONG:
            yield key, _columns(hold, width), False
            hold, torn = hold.slice(0, 1), True
    if hold is not None and hold.num_rows:
        yield hold.column(0).to_numpy(), _columns(hold, width), not torn


def _columns(table: pa.Table, width: int) -> tuple:
    return tuple(
        c.to_numpy() if not pa.types.is_binary(c.type) else c.to_pylist() for c in (table.column(k + 1) for k in range(width))
    )


def dims_for(n: int) -> int:
    """Groups of a point of a set of n shingles: 64 times a power of four, so that some 2 to 8 fall into each."""
    dims = 64
    while n > 8 * dims:
        dims *= 4
    return dims


def point_of(u: np.ndarray) -> bytes:
    """Counts of a set's shingles in hashed groups, a byte each (255: that many or more)."""
    dims = dims_for(len(u))
    place = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(dims)) >> np.uint64(32)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=dims), 255).astype(np.uint8).tobytes()


def allowed_forest(points: list[bytes], sizes: np.ndarray, spec: Spec) -> tuple[list[int], list[int]]:
    """A spanning forest (places a, b) of the pairs of points whose counts allow a link."""
    kinds: dict[int, list[int]] = {}
    for k, p in enumerate(points):
        kinds.setdefault(len(p), []).append(k)
    rows = {dims: np.array(at) for dims, at in kinds.items()}
    counts = {}  # (groups of a point, groups that it is compared in) -> counts of all such points
    for dims, at in rows.items():
        own = np.frombuffer(b"".join([points[k] for k in at]), np.uint8).reshape(len(at), dims)
        for less in rows:
            if less <= dims:
                counts[dims, less] = own.reshape(len(at), less, -1).sum(2, dtype=np.int32)
        counts[dims] = (own == 255).any(1)
    within = np.empty(len(points), np.int64)
    for at in rows.values():
        within[at] = np.arange(len(at))
    open_ = np.ones(len(points), bool)
    left, right = [], []
    for root in range(len(points)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            n, dims = int(sizes[i]), len(points[i])
            for other, at in rows.items():
                at = at[open_[at] & (sizes[at] >= spec.overlap_of_self(n)) & (sizes[at] <= spec.partner(n))]
                if not len(at):
                    continue
                least = min(dims, other)
                shared = np.minimum(counts[other, least][within[at]], counts[dims, least][within[i]]).sum(1)
                ok = at[(shared >= spec.overlap(n, sizes[at])) | counts[other][within[at]] | counts[dims][within[i]]]
                open_[ok] = False
                left += [i] * len(ok)
                right += ok.tolist()
                queue += ok.tolist()
    return left, right


#: Classes of a block of one signature; more are dealt out as pairs of blocks.
FOREST = 512


def dealt_pairs(rows: DataFrame, blocks: str, key: str, own_pairs: bool) -> DataFrame:
    """`rows` with own (a block from 0 to `blocks` - 1 by a hash of `key`) once for each pair x <= y of blocks that has
    it. own_pairs: also x = y where there are several blocks."""
    others = F.sequence(F.lit(0), F.col(blocks) - 1)
    if not own_pairs:
        others = F.filter(others, lambda o: (o != F.col("own")) | (F.col(blocks) == 1))
    pair = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")).withColumn("pair", F.explode(pair))
    return dealt.select(*rows.columns, "own", "pair.x", "pair.y")


def candidate_edges(buckets: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): a spanning forest, for each bucket, of the pairs that their group counts allow to link.

    Two classes that link share a bucket and are allowed by their counts, so they are connected by these edges. A
    bucket of more than FOREST classes is dealt out as pairs of blocks: any two of its classes meet in one task, and
    none holds more than about two blocks.
    """
    large = checkpointed(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > FOREST).select(
        "bucket", F.ceil(F.col("n") / FOREST).cast("int").alias("blocks")))
    n_large = large.count()
    sized = buckets.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "bucket", "left").withColumn("blocks",
        F.coalesce("blocks", F.lit(1)))
    dealt = dealt_pairs(sized, "blocks", "k1", False).select(F.xxhash64("bucket", "x", "y").alias("part"), "k1")
    ordered = dealt.join(classes.select("k1", "n", "point"), "k1").select("part", "k1", "n", "point").repartition("part").sortWithinPartitions("part",
        "k1")

    def run(batches):
        for part, (key, n, point), _ in _aligned(batches, 3):
            first = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            left, right = [], []
            for a, b in zip(first[:-1], first[1:]):
                x, y = allowed_forest(point[a:b], n[a:b], spec)
                left += key[a:b][x].tolist()
                right += key[a:b][y].tolist()
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


class CountRTree:
    """Points are counts of a set's shingles in hashed groups, as many as the largest set needs; a node keeps the
    largest counts below it."""

    def __init__(self, sets: list[np.ndarray], spec: Spec, dims: int = 0, fan: int = 16):
        self.sets, self.spec, self.fan = sets, spec, fan
        self.n = np.array([len(u) for u in sets], np.int64)
        dims = dims or dims_for(int(self.n.max(initial=0)))
        self.points = np.zeros((len(sets), dims), np.int32)
        for i, u in enumerate(sets):
            place = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(dims)) >> np.uint64(32)
            self.points[i] = np.bincount(place.astype(np.int64), minlength=dims)
        # packed by size, then by the widest coordinates
        wide = np.argsort(-self.points.var(0), kind="stable")[:3]
        self.order = np.lexsort((*[self.points[:, w] for w in wide], self.n // max(1, int(self.n.mean() // 8 or 1))))
        self.levels = []
        high, least, most = self.points[self.order], self.n[self.order], self.n[self.order]
        while len(high) > fan:
            cut = np.arange(0, len(high), fan)
            high, least, most = np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((high, least, most))
        code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
        self.code, self.start = code, np.r_[0, np.cumsum(self.n)]
        self.mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)

    def survivors(self, i: int) -> np.ndarray:
        """Points whose counts allow the overlap that a link with point i needs."""
        point, n = self.points[i], self.n[i]
        lo, hi = self.spec.overlap_of_self(int(n)), self.spec.partner(int(n))
        nodes = None
        for high, least, most in reversed(self.levels):
            at = np.arange(len(high)) if nodes is None else self._below(nodes, len(high))
            bound = np.minimum(high[at], point).sum(1)
            fits = (bound >= self.spec.overlap(n, np.maximum(least[at], lo))) & (least[at] <= hi) & (most[at] >= lo)
            nodes = at[fits]
        at = np.arange(len(self.order)) if nodes is None else self._below(nodes, len(self.order))
        at = self.order[at]
        return at[(np.minimum(self.points[at], point).sum(1) >= self.spec.overlap(n, self.n[at])) & (self.n[at] >= lo) & (self.n[at] <= hi)]

    def _below(self, nodes: np.ndarray, n: int) -> np.ndarray:
        at = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        return at[at < n]

    def links(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` that link with point i, by their sets."""
        if not len(among):
            return among
        own = self.code[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        size = self.n[among]
        flat = np.repeat(self.start[among] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        shared = np.add.reduceat(self.mark[self.code[flat]].astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
        self.mark[own] = False
        return among[self.spec.den * shared >= self.spec.num * (self.n[i] + size - shared)]


def join_local(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(linked rows, representative) of each set. side: 0 and 1 for the two blocks of a pair, of which only links
    across count, or all 0 for links within one block. Representatives are places of sets."""
    tree = CountRTree(sets, spec)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    count = np.zeros(len(sets), np.int64)
    cross = bool(side.any())
    for i in range(len(sets)):
        among = tree.survivors(i)
        among = among[(among > i) & ((side[among] != side[i]) if cross else True)]
        for j in tree.links(i, among):
            count[i] += copies[j]
            count[j] += copies[i]
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return count, np.array([find(i) for i in range(len(sets))], np.int64)


def jaccard_components(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`id_col`, n_shingles, component_id, n_links, class_size, set_key and component_key for each row of `docs`.

    component_id: the smallest id reachable by links, itself included; n_links: rows linked with this row, its
    copies included; class_size: rows with the same set; set_key, component_key: names of the set and of the
    component, also where ids are null or repeated (null for an empty set). Options as of `self_join`.
    """
    return self_join(docs, spec, id_col, text_col, **options)[0]


def self_join(docs: DataFrame, spec: Spec, id_col: str, text_col: str, block: int = 4096, block_bytes: int = 16 << 20,
              hot_sample: int = 5000, hot_share: float = 0.002) -> tuple[DataFrame, Spec]:
    """What `jaccard_components` returns, and the spec with the seed that names sets.

    block, block_bytes: classes and bytes of shingles in a block, of which a task compares two; hot_sample, hot_share:
    shingles in more than that share of that many sampled texts make no signatures, which changes the cost only.
    """
    for seed in range(8):
        spec = Spec(spec.width, spec.num, spec.den, seed)
        rows = checkpointed(named_sets(docs, spec, id_col, text_col, False))
        classes = checkpointed(rows.where("n > 0").groupBy("k1").agg(
            F.min("doc").alias("cid"), F.count("*").alias("copies"), F.min("k2").alias("k2"), F.max("k2").alias("k2max"),
            F.first("n").alias("n"), F.first("point").alias("point"),
        ))
        if not classes.where("k2 <> k2max").head(1):  # else two classes share a name: take other names
            break
    else:
        raise RuntimeError("class names collide under every seed")
    hot = frequent_shingles(docs, spec, id_col, text_col, hot_sample, hot_share)
    buckets = checkpointed(shared_buckets(_signature_rows(docs, spec, hot, id_col, text_col)))
    edges = candidate_edges(buckets, classes, spec)
    found = checkpointed(connected_components(edges))
    members = checkpointed(found.select(F.col("node").alias("k1"), F.col("root")).join(classes.select("k1", "cid", "copies", "n"), "k1"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / block_bytes)).cast("int")
    members = checkpointed(members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root"))

    n_members = members.count()
    bitmap, bits = hash_bitmap(members.where("cid is not null"), "cid", n_members)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    likely = docs.select(id_col, text_col).where(in_bitmap(id_col, shared, bits) | F.col(id_col).isNull())
    sets = named_sets(likely, spec, id_col, text_col, True).select(F.col("doc"), F.col("k1"), "shingles")
    gathered = sets.join(members, (sets.k1 == members.k1) & sets.doc.eqNullSafe(members.cid)).select(
        members.k1.alias("k1"), "root", "copies", "blocks", "shingles"
    ).groupBy("k1").agg(*[F.first(c).alias(c) for c in ("root", "copies", "blocks", "shingles")])
    dealt = dealt_pairs(gathered, "blocks", "k1", True).select("root", "x", "y", "own", "k1", "copies", "shingles")

    def local(table: pa.Table) -> pa.Table:
        k1 = table["k1"].to_numpy()
        order = np.argsort(k1)
        k1 = k1[order]
        blobs = table["shingles"].to_pylist()
        data = [np.frombuffer(blobs[i], np.uint64) for i in order]
        x, y, mine = table["x"][0].as_py(), table["y"][0].as_py(), table["own"].to_numpy()[order]
        side = (mine == y).astype(np.int8) if x != y else np.zeros(len(k1), np.int8)
        count, rep = join_local(data, table["copies"].to_numpy()[order], side, spec)
        return pa.table({"k1": k1, "rep": k1[rep], "links": count, "split": [x != y or bool(y)] * len(k1)})

    parts = checkpointed(dealt.groupBy("root", "x", "y").applyInArrow(local, "k1 bigint, rep bigint, links bigint, split boolean"))
    links = parts.groupBy("k1").agg(F.sum("links").alias("links"), F.min("rep").alias("rep"), F.max("split").alias("split"))
    whole = links.where("not split").select("k1", "rep", "links")
    if parts.where("split").head(1):
        forest = parts.select(F.col("k1").alias("a"), F.col("rep").alias("b")).where("a <> b")
        joined = connected_components(forest).withColumnRenamed("node", "k1")
        torn = links.where("split").select("k1", "links").join(joined, "k1", "left").select("k1", F.coalesce("root", "k1").alias("rep"), "links")
        whole = whole.unionByName(torn)
    named = whole.join(classes.select("k1", "cid"), "k1").groupBy("rep").agg(F.min("cid").alias("component"))
    labelled = whole.join(named, "rep").select("k1", "component", "rep", "links")
    known = checkpointed(classes.join(labelled, "k1", "left").select(
        "k1", "copies", F.coalesce("component", "cid").alias("component"), F.coalesce("rep", "k1").alias("rep"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    ))
    out = rows.select("doc", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1")).join(known, "k1", "left")
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("class_size"), F.col("k1").alias("set_key"),
        F.col("rep").alias("component_key"),
    ), spec


def one_per_component(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that are the first of their component or have no words.

    First is the smallest id, nulls last, then the smallest set name; of rows that agree in both, one stays. Rows
    whose id is not among the dropped ones, by a bitmap of bounded size, pass without a shuffle; the others are
    settled by exact joins.
    """
    judged, spec = self_join(docs.select(F.col(id_col), F.col(text_col)), spec, id_col, text_col, **options)
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("set_key").alias("key"))
    rows = checkpointed(judged.where("set_key is not null").select("component_key", F.col(id_col).eqNullSafe(F.col("component_id")).alias("least"),
        place.alias("place")))
    # rows with the smallest id of their component are few; only they are compared with one another
    low = rows.where("least")
    firsts = low.groupBy("component_key").agg(F.min("place.key").alias("first"))
    told = low.join(firsts, "component_key").select("place", (F.col("place.key") != F.col("first")).alias("lost"))
    others = rows.where("not least").select("place", F.lit(True).alias("lost"))
    marked = checkpointed(told.unionByName(others).groupBy("place").agg(F.max("lost").alias("lost"), F.count("*").alias("n")))
    settle = marked.where("lost or n > 1").select(F.col("place.id").alias("id"), F.col("place.key").alias("key"), "lost")
    bitmap, bits = hash_bitmap(settle.where("id is not null"), "id", settle.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    flagged = in_bitmap(id_col, shared, bits) | F.col(id_col).isNull()
    packed = packed_rows(docs.where(flagged), text_col, tuple(docs.columns))

    def named(batch):
        for a, b, data, offsets in text_slices(batch.column(1)):
            sets = list(shingle_sets(data, offsets, spec.width))
            keys = [_name(u, spec.seed)[0] if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64())], ["row", "_key"])

    unsure = map_arrow(packed, named, with_row(packed, "_key bigint"))
    unsure = unsure.withColumn("_id", F.col(f"row.`{id_col}`"))
    lost = settle.where("lost")
    stay = unsure.join(lost, unsure["_id"].eqNullSafe(lost["id"]) & (unsure["_key"] == lost["key"]), "left_anti")
    once = stay.where("_key is not null").groupBy("_id", "_key").agg(F.first("row").alias("row")).select("row.*")
    return docs.where(~flagged).unionByName(once).unionByName(stay.where("_key is null").select("row.*"))

"""URL filters with Bloom filter cascades.

A list of keys is stored as alternating Bloom filters: the first holds the listed keys, the second those keys of
the corpus that the first takes for listed by mistake, the third the listed keys that the second takes for those,
and so on until no mistake is left. Over the corpus's complete key universe membership is then exact, and it is
tested on the executors from a few broadcast bytes, without a join.

Keys of a url are its host and the parent domains of as many labels as listed ones have, alone (lists of hosts) and
followed by the first characters of its path (rules such as `example.com/en/7`); no other key can be listed, so a
url has a bounded number of keys however many labels its host has. The longest rule that fits decides (of equally
long ones block before allow, then the first in order); where no rule fits, the list of hosts does.

The cascades of one pass are broadcast and bounded in size. Lists that need more are split by a hash of their keys,
and the urls are read once for each part; what a pass found is checkpointed and carried into the next one.

Null urls and urls without `://` have an empty host and path and fit nothing: they are allowed. Equal urls are
judged alike. Empty lists fit nothing; an empty table has no universe. The id column may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import checkpointed, map_arrow, with_row
from corpusloom.llm._text import mix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the cascades that are broadcast at once.
MAX_BYTES = 64 << 20


def hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 hash bits of each string."""
    keys = np.asarray(keys, object)
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    one = pd.util.hash_array(keys, hash_key="0123456789123456", categorize=False)
    two = pd.util.hash_array(keys, hash_key="fedcba9876543210", categorize=False)
    return one, two | np.uint64(1)


@dataclass
class Bloom:
    """One level: m bits, k places for each key."""

    bits: np.ndarray
    k: int
    level: int

    @classmethod
    def of(cls, h, level: int, p: float) -> Bloom:
        n = max(1, len(h[0]))
        k = max(1, round(-np.log2(p)))
        out = cls(np.zeros(max(8, int(np.ceil(n * k / np.log(2) / 8))), np.uint8), k, level)
        for at in out._places(h):
            np.bitwise_or.at(out.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return out

    def _places(self, h):
        one = mix(h[0] + np.uint64(self.level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for j in range(self.k):
            yield ((one + np.uint64(j) * h[1]) % np.uint64(8 * len(self.bits))).astype(np.int64)

    def test(self, h) -> np.ndarray:
        out = np.ones(len(h[0]), bool)
        for at in self._places(h):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


@dataclass
class Cascade:
    """Alternating levels; exact for every key of the universe that it was built over."""

    levels: list[Bloom] = field(default_factory=list)

    def test(self, h) -> np.ndarray:
        """Boolean for each key: listed."""
        n = len(h[0])
        out = np.zeros(n, bool)
        open_ = np.arange(n)
        for i, level in enumerate(self.levels):
            inside = level.test((h[0][open_], h[1][open_]))
            out[open_[~inside]] = i % 2 == 1
            open_ = open_[inside]
        out[open_] = len(self.levels) % 2 == 1
        return out

    def complete(self, listed: np.ndarray, mistaken: np.ndarray) -> None:
        """Adds levels to the first one; mistaken: the universe's unlisted keys that the first level lets through."""
        here, there = hashes(mistaken), hashes(listed)
        while len(here[0]):
            if len(self.levels) > 64:
                raise ValueError("two keys share all 128 hash bits")
            level = Bloom.of(here, len(self.levels), 0.5)
            self.levels.append(level)
            through = level.test(there)
            here, there = (there[0][through], there[1][through]), here

    def size(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first `://`, A-Z lower-cased; the path up to `?`, `#` or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """The keys of a url: domains of those numbers of labels with path prefixes of those lengths (0: the domain alone)."""
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    n_labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    tails = F.array_compact(F.array(*[F.when((host != "") & (n_labels >= n), F.substring_index(host, ".", -n)) for n in label_counts]))
    fitting = F.filter(lengths, lambda n: F.length(path) >= n)
    return F.flatten(F.transform(tails, lambda t: F.transform(fitting, lambda n: F.concat(t, F.substring(path, F.lit(1), n)))))


def first_level_rate(n_listed: int, n_universe: int) -> float:
    """The share of unlisted keys that a first level lets through, so that about as many pass as are listed."""
    return min(0.5, max(2.0**-40, n_listed / max(1, n_universe)))


def build_cascades(universe: DataFrame, lists: dict[str, list[str]], key_col: str = "key", total: int | None = None) -> dict[str, Cascade]:
    """A cascade for each list, exact over the distinct `key_col` values of `universe` (about `total` of them).

    First levels are sized so that about as many keys of the universe pass by mistake as are listed; only the keys
    that pass, not the universe, are shuffled and reach the driver.
    """
    spark = universe.sparkSession
    total = total if total is not None else universe.agg(F.approx_count_distinct(key_col)).first()[0]
    out, listed = {}, {}
    for name, keys in lists.items():
        listed[name] = np.array(sorted(set(keys)), object)
        out[name] = Cascade([Bloom.of(hashes(listed[name]), 0, first_level_rate(len(listed[name]), total))] if len(listed[name]) else [])
    shared = spark.sparkContext.broadcast(out)

    def survivors(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        h = hashes(keys)
        for name, cascade in shared.value.items():
            if cascade.levels:
                hit = sorted(set(keys[cascade.levels[0].test(h)]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.string())], ["name", "key"])

    passed = map_arrow(universe.select(F.col(key_col)).where(F.col(key_col).isNotNull()), survivors, "name string, key string").distinct()
    mistaken: dict[str, list[str]] = {name: [] for name in lists}
    known = {name: set(keys) for name, keys in listed.items()}
    for r in passed.toLocalIterator():
        if r["key"] not in known[r["name"]]:
            mistaken[r["name"]].append(r["key"])
    for name, cascade in out.items():
        cascade.complete(listed[name], np.array(sorted(mistaken[name]), object))
    return out


def cascade_passes(universe: DataFrame, lists: dict[str, list[str]], key_col: str = "key", max_bytes: int | None = None):
    """Cascades of parts of the lists, each part (all levels of all its lists) of at most `max_bytes`.

    Keys are dealt to parts by bits of a hash, so a key of several lists is in the same part of each. A single key is
    a part whatever its cascade takes.
    """
    most = MAX_BYTES if max_bytes is None else max_bytes
    total = universe.agg(F.approx_count_distinct(key_col)).first()[0]
    todo = [(lists, 0)]
    while todo:
        part, depth = todo.pop()
        needed = sum(len(k) * -np.log2(first_level_rate(len(k), total)) / np.log(2) / 8 for k in part.values() if k)
        splits = len(set().union(*part.values())) > 1 and depth < 63
        built = None if splits and needed > most else build_cascades(universe, part, key_col, total)
        if built is not None and (not splits or sum(c.size() for c in built.values()) <= most):
            yield built
            continue
        halves: tuple[dict, dict] = ({}, {})
        for name, keys in part.items():
            bit = (hashes(np.array(keys, object))[0] >> np.uint64(depth)) & np.uint64(1)
            for side in (0, 1):
                halves[side][name] = [k for k, b in zip(keys, bit) if b == side]
        todo += [(half, depth + 1) for half in halves if any(half.values())]


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], blocked_hosts: list[str], id_col: str = "page_id",
               url_col: str = "url", max_bytes: int | None = None) -> DataFrame:
    """`id_col`, host, path, rule (the longest that fits, or null), verdict and listed_host, for each row."""
    spark = pages.sparkSession
    rules = [*block, *allow]
    lengths = sorted({0} | {len(r) - r.index("/") for r in rules})
    counts = sorted({h.count(".") + 1 for h in [*blocked_hosts, *(r[: r.index("/")] for r in rules)]}) or [1]
    host, path = split_url(F.col(f"`{url_col}`"))
    urls = pages.select(F.struct(F.col(f"`{id_col}`")).alias("row"), host.alias("host"), path.alias("path"))
    frame = urls.select(
        "row", "host", "path", url_keys(F.col("host"), F.col("path"), counts, lengths).alias("keys"),
        F.lit(None).cast("string").alias("rule"), F.lit(False).alias("blocks"), F.lit(False).alias("listed_host"),
    )
    lists = {"block": block, "allow": allow, "host": blocked_hosts}
    names = ["row", "host", "path", "keys", "rule", "blocks", "listed_host"]
    kinds = "host string, path string, keys array<string>, rule string, blocks boolean, listed_host boolean"
    universe = frame.select(F.explode("keys").alias("key"))
    for n, cascades in enumerate(cascade_passes(universe, lists, max_bytes=max_bytes)):
        shared = spark.sparkContext.broadcast(cascades)
        frame = checkpointed(frame) if n else frame

        def run(batch, shared=shared):
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            h = hashes(flat)
            member = {name: c.test(h) for name, c in shared.value.items()}
            slash = np.array(["/" in x for x in flat], bool)
            ruled, hosts = (member["block"] | member["allow"]) & slash, member["host"] & ~slash
            ends = np.cumsum([0 if x is None else x for x in keys.value_lengths().to_pylist()], dtype=np.int64)
            begins = np.r_[0, ends[:-1]]
            rule, blocks, listed = (batch.column(k).to_pylist() for k in (4, 5, 6))
            row_of = lambda hit: np.searchsorted(ends, np.flatnonzero(hit), side="right")
            for i in set(row_of(hosts).tolist()):
                listed[i] = True
            for i in set(row_of(ruled).tolist()):
                fits = [(-len(flat[k]), not member["block"][k], flat[k]) for k in range(begins[i], ends[i]) if ruled[k]]
                if rule[i] is not None:
                    fits.append((-len(rule[i]), not blocks[i], rule[i]))
                _, allowed, rule[i] = min(fits)
                blocks[i] = not allowed
            cols = [*batch.columns[:4], pa.array(rule, pa.string()), pa.array(blocks, pa.bool_()), pa.array(listed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names)

        frame = map_arrow(frame, run, with_row(frame, kinds))
    blocked = F.when(F.col("rule").isNotNull(), F.col("blocks")).otherwise(F.col("listed_host"))
    return frame.select(
        F.col(f"row.`{id_col}`"), "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "listed_host"
    )

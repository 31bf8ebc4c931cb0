"""Benchmark decontamination with one Aho-Corasick automaton.

Items are normalised to words (A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`). Every run of
`window` words of an item is a pattern; an item with fewer words, but not none, is one pattern. Words of the
benchmark are numbered and spelled with two symbols each, so that the automaton has two nodes for a word of a
pattern, however long the word. It reads each normalised text once; normalisation keeps the place of every byte, so
hits map back to the original text.

Null and empty texts and items have no words and are never hit; broken UTF-8 is read with U+FFFD for broken bytes.
Equal windows of several items count for each of them; items with a null id hit and are not listed. Repeated rows
are judged alike; an empty benchmark hits nothing; texts of any length are read whole. A benchmark of more than
`block_words` words is read in blocks of items, with one pass over the texts and one automaton of about 1 KB a word
for each block; what a pass found is checkpointed before the next one, so a worker never holds two automata. An
automaton is built once in each worker process, not once in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import checkpointed, filtered_rows, map_arrow, packed_filter_rows, utf8_texts, with_row

#: Bytes of normalised text: A-Z lower-cased, other ASCII that is no letter or digit a blank, the rest kept.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_NORMAL).split()


#: Symbols of the first and of the second place of a word; 0 is any word that the benchmark lacks.
_BASE, _FIRST = 1024, 1 << 10
_SECOND = _FIRST + (1 << 16)


class Patterns:
    """The automaton of a block of items. sizes: words of each pattern; owners: the items that have it."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self.spelled: dict[bytes, str] = {}
        place: dict[str, int] = {}
        self.sizes: list[int] = []
        self.owners: list[tuple] = []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                key = "".join([self._spell(w) for w in part])
                n = place.get(key)
                if n is None:
                    n = place[key] = len(self.sizes)
                    self.sizes.append(len(part))
                    self.owners.append(())
                    automaton.add_word(key, n)
                if item is not None and item not in self.owners[n]:
                    self.owners[n] += (item,)
        self.automaton = automaton if self.sizes else None
        if self.sizes:
            automaton.make_automaton()

    def _spell(self, word: bytes) -> str:
        known = self.spelled.get(word)
        if known is None:
            n = len(self.spelled)
            known = self.spelled[word] = chr(_FIRST + n // _BASE) + chr(_SECOND + n % _BASE)
        return known

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """(merged word intervals [begin, end) that are hit, items found) of one normalised text."""
        if self.automaton is None or not words:
            return np.zeros((0, 2), np.int64), set()
        spelled = [self.spelled.get(w, "\0") for w in words]
        found = list(self.automaton.iter("".join(spelled)))
        if not found:
            return np.zeros((0, 2), np.int64), set()
        hits = np.array(found, np.int64)
        ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        stop = np.searchsorted(ends, hits[:, 0] + 1) + 1
        size = np.array([self.sizes[n] for n in hits[:, 1]], np.int64)
        return merge_intervals(np.stack([stop - size, stop], 1)), {i for n in set(hits[:, 1].tolist()) for i in self.owners[n]}


_built: dict[str, Patterns] = {}


def patterns_of(name: str, items: Callable[[], list[tuple]], window: int) -> Patterns:
    """The patterns of the block called `name`, built at most once in a process; only the last block's are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Patterns(items(), window)
    return _built[name]


def merge_intervals(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint intervals with the union of `spans`."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], np.r_[reach[first[1:] - 1], reach[-1]]], 1)


def character_spans(data: bytes, intervals) -> list[tuple[int, int]]:
    """Word intervals as [begin, end) in characters of the original text, given as UTF-8."""
    normal = np.frombuffer(data.translate(_NORMAL), np.uint8)
    word = normal != 32
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    ends = np.flatnonzero(word & np.r_[~word[1:], True]) + 1
    chars = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in intervals]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Blocks of (item, text) of at most some `block_words` words each, read from the cluster one after another."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        block.append((r[0], r[1]))
        size += len((r[1] or "").split())
        if size > block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  block_words: int = 250_000, keep_text: bool = False) -> DataFrame:
    """For each row: `id_col`, n_words, n_hit, word_spans (array<struct<begin, end>>), char_spans, items, contaminated.

    Items are given as strings, sorted as strings. keep_text: also return the text column, for filters.
    """
    spark = docs.sparkSession
    span = "array<struct<begin:bigint,end:bigint>>"
    frame = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.expr(f"cast(array() as {span})").alias("word_spans"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        named = [(None if i is None else str(i), t) for i, t in block]
        shared = spark.sparkContext.broadcast(named)
        name = hashlib.sha256(repr((window, named)).encode()).hexdigest()
        frame = checkpointed(frame) if k else frame

        def run(batch, shared=shared, name=name):
            patterns = patterns_of(name, lambda: shared.value, window)
            if patterns.automaton is None:
                yield batch
                return
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for n, data in enumerate(utf8_texts(batch.column(1))):
                hit, found = patterns.scan(words_of(data))
                if len(hit):
                    before = [(s["begin"], s["end"]) for s in spans[n]]
                    hit = merge_intervals(np.array([*before, *map(tuple, hit.tolist())], np.int64)) if before else hit
                    spans[n] = [{"begin": a, "end": b} for a, b in hit.tolist()]
                    items[n] = sorted({*items[n], *found})
            cols = [batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text", "word_spans", "items"])

        frame = map_arrow(frame, run, with_row(frame, f"text string, word_spans {span}, items array<string>", "id"))

    def measure(batch):
        n, chars = [], []
        for k, data in enumerate(utf8_texts(batch.column(1))):
            n.append(len(words_of(data)))
            spans = [(s["begin"], s["end"]) for s in batch.column(2)[k].as_py()]
            chars.append([{"begin": a, "end": b} for a, b in character_spans(data, spans)] if spans else [])
        cols = [batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(chars, spans_type), batch.column(3)]
        names = ["id", "n_words", "word_spans", "char_spans", "items"]
        if keep_text:
            cols.append(batch.column(1))
            names.append("text")
        yield pa.RecordBatch.from_arrays(cols, names)

    rest = f"n_words bigint, word_spans {span}, char_spans {span}, items array<string>" + ", text string" * keep_text
    out = map_arrow(frame, measure, with_row(frame, rest, "id"))
    n_hit = F.aggregate("word_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "word_spans", "char_spans", "items",
        (F.size("word_spans") > 0).alias("contaminated"), *[F.col("text").alias(text_col)] * keep_text,
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, of which at most that share of words is hit; no shuffle.

    The verdict is computed as one more column by the same scan, so rows with equal or null ids keep their own.
    """
    text_col = options.pop("text_col", "text")
    packed = packed_filter_rows(docs, text_col)
    judged = decontaminate(packed, benchmark, id_col="row", keep_text=True, **options)
    return filtered_rows(judged.where(F.col("n_hit") <= F.lit(max_hit_share) * F.col("n_words")), docs, text_col)


def item_digest(items):
    """Lowercase hex SHA-256 of sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


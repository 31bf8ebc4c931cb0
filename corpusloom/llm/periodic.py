"""Periodic runs of words, found by refining classes of equal factors (Crochemore's partition refinement).

Two positions of a text are in one class at length l if the l words from there on are equal. Classes of length l + 1
follow from those of length l: a class is divided by the classes of the positions behind its own. Only positions
before the smaller parts of what was divided last are looked at (the largest part of each keeps its place), so that a
position takes part O(log n) times. Each class keeps its positions linked in order; neighbours at a distance equal to
the length are a square whose root is no power of a shorter word, and squares of one period at consecutive positions
are one run. All texts of a batch are refined at once, each with an end marker of its own, with arrays of numpy.

A run is a stretch of consecutive words with smallest period q and length >= max(min_length, 2 * q) that no
neighbouring word extends keeping period q. Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. `collapse` drops each word
that a run contains behind that run's first q words.

Null and empty texts have no words and no runs; rows are judged one by one, so that repeated rows get equal results,
and an empty table gives an empty one. Bytes that are no UTF-8 count as U+FFFD. Other columns pass through, whatever
their names; those called like a result give way. Of a text's runs of one greatest length the first start, then the smallest
period is reported as the longest. No text is cut: memory is that of a batch or of the longest text, some 100 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import map_arrow, packed_rows, unpacked, utf8_texts, with_row

#: Words of texts that are refined together.
BATCH_WORDS = 1 << 18
#: A step that moves fewer positions than this ends the work with arrays.
FEW = 512
_KEY = "_loop_key"
#: What `find_runs` tells of each row.
RESULT = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class _Classes:
    """Classes of positions with equal factors, for the texts that `ids` spells one after another.

    ids: an equal number for equal words of a text and different ones for different texts; each text ends with a
    number that is found nowhere else. first: whether a position is the first of its text; longest: the
    greatest length that will be asked for.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, longest: int):
        n = len(ids)
        self.first, self.length, self.longest = first, 1, longest
        order = np.argsort(ids, kind="stable")
        new = np.r_[True, ids[order][1:] != ids[order][:-1]]
        number, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, n])
        self.count = len(starts)
        # positions of a class are a segment of `members`; place: where a position is in it
        self.members, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.of = np.empty(n, np.int64)
        self.of[order] = number
        self.start, self.size = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        self.start[: self.count], self.size[: self.count] = starts, sizes
        # neighbours in a class, in the order of the text
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        a, b = order[:-1][~new[1:]], order[1:][~new[1:]]
        self.next[a], self.before[b] = b, a
        self.marked = np.zeros(n, bool)
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        self._expect(a)
        # all but the largest class of each text
        text = np.cumsum(first)[order[starts]]
        by = np.lexsort((sizes, text))
        keeper = np.zeros(self.count, bool)
        keeper[by[np.r_[text[by][1:] != text[by][:-1], True]]] = True
        self.small = order[~keeper[number]]

    def _expect(self, at: np.ndarray) -> None:
        """Notes the neighbours of positions for the length that equals their distance."""
        distance = self.next[at] - at
        keep = (distance >= self.length) & (distance <= self.longest)  # without a neighbour it is below 0
        at, distance = at[keep], distance[keep]
        if not len(at):
            return
        by = np.argsort(distance, kind="stable")
        at, distance = at[by], distance[by]
        cuts = np.flatnonzero(distance[1:] != distance[:-1]) + 1
        for d, part in zip(distance[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            self.due[d].append(part)

    def squares(self) -> np.ndarray:
        """Positions where two equal factors of the present length meet."""
        found = self.due.pop(self.length, None)
        if found is None:
            return np.zeros(0, np.int64)
        at = np.concatenate(found)
        return at[self.next[at] - at == self.length]

    def lengthen(self) -> None:
        """Goes from length l to l + 1."""
        self.length += 1
        behind = self.small[~self.first[self.small]]
        at = behind - 1
        own = self.of[at]
        live = self.size[own] > 1
        at, own, other = at[live], own[live], self.of[behind[live]]
        by = np.argsort(own, kind="stable")  # `small` is sorted by class and position already
        at, own, other = at[by], own[by], other[by]
        if not len(at):
            self.small = at
            return
        # parts: positions of one class before one small class
        turn = np.r_[True, own[1:] != own[:-1]]
        part = np.flatnonzero(turn | np.r_[True, other[1:] != other[:-1]])
        part_size = np.diff(np.r_[part, len(at)])
        part_own = own[part]
        head = np.flatnonzero(np.r_[True, part_own[1:] != part_own[:-1]])
        classes = part_own[head]
        rest = self.size[classes] - np.add.reduceat(part_size, head)
        largest = np.maximum.reduceat(part_size, head)
        parts_of = np.diff(np.r_[head, len(part)])
        kept = np.repeat(rest < largest, parts_of) & (part_size == np.repeat(largest, parts_of))
        kept &= np.r_[0, np.cumsum(kept)[:-1]] == np.repeat(np.r_[0, np.cumsum(kept)][head], parts_of)  # one of them
        moving = ~kept[np.repeat(np.arange(len(part)), part_size)]
        number = np.repeat(np.arange(len(part)), part_size)[moving]
        moved, moved_of = at[moving], own[moving]
        alone = classes[(rest < largest) & (rest > 0)]
        if len(alone):  # the rest is the smaller one, and leaves
            self.marked[at] = True
            size = self.size[alone]
            slots = np.repeat(self.start[alone] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            others, others_of = self.members[slots], np.repeat(alone, size)
            stay = ~self.marked[others]
            self.marked[at] = False
            moved = np.concatenate([moved, others[stay]])
            moved_of = np.concatenate([moved_of, others_of[stay]])
            number = np.concatenate([number, len(part) + others_of[stay]])
            by = np.lexsort((moved, number, moved_of))
            moved, moved_of, number = moved[by], moved_of[by], number[by]
        if len(moved):
            self._move(moved, moved_of, number)
        self.small = moved

    def _move(self, moved: np.ndarray, moved_of: np.ndarray, number: np.ndarray) -> None:
        """Takes positions out of their classes into new ones; sorted by class, number of the new one and position."""
        turn = np.flatnonzero(np.r_[True, moved_of[1:] != moved_of[:-1]])
        classes, leaving = moved_of[turn], np.diff(np.r_[turn, len(moved)])
        # out of the lists: runs of neighbours that leave together
        by = np.lexsort((moved, moved_of))
        gone = moved[by]
        breaks = np.r_[True, self.next[gone[:-1]] != gone[1:], True]
        left, right = self.before[gone[breaks[:-1]]], self.next[gone[breaks[1:]]]
        inner = (left >= 0) & (right >= 0)
        self.next[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        # out of the segments: to their ends, where new segments begin
        end = self.start[classes] + self.size[classes]
        tail = np.repeat(end - leaving - np.r_[0, np.cumsum(leaving)[:-1]], leaving) + np.arange(len(moved))
        self.marked[moved] = True
        there = self.members[tail]
        there = there[~self.marked[there]]
        self.marked[moved] = False
        places = self.place[moved]
        free = places[places < np.repeat(end - leaving, leaving)]
        self.members[free], self.place[there] = there, free
        self.members[tail], self.place[moved] = moved, tail
        self.size[classes] -= leaving
        cut = np.r_[True, (number[1:] != number[:-1]) | (moved_of[1:] != moved_of[:-1])]
        begin = np.flatnonzero(cut)
        fresh = self.count + np.arange(len(begin))
        self.count += len(begin)
        self.start[fresh], self.size[fresh] = tail[begin], np.diff(np.r_[begin, len(moved)])
        self.of[moved] = np.repeat(fresh, self.size[fresh])
        follow = np.where(np.r_[cut[1:], True], -1, np.r_[moved[1:], -1])
        same = self.next[moved] == follow
        self.next[moved] = follow
        self.before[moved] = np.where(cut, -1, np.r_[-1, moved[:-1]])
        self._expect(np.concatenate([left[inner], moved[~same]]))


class _Rest:
    """Goes on with `_Classes` once a step moves few positions, with dictionaries of the positions that are not alone."""

    def __init__(self, done: _Classes):
        self.length, self.longest, self.first = done.length, done.longest, done.first
        at = np.flatnonzero(done.size[done.of] > 1)
        keys, classes = at.tolist(), done.of[at].tolist()
        self.of = dict(zip(keys, classes))
        self.next, self.before = dict(zip(keys, done.next[at].tolist())), dict(zip(keys, done.before[at].tolist()))
        self.members: dict[int, set] = defaultdict(set)
        for p, c in zip(keys, classes):
            self.members[c].add(p)
        self.count = done.count
        self.due: dict[int, list[int]] = defaultdict(list)
        for d, parts in done.due.items():
            p = np.concatenate(parts)
            if len(p := p[done.next[p] - p == d]):
                self.due[d] = p.tolist()
        self.small: list[list[int]] = []
        if len(done.small):
            c = done.of[done.small]
            self.small = [x.tolist() for x in np.split(done.small, np.flatnonzero(c[1:] != c[:-1]) + 1)]

    def squares(self) -> list[int]:
        d, after = self.length, self.next
        return [p for p in self.due.pop(d, ()) if after.get(p) == p + d]

    def lengthen(self) -> None:
        self.length += 1
        parts: dict[int, dict[int, list[int]]] = {}
        of, first = self.of, self.first
        for k, small in enumerate(self.small):
            for p in small:
                c = of.get(p - 1)
                if c is not None and not first[p]:
                    parts.setdefault(c, {}).setdefault(k, []).append(p - 1)
        self.small = []
        for c, found in parts.items():
            members = self.members[c]
            leaving = list(found.values())
            n = sum(map(len, leaving))
            largest = max(leaving, key=len)
            rest = len(members) - n
            if rest < len(largest):  # the largest part stays
                leaving = [x for x in leaving if x is not largest]
                if rest:
                    leaving.append(sorted(members.difference(*found.values())))
            if leaving:
                self._move(c, members, leaving)

    def _move(self, c: int, members: set, leaving: list[list[int]]) -> None:
        after, before, touched = self.next, self.before, []
        for part in leaving:
            members.difference_update(part)
            for p in part:
                a, b = before[p], after[p]
                if a >= 0:
                    after[a] = b
                    touched.append(a)
                if b >= 0:
                    before[b] = a
        for part in leaving:
            self.small.append(part)
            if len(part) == 1:
                self._alone(part[0])
                continue
            self.members[self.count] = set(part)
            for k, p in enumerate(part):
                self.of[p] = self.count
                before[p] = part[k - 1] if k else -1
                after[p] = part[k + 1] if k + 1 < len(part) else -1
            self.count += 1
            touched += part
        if len(members) == 1:
            self._alone(members.pop())
            del self.members[c]
        for p in touched:
            d = after.get(p, -1) - p
            if self.length <= d <= self.longest:
                self.due[d].append(p)

    def _alone(self, p: int) -> None:
        del self.of[p], self.next[p], self.before[p]


def runs_of_ids(ids: np.ndarray, ends: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ids: numbers of the words of texts one after another, equal for equal words of a text; ends: where each text ends.
    Starts are places in `ids`; no run passes the end of its text.
    """
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    sizes = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(ends)), sizes)
    at = np.arange(len(ids)) + text  # end markers lie between
    spelt = np.empty(len(ids) + len(ends), np.int64)
    step = int(ids.max()) + 2
    spelt[at] = text * step + ids
    marks = np.cumsum(sizes + 1) - 1
    spelt[marks] = np.arange(len(ends)) * step + step - 1
    first = np.zeros(len(spelt), bool)
    first[np.r_[0, marks[:-1] + 1]] = True
    longest = int(sizes.max()) // 2
    classes = _Classes(spelt, first, longest)
    periods, places = [], []
    while classes.length <= longest:
        found = classes.squares()
        if len(found):
            periods.append(np.full(len(found), classes.length))
            places.append(np.asarray(found))
        if not len(classes.small):
            break
        classes.lengthen()
        if isinstance(classes, _Classes) and len(classes.small) < FEW:
            classes = _Rest(classes)
    if not places:
        return none, none, none
    period, place = np.concatenate(periods), np.concatenate(places)
    by = np.lexsort((place, period))
    period, place = period[by], place[by]
    new = np.r_[True, (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1)]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(place)] - 1
    start, period = place[begin], period[begin]
    length = place[last] - start + 2 * period
    keep = length >= min_length
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    return start - np.searchsorted(marks, start), length, period


def runs_of_words(words: list, min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one list of words."""
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, k) for k, w in enumerate(words)), np.int64, len(words))
    return list(zip(*(x.tolist() for x in runs_of_ids(ids, np.array([len(ids)]), min_length))))


def _found(texts: list[list[bytes]], min_length: int) -> tuple[list, dict]:
    """What `RESULT` names of each list of words."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    ids = np.empty(int(ends[-1]), np.int64)
    for words, e in zip(texts, ends.tolist()):
        seen: dict = {}
        ids[e - len(words) : e] = np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))
    start, length, period = runs_of_ids(ids, ends, min_length)
    text = np.searchsorted(ends, start, side="right")
    # words behind the first period of a run
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    start = start - np.r_[0, ends][text]
    out = []
    bounds = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    for k, words in enumerate(texts):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            out.append((len(words), [], None, b" ".join(words)))
            continue
        rows = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
        best = min(rows, key=lambda r: (-r[1], r[0], r[2]))
        gone = dropped[ends[k] - len(words) : ends[k]].tolist()
        out.append((len(words), rows, best, b" ".join([w for w, g in zip(words, gone) if not g])))
    return out


def looped(words: list, key: int | None) -> list:
    """`words`, of which for one key in ten all from some word on repeat a stretch: h = crc32 of the key, g = h div 10; if h is
    divisible by ten, word i >= a becomes word a + (i - a) % p with a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    n = len(words)
    if key is None or key % 10 or not n:
        return words
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", loop_key: str | None = None, min_length: int = 12) -> DataFrame:
    """`keep` and for each row n_words, n_runs, the longest run (start, length, period and exponent_milli, 1000 * length div period; null
    without a run), runs by start and period, and collapsed, the kept words joined by blanks.

    loop_key: an SQL expression of a number; by it texts are given known loops, see `looped` (for tests of whole jobs).
    """
    key = F.expr(loop_key) if loop_key else F.lit(None)
    rows = packed_rows(docs.withColumns({_KEY: key.cast("bigint")}), text_col, (*keep, _KEY)).select(
        F.col("row").dropFields(_KEY).alias("row"), "text", F.col(f"row.{_KEY}").alias("key"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batch: pa.RecordBatch):
        row, texts, keys = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        held, n, at = [], 0, 0
        for k, data in enumerate(utf8_texts(texts)):
            held.append(looped(data.split(), keys[k]))  # bytes are split at \x20 and \x09 to \x0D
            n += len(held[-1])
            if n >= BATCH_WORDS or k == batch.num_rows - 1:
                found = _found(held, min_length)
                best = [f[2] or (None, None, None) for f in found]
                yield pa.RecordBatch.from_arrays([
                    row.slice(at, len(held)), pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()),
                    *[pa.array([b[i] for b in best], pa.int64()) for i in range(3)],
                    pa.array([b[1] and 1000 * b[1] // b[2] for b in best], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in f[1]] for f in found], run_type),
                    pa.array([f[3].decode() for f in found], pa.string()),
                ], names)
                held, n, at = [], 0, k + 1

    schema = with_row(rows, RESULT)
    names = schema.names
    return unpacked(map_arrow(rows, find, schema), *names[1:])


def runs_digest(column: str):
    """SHA-256 of every run's `start,length,period` and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.sha2(F.concat(F.array_join(F.transform(column, line), "\n"), F.when(F.size(column) > 0, "\n").otherwise("")), 256)


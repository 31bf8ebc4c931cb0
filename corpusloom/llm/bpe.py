"""BPE encoding and decoding by tree concatenation.

A long text is halved until a leaf is short enough; leaves are encoded on their own, in parallel threads, and
neighbours are joined by encoding a window around the join again. The window grows until both sides agree
exactly with what they had, so the result is the encoding of the whole text, whatever its length:

* Anchors. A token that begins with one blank and goes on with something else begins a pre-token, since blanks
  stand only in front of a pre-token or in runs of white space. From a true pre-token boundary the splitting
  pattern goes on regardless of what stood before. A window from an anchor of the left side to an anchor that the
  right side and the window share is therefore exact.
* Runs. In one long pre-token there are no anchors. A sequence of BPE tokens is the encoding of its text exactly
  if each two neighbours are the encoding of theirs; so a window inside one run whose first and last tokens are
  those of the left and right sides joins them exactly.
* Otherwise the window grows until it is the whole text of both sides, which is exact by itself.

Null and empty texts have no tokens and decode to an empty text. Texts of special tokens are special tokens, as
the library takes them by default. Repeated rows are encoded alike; other columns than id and text are left out, and
the id column may have any name. Broken UTF-8 is read with U+FFFD for broken bytes.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import map_arrow, packed_rows, utf8_texts, with_row

#: The splitting pattern of byte-level BPE with `use_regex`. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
#: The pattern looks at most three characters ahead of a boundary (a contraction).
_AHEAD = 16


class TreeEncoder:
    """Encodes and decodes with a byte-level BPE tokenizer file of the `tokenizers` library.

    source: the file's path or its content. leaf: characters encoded at once; window: tokens on either side of a
    join that are tried first; threads: leaves encoded at the same time.
    """

    def __init__(self, source: str | bytes, leaf: int = 8192, window: int = 16, threads: int = 2):
        import tiktoken

        model = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())
        if model["pre_tokenizer"].get("add_prefix_space") or model["normalizer"] or not model["pre_tokenizer"]["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in model["added_tokens"]):
            raise ValueError("special tokens that take in blanks or need word borders are not supported")
        rank = model["model"]["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]]
        made = [rank[a + b] for a, b in pairs]
        if any(y <= x for x, y in zip(made, made[1:])):
            raise ValueError("only files whose merges are in the order of their ids are supported")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.encoding = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.cut = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        self.leaf, self.window = leaf, window
        self.pool = ThreadPoolExecutor(threads) if threads > 1 else None

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self._segment(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._segment(text[at:])

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def _segment(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        data = text.encode()
        cuts = [0]
        for k in range(self.leaf, len(text), self.leaf):
            cuts.append(cuts[-1] + len(text[k - self.leaf : k].encode()))
        cuts.append(len(data))
        leaves = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        # the encoder works outside the interpreter's lock
        parts = (self.pool.map if self.pool else map)(self.encoding.encode_ordinary, leaves)
        level = [(a, b, ids) for a, b, ids in zip(cuts, cuts[1:], parts)]
        while len(level) > 1:
            level = [
                (level[i][0], level[i + 1][1], self._join(data, *level[i], *level[i + 1])) if i + 1 < len(level) else level[i]
                for i in range(0, len(level), 2)
            ]
        return level[0][2]

    def _anchor(self, token: int) -> bool:
        b = self.bytes[token]
        return len(b) > 1 and b[0] == 32 and b[1:2] > b" " and b[1] < 0x80

    def _join(self, data: bytes, s: int, m: int, left: list[int], m2: int, e: int, right: list[int]) -> list[int]:
        """The encoding of data[s:e] from those of data[s:m] and data[m:e]."""
        k = self.window
        while k < len(left) or k < len(right):
            i, j = max(0, len(left) - k), min(len(right), k)
            joined = self._anchored(data, s, m, left, right, i, j, e) or self._in_run(data, s, m, left, right, i, j, e)
            if joined:
                return joined
            k *= 4
        return self.encoding.encode_ordinary(data[s:e].decode())

    def _anchored(self, data, s, m, left, right, i, j, e):
        """left[:p] + window + right[q:] where p and q are at anchors, if there are such."""
        size = self.bytes
        a, p = m - sum(len(size[t]) for t in left[i:]), i
        while p < len(left) and not (self._anchor(left[p]) and a <= m - _AHEAD) and not p == 0:
            a, p = a + len(size[left[p]]), p + 1
        if p == len(left) or a > m - _AHEAD and p:
            return None
        b = m + sum(len(size[t]) for t in right[:j])
        while b < e and data[b] & 0xC0 == 0x80:
            b += 1
        window = self.encoding.encode_ordinary(data[a:b].decode())
        at, shared = a, {}
        for n, t in enumerate(window):
            if at >= m and self._anchor(t):
                shared[at] = n
            at += len(size[t])
        at = m
        for q in range(j):
            if at in shared and self._anchor(right[q]) and at + len(size[right[q]]) <= (b if b == e else b - _AHEAD):
                return left[:p] + window[: shared[at]] + right[q:]
            at += len(size[right[q]])
        return None

    def _in_run(self, data, s, m, left, right, i, j, e):
        """left[:i] + window + right[j:] if all lies in one run of one kind of characters and both ends agree."""
        size = self.bytes
        a = m - sum(len(size[t]) for t in left[i:])
        b = m + sum(len(size[t]) for t in right[:j])
        if a - 8 < s or b + 8 > e or any(data[x] & 0xC0 == 0x80 for x in (a, b)):
            return None
        lo, hi = a - 8, b + 8
        while data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < e and data[hi] & 0xC0 == 0x80:
            hi += 1
        if not _RUN.fullmatch(data[lo:hi].decode()):
            return None
        window = self.encoding.encode_ordinary(data[a:b].decode())
        if len(window) > 1 and window[0] == left[i] and window[-1] == right[j - 1]:
            return left[:i] + window + right[j:]
        return None


_encoders: dict[tuple, TreeEncoder] = {}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 8192,
                     window: int = 16, threads: int = 2, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """`id_col`, n_tokens, ids_sha256, decoded_sha256, ids (array<int>) and the decoded text of each row of `docs`.

    path: the tokenizer's file, read by the driver; its content is broadcast and each worker process makes one
    encoder of it. with_ids, with_text: leave those columns out where only the digests are wanted. Everything is
    done in one pass, without a shuffle.
    """
    content = Path(path).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    key = (hashlib.sha256(content).hexdigest(), leaf, window, threads)
    packed = packed_rows(docs, text_col, (id_col,))

    def run(batch):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TreeEncoder(shared.value, leaf, window, threads)
        enc = _encoders[key]
        n, h1, h2, all_ids, all_text = [], [], [], [], []
        for data in utf8_texts(batch.column(1)):
            ids = enc.encode(data.decode())
            text = enc.decode(ids)
            n.append(len(ids))
            h1.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            h2.append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                all_ids.append(ids)
            if with_text:
                all_text.append(text)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.string()), pa.array(h2, pa.string())]
        names = ["row", *own[:3]]
        if with_ids:
            cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        if with_text:
            cols.append(pa.array(all_text, pa.string()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(cols, names)

    own = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_arrow(packed, run, with_row(packed, kinds)).select(F.col(f"row.`{id_col}`"), *own)

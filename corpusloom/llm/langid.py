"""Language identification with error-correcting output codes.

Each language has a codeword of bits; each bit has a binary classifier, a logistic regression over hashed n-grams
of the lower-cased letters. A text's language is the one whose codeword has the least logistic loss against the
classifiers' values, so that a few wrong bits do no harm. The score is that codeword's share of exp(-loss), and a
row is flagged as ambiguous where the two best codewords are close.

Texts that are null or have no letter are `und` with score 0, not ambiguous. Repeated rows are judged alike. With no
language to learn every text is `und`; with one, every text with a letter has it with score 1. Texts of any length are
read whole, 128 rows or one longer text at a time; broken UTF-8 is read with U+FFFD. The id column may have any name;
other columns take no part. Null ids are judged, never learned from.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import map_arrow, packed_rows, text_slices, with_row
from corpusloom.llm._sample import labelled_texts
from corpusloom.llm._text import hashed_counts, letters


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of +1/-1. Up to 7 classes every split into two parts is a bit; beyond, the best of random codes."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        bits = [np.r_[1, b] for b in itertools.product((-1, 1), repeat=k - 1) if -1 in b]
        return np.array(bits, np.int8).T
    n = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, n))
        code = code[:, np.abs(code.sum(0)) < k]
        distance = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        least = distance[~np.eye(k, dtype=bool)].min()
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class CodeModel:
    """langs: sorted; code: a row of +1/-1 for each; weights, bias: a column for each bit; scale: sharpness of scores."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bits: int
    orders: tuple[int, int]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's place, score, second language's score) of feature rows."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x))
        margin = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        rows = np.arange(len(x))
        return order[:, 0], share[rows, order[:, 0]], share[rows, order[:, 1]]


def fit(docs: DataFrame, labelled: DataFrame, lang_col: str = "lang", per_lang: int = 1500, bits: int = 12,
        orders: tuple[int, int] = (1, 4), l2: float = 1e-5, steps: int = 150, id_col: str = "doc_id", text_col: str = "text") -> CodeModel:
    """Learns from at most `per_lang` texts of each language that `labelled` (id_col, lang_col) has."""
    sample = labelled_texts(docs, labelled, lang_col, per_lang, id_col, text_col)

    def run(batch):
        for a, b, data, offsets in text_slices(batch.column(2)):
            code, at = letters(data, offsets)
            x = hashed_counts(code, at, range(*orders), bits).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    table = map_arrow(sample, run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, 1 << bits).astype(np.float32)
    langs, y = np.unique(np.array(table["lang"].to_pylist(), object).astype(str), return_inverse=True)
    code = codewords(len(langs))
    w, bias = np.zeros((1 << bits, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(langs) > 1:
        weight = (1 / np.bincount(y) / len(langs))[y].astype(np.float32)[:, None]
        sign = code[y].astype(np.float32)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
        for step in range(1, steps + 1):
            f = x @ w + bias
            g = -sign * weight / (1 + np.exp(np.clip(sign * f, -60, 60)))
            gw, gb = x.T @ g + l2 * w, g.sum(0)
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = 0.3 / (1 + step / 50)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    return CodeModel(list(map(str, langs)), code, w, bias, bits, orders)


def identify(docs: DataFrame, model: CodeModel, min_margin: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, lang_pred, score (0 to 1), second score, ambiguous, for each row; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = packed_rows(docs, text_col, (id_col,))

    def run(batch):
        m = shared.value
        for a, b, data, offsets in text_slices(batch.column(1)):
            for i in range(0, b - a, 128):
                part = offsets[i : i + 129]
                code, at = letters(data[part[0] : part[-1]], part - part[0])
                lettered = np.r_[0, np.cumsum(code != 32)][at]
                known = (np.diff(lettered) > 0) & bool(m.langs)
                n = len(part) - 1
                best, first, second = np.zeros(n, int), np.zeros(n), np.zeros(n)
                if m.langs:
                    best, first, second = m.decode(hashed_counts(code, at, range(*m.orders), m.bits))
                pred = [m.langs[k] if ok else "und" for k, ok in zip(best, known)]
                score = np.where(known, first, 0.0)
                cols = [batch.column(0).slice(a + i, n), pa.array(pred, pa.string()), pa.array(score), pa.array(np.where(known, second, 0.0)),
                        pa.array(known & (first - second < min_margin))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "lang_pred", "score", "second_score", "ambiguous"])

    out = map_arrow(packed, run, with_row(packed, "lang_pred string, score double, second_score double, ambiguous boolean"))
    return out.select(F.col(f"row.`{id_col}`"), "lang_pred", "score", "second_score", "ambiguous")

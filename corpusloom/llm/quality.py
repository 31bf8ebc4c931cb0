"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Texts become rows of hashed character n-gram frequencies (square roots, so rows have unit length) with a few hashed
shape tokens (repeated lines, capitals, symbols). One weight vector is shared by all grades; ordered thresholds
turn its value f into P(grade <= k) = logistic(threshold_k - f). A row gets the expected grade and the tail
probability P(grade >= selected grade).

Null and empty texts have the features of an empty text (f = 0) and are judged by the thresholds alone. Repeated
rows are judged alike. Without two grades among the ratings every text has the one grade (or 0) with tail 1. Texts of
any length are read whole; broken UTF-8 is read with U+FFFD. Null ids are judged, never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import filtered_rows, map_arrow, packed_filter_rows, packed_rows, text_slices, unpacked, with_row
from corpusloom.llm._sample import labelled_texts
from corpusloom.llm._text import hashed_counts, raw_codes

_SHAPES = 8


def features(data: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, int]) -> np.ndarray:
    """(texts, 2**bits + _SHAPES): hashed n-grams, then shape tokens from 0 to 1."""
    code, at = raw_codes(data, offsets)
    shape = np.zeros((len(at) - 1, _SHAPES), np.float32)
    space = code == 32
    upper = (code >= 65) & (code <= 90)
    letter = upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    sums = [np.r_[0, np.cumsum(x)] for x in (space, upper, letter)]
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if b == a:
            continue
        s, u, l = (x[b] - x[a] for x in sums)
        lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        shape[i, 0] = 1 - len(set(lines)) / len(lines)
        shape[i, 1] = u / max(1, l)
        shape[i, 2] = 1 - (l + s) / (b - a)
        shape[i, 3] = 1 / (1 + s)
    return np.hstack([hashed_counts(code, at, range(*orders), bits), shape])


@dataclass
class OrdinalModel:
    """grades: sorted; weights: one vector for all of them; thresholds: one between each two grades, increasing."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    orders: tuple[int, int]

    def cumulative(self, x: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last."""
        f = x @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - f[:, None], -60, 60)))

    def judge(self, x: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= at_least)) of feature rows."""
        if len(self.grades) < 2:
            grade = self.grades[0] if len(self.grades) else 0.0
            return np.full(len(x), float(grade)), np.ones(len(x))
        below = self.cumulative(x)
        p = np.diff(np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))]), axis=1)
        return p @ self.grades, p[:, self.grades >= at_least].sum(1)


def fit_rows(x: np.ndarray, y: np.ndarray, bits: int, orders: tuple[int, int], l2: float = 1e-6, steps: int = 600) -> OrdinalModel:
    """Maximum likelihood for feature rows and grades; every grade has the same total weight."""
    grades, k = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(grades.astype(float), np.zeros(x.shape[1], np.float32), np.zeros(0), bits, orders)
    m = len(grades) - 1
    weight = (1 / np.bincount(k) / len(grades))[k]
    w = np.zeros(x.shape[1], np.float32)
    share = np.arange(1, m + 1) / (m + 1)
    raw = np.r_[np.log(share[0] / (1 - share[0])), np.log(np.diff(np.log(share / (1 - share))))]  # first, then log gaps
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, steps + 1):
        theta = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        f = x @ w
        edge = np.hstack([np.full((len(f), 1), -60.0), theta[None, :] - f[:, None], np.full((len(f), 1), 60.0)])
        c = 1 / (1 + np.exp(-np.clip(edge, -60, 60)))
        c[:, 0], c[:, -1] = 0.0, 1.0
        hi, lo = c[np.arange(len(f)), k + 1], c[np.arange(len(f)), k]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        gw = (x.T @ (d_hi - d_lo).astype(np.float32)) + l2 * w
        g_theta = np.bincount(k, weights=-d_hi, minlength=m + 1)[:m] + np.bincount(k, weights=d_lo, minlength=m + 1)[1:]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_raw = np.r_[tail[0], tail[1:] * np.exp(raw[1:])]
        for g, a, b, target, rate in ((gw, 0, 1, w, 0.6), (g_raw, 2, 3, raw, 0.05)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.999 * state[b] + 0.001 * g * g
            target -= (rate / (1 + step / 200) * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.999**step)) + 1e-9)).astype(target.dtype)
    return OrdinalModel(grades.astype(float), w, np.cumsum(np.r_[raw[0], np.exp(raw[1:])]), bits, orders)


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", per_grade: int = 3000, bits: int = 11,
        orders: tuple[int, int] = (1, 4), id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Learns from at most `per_grade` rated texts of each grade; their feature rows, of fixed width, go to the driver."""
    sample = labelled_texts(docs, ratings, grade_col, per_grade, id_col, text_col)

    def run(batch):
        grade = batch.column(1).cast(pa.float64())
        for a, b, data, offsets in text_slices(batch.column(2)):
            x = features(data, offsets, bits, orders).astype(np.float16)
            yield pa.RecordBatch.from_arrays([grade.slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["grade", "x"])

    table = map_arrow(sample, run, "grade double, x binary").toArrow()
    width = (1 << bits) + _SHAPES
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
    return fit_rows(x, table["grade"].to_numpy(), bits, orders)


def _judged(packed: DataFrame, model: OrdinalModel, at_least: float, min_tail: float, with_text: bool = False) -> DataFrame:
    """(row, expected_grade, tail_prob, kept), with_text: and text, of (row, text); one pass without a shuffle."""
    shared = packed.sparkSession.sparkContext.broadcast(model)
    names = ["row", *["text"] * with_text, "expected_grade", "tail_prob", "kept"]

    def run(batch):
        m = shared.value
        for a, b, data, offsets in text_slices(batch.column(1)):
            for i in range(0, b - a, 256):
                part = offsets[i : i + 257]
                x = features(data[part[0] : part[-1]], part - part[0], m.bits, m.orders)
                grade, tail = m.judge(x, at_least)
                own = [batch.column(k).slice(a + i, len(part) - 1) for k in range(1 + with_text)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grade), pa.array(tail), pa.array(tail >= min_tail)], names)

    return map_arrow(packed, run, with_row(packed, "text string, " * with_text + "expected_grade double, tail_prob double, kept boolean"))


def judge(docs: DataFrame, model: OrdinalModel, at_least: float = 1.0, min_tail: float = 0.5, text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, expected_grade, tail_prob = P(grade >= at_least) and kept = tail_prob >= min_tail.

    Kept columns that are named like one of these three give way.
    """
    return unpacked(_judged(packed_rows(docs, text_col, keep), model, at_least, min_tail), "expected_grade", "tail_prob", "kept")


def good_documents(docs: DataFrame, model: OrdinalModel, at_least: float = 1.0, min_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose tail probability is `min_tail` or more."""
    judged = _judged(packed_filter_rows(docs, text_col), model, at_least, min_tail, with_text=True)
    return filtered_rows(judged.where("kept"), docs, text_col)


def combined_grades(labels: DataFrame, quality_col: str = "quality", toxic_col: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """(id, grade): a graded rating made of two labels of 0 and 1: one point for good text, one for text that is not
    toxic. A row that lacks a label has no grade."""
    return labels.select(F.col(id_col), (F.col(quality_col) + 1 - F.col(toxic_col)).alias("grade"))

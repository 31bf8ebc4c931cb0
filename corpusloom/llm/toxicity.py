"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased letters (anything else is a blank). From a labelled
sample each n-gram gets r = log of the ratio of its smoothed document frequencies among toxic and clean texts;
those whose ratio is significant are kept and enter a logistic regression as r * presence. A text's score is the
logistic of the bias and the kept n-grams that it has, so it does not drift with the length of the text.

Null and empty texts have no features: their score is that of the bias, below one half. Repeated rows get equal
scores. Null ids are scored, never learned from. Without any label of both kinds all scores are 0. Texts of any
length are read whole, in numpy arrays of some 30 bytes a character; broken UTF-8 is read with U+FFFD.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._cluster import filtered_rows, map_arrow, packed_filter_rows, packed_rows, text_slices, unpacked, with_row
from corpusloom.llm._sample import labelled_texts
from corpusloom.llm._text import gram_buckets, letters

_TABLE_BITS = 22


def text_keys(data: np.ndarray, offsets: np.ndarray, orders: range, wanted=None):
    """For each text the sorted distinct 32-bit keys of its n-grams, or of those among the sorted `wanted`."""
    code, at = letters(data, offsets)
    parts: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    table = None
    if wanted is not None:
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[wanted >> np.uint32(32 - _TABLE_BITS)] = True
    for order, bucket in gram_buckets(code, orders, 32):
        key = bucket.view(np.uint32)
        if table is None:
            for i, out in enumerate(parts):
                out.append(key[at[i] : max(at[i], at[i + 1] - order + 1)])
            continue
        place = np.flatnonzero(table[key >> np.uint32(32 - _TABLE_BITS)])
        found = key[place]
        exact = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found
        place, found = place[exact], found[exact]
        text = np.searchsorted(at, place, side="right") - 1
        inside = place + order <= at[text + 1]
        text, found = text[inside], found[inside]
        if len(text):
            cut = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(text)]):
                parts[text[a]].append(found[a:b])
    return [np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint32) for p in parts]


@dataclass
class NaiveBayesLinear:
    """keys: sorted n-gram keys; weights: log-count ratio times learned weight of each; bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, int]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-self.bias)))
        found = text_keys(data, offsets, range(*self.orders), self.keys)
        z = np.array([self.weights[np.searchsorted(self.keys, k)].sum() for k in found]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: int = 3000, orders: tuple[int, int] = (4, 7),
        min_z: float = 5.0, l2: float = 1e-3, steps: int = 300, id_col: str = "doc_id",
        text_col: str = "text") -> NaiveBayesLinear:
    """Learns from at most `per_label` texts of each of the labels 0 and 1 (rows that `labels` has).

    N-gram frequencies are summed on the executors; the driver gets all n-grams whose frequencies differ by `min_z`
    standard errors or more, and which of them each sampled text has. The sample bounds both.
    """
    sample = labelled_texts(docs, labels.where(F.col(label_col).isin(0, 1)), label_col, per_label, id_col, text_col)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return NaiveBayesLinear(np.zeros(0, np.uint32), np.zeros(0), -np.inf, orders)

    def count(batch):
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_slices(batch.column(2)):
            keys = text_keys(data, offsets, range(*orders))
            flat = np.concatenate(keys)
            toxic = np.repeat(label[a:b], [len(k) for k in keys])
            uniq, inverse = np.unique(flat, return_inverse=True)
            both = np.bincount(inverse, minlength=len(uniq))
            bad = np.bincount(inverse, weights=toxic, minlength=len(uniq)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uniq.astype(np.int64)), pa.array((both - bad).astype(np.int32)), pa.array(bad.astype(np.int32))], ["key", "c0", "c1"]
            )

    counts = map_arrow(sample, count, "key bigint, c0 int, c1 int").groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p, q = (F.col("c1") + 1) / (n1 + 2), (F.col("c0") + 1) / (n0 + 2)
    middle = (F.col("c0") + F.col("c1") + 2) / (n0 + n1 + 4)
    z = (p - q) / F.sqrt(middle * (1 - middle) * (1 / n0 + 1 / n1))
    kept = counts.select("key", F.log(p / q).alias("r"), z.alias("z")).where(F.abs("z") >= min_z)
    rows = kept.collect()
    keys = np.array([r.key for r in rows], np.int64).astype(np.uint32)
    order = np.argsort(keys)
    keys, ratio = keys[order], np.array([r.r for r in rows])[order]
    if not len(keys):
        return NaiveBayesLinear(keys, ratio, float(np.log(n1 / n0)) - 1.0, orders)

    def features(batch):
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_slices(batch.column(2)):
            found = text_keys(data, offsets, range(*orders), keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[a:b].astype(np.int32)), pa.array([np.searchsorted(keys, k).astype(np.int32) for k in found], pa.list_(pa.int32()))],
                ["label", "at"],
            )

    data = map_arrow(sample, features, "label int, at array<int>").toArrow()
    y = data["label"].to_numpy().astype(float)
    at = data["at"].combine_chunks()
    size = np.diff(at.offsets.to_numpy())
    row, col = np.repeat(np.arange(len(y)), size), at.flatten().to_numpy()
    value = ratio[col] / np.sqrt(len(y))
    scale = np.sqrt(len(y))
    w, bias = np.zeros(len(keys)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):
        f = np.bincount(row, weights=w[col] * value * scale, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(f, -500, 500))) - y) * weight
        gw = np.bincount(col, weights=error[row] * value * scale, minlength=len(keys)) + l2 * w
        gb = error.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + step / 100)
        w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    return NaiveBayesLinear(keys, w * ratio, float(bias), orders)


def _scored(packed: DataFrame, model: NaiveBayesLinear, with_text: bool = False) -> DataFrame:
    """(row, score), or (row, text, score), of (row, text); one pass without a shuffle."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for a, b, data, offsets in text_slices(batch.column(1)):
            texts = [batch.column(1).slice(a, b - a)] * with_text
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *texts, pa.array(shared.value.scores(data, offsets))], ["row", *["text"] * with_text, "score"])

    return map_arrow(packed, run, with_row(packed, "text string, " * with_text + "score double"))


def score(docs: DataFrame, model: NaiveBayesLinear, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and score (double) of each row; a kept column of that name gives way."""
    return unpacked(_scored(packed_rows(docs, text_col, keep), model), "score")


def clean_documents(docs: DataFrame, model: NaiveBayesLinear, below: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose score is less than `below`."""
    judged = _scored(packed_filter_rows(docs, text_col), model, with_text=True)
    return filtered_rows(judged.where(F.col("score") < below), docs, text_col)

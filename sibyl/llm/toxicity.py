"""A convolutional text classifier over hashed word embeddings, trained in numpy.

Each word has the sum of three hashed embeddings (the word, its first four and its first five bytes, A-Z
lower-cased). Filters over one, two and three neighbouring words, rectified, are max-pooled over the whole text
and feed a logistic output, whose scores are calibrated on rows kept apart. Thresholds are calibrated by language
on the same rows; the language has no part in a score.

Defined results: null and empty texts, and texts without words, get the score of an empty text; a table of labels
without both classes gives every text that share of positives; rows that repeat are scored alike; a text is
scored whole, however long; an empty table gives no rows; columns other than id, text and language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import CALIBRATION, best_threshold, labelled_sample, platt, sigmoid
from .text import Flat, Schema, Spans, cuts, filter_slices, map_slices, type_of

BITS, DIM, WIDTHS, FILTERS = 22, 12, (1, 2, 3), 8
#: Labelled documents of a class and fold that the fit may take.
PER_CLASS = 1500
MIN_TEXTS, EPOCHS, BATCH, RATE = 3, 8, 128, 0.05
#: Gradient steps at least: a small sample is gone through more often than EPOCHS times.
UPDATES = 240
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_buckets(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Three bucket numbers of every word, and the words of each text."""
    buf = flat.lowered().buf
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = _WORD[buf]
    turns = np.diff(inside)
    ws, we = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    spans, drop = Spans(buf), np.uint64(64 - BITS)
    ids = np.stack([spans.hash(ws, we) >> drop, (spans.hash(ws, np.minimum(we, ws + 4)) * np.uint64(0x9E3779B97F4A7C15)) >> drop, (spans.hash(ws, np.minimum(we, ws + 5)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> drop], 1)
    return ids.astype(np.int32), np.diff(np.searchsorted(ws, flat.offsets))


@dataclass
class TextCnn:
    buckets: np.ndarray  # buckets with an embedding; row k + 1 of table belongs to buckets[k], row 0 to all others
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_map"):
            self._map = np.zeros(1 << BITS, np.int32)
            self._map[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return self._map[ids]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_map"}

    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of the filters over each text; the embeddings and responses behind them. Two empty words follow each text."""
        wide = counts + 2
        place = np.arange(len(rows)) + 2 * np.repeat(np.arange(len(counts)), counts)
        X = np.zeros((int(wide.sum()) + 2, DIM), np.float32)
        X[place] = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        n = len(X) - 2
        H = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for w, W in enumerate(self.filters):
            part = X[:n] @ W[0]
            for k in range(1, len(W)):
                part += X[k : n + k] @ W[k]
            H[:, w * FILTERS : (w + 1) * FILTERS] = part
        H += self.bias
        np.maximum(H, 0, out=H)
        pad = np.ones(n, bool)
        pad[place] = False
        H[pad] = 0
        return np.maximum.reduceat(H, np.cumsum(wide) - wide, axis=0) if len(counts) else H[:0], X, H

    def logits(self, flat: Flat) -> np.ndarray:
        ids, counts = word_buckets(flat)
        return self.pooled(self.rows(ids), counts)[0] @ self.out + self.out_bias

    def score(self, flat: Flat) -> np.ndarray:
        return sigmoid(self.slope * self.logits(flat).astype(np.float64) + self.intercept)


def _train(model: TextCnn, ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int) -> None:
    """Stochastic gradient steps with per-parameter scaling (Adagrad). Only places of maxima have a gradient."""
    rng = np.random.default_rng(seed)
    names = ["table", "bias", "out"]
    past = {k: np.full_like(getattr(model, k), 1e-3) for k in names} | {w: np.full_like(W, 1e-3) for w, W in enumerate(model.filters)}
    past_b = 1e-3

    def step(param: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        seen += grad * grad
        param -= RATE * grad / np.sqrt(seen)

    for _ in range(max(EPOCHS, -(-UPDATES // -(-len(y) // BATCH)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            counts = np.array([len(ids[i]) for i in pick])
            rows = model.rows(np.concatenate([ids[i] for i in pick]))
            top, X, H = model.pooled(rows, counts)
            d = ((sigmoid(top @ model.out + model.out_bias) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            wide = counts + 2
            text = np.repeat(np.arange(len(pick)), wide)
            g_top = d[:, None] * model.out[None, :] * (top > 0)
            g_filters = [np.zeros_like(W) for W in model.filters]
            gX = np.zeros_like(X)
            g_bias = g_top.sum(0)
            for f in range(H.shape[1]):
                w, c = divmod(f, FILTERS)
                hits = np.flatnonzero(H[:, f] == top[text, f])
                of = text[hits]
                lead = np.ones(len(hits), bool)
                lead[1:] = of[1:] != of[:-1]
                at, g = hits[lead], g_top[of[lead], f]
                at, g = at[g != 0], g[g != 0]
                for k in range(WIDTHS[w]):
                    g_filters[w][k, :, c] = X[at + k].T @ g
                    gX[at + k] += g[:, None] * model.filters[w][k, :, c][None, :]  # places of one filter differ
            used = np.flatnonzero(np.any(gX[:-2] != 0, axis=1))
            shift = 2 * np.arange(len(pick))
            word = used - shift[text[used]]
            inside = word < np.cumsum(counts)[text[used]]
            word, used = word[inside], used[inside]
            touched, back = np.unique(rows[word].ravel(), return_inverse=True)
            g_rows = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_rows, back, np.repeat(gX[used], 3, axis=0))
            g_rows[touched == 0] = 0
            past["table"][touched] += g_rows * g_rows
            model.table[touched] -= RATE * g_rows / np.sqrt(past["table"][touched])
            step(model.out, past["out"], top.T @ d)
            step(model.bias, past["bias"], g_bias)
            for w, W in enumerate(model.filters):
                step(W, past[w], g_filters[w])
            past_b += float(d.sum()) ** 2
            model.out_bias -= RATE * float(d.sum()) / past_b**0.5


def _buckets_of(texts: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for lo, hi in cuts(column):
        ids, counts = word_buckets(Flat(column.slice(lo, hi - lo)))
        out += np.split(ids, np.cumsum(counts)[:-1])
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", per_class: int = PER_CLASS, seed: int = 7) -> TextCnn:
    """Train on at most per_class documents of each class in each fold that is not held out."""
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, lang_col)
    y, weight, part = (sample[c].to_numpy().astype(np.float64) for c in ("y", "weight", "fold"))
    rng = np.random.default_rng(seed)
    ids = _buckets_of(sample["text"]) if len(y) else []
    train = np.flatnonzero(part != CALIBRATION)
    if not len(train) or y[train].min() == y[train].max():  # too few rows to keep some apart
        train = np.arange(len(y))
    texts_with = np.zeros(1 << BITS, np.int32)
    for i in train:
        texts_with[np.unique(ids[i])] += 1
    buckets = np.flatnonzero(texts_with >= MIN_TEXTS).astype(np.int32)
    model = TextCnn(
        buckets, np.zeros((len(buckets) + 1, DIM), np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )
    if not len(y) or y.min() == y.max():
        share = (float((weight * y).sum()) / float(weight.sum())) if len(y) else 0.0
        model.slope, model.intercept = 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
        return model
    balance = np.where(y[train] == 1, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    _train(model, [ids[i] for i in train], y[train], balance, seed)
    apart = np.flatnonzero(part == CALIBRATION)
    apart = apart if len(apart) and y[apart].min() != y[apart].max() else train
    column = sample["text"].combine_chunks()
    z = np.concatenate([model.logits(Flat(column.slice(int(i), 1))) for i in apart])
    model.slope, model.intercept = platt(z.astype(np.float64), y[apart], weight[apart])
    p = sigmoid(model.slope * z + model.intercept)
    model.default_threshold = best_threshold(p, y[apart], weight[apart])
    groups = np.array(sample["group"].to_pylist(), object)[apart]
    for g in {x for x in groups if x is not None}:
        own = groups == g
        if y[apart][own].sum() >= 20 and (1 - y[apart][own]).sum() >= 20:
            model.thresholds[g] = best_threshold(p[own], y[apart][own], weight[apart][own])
    return model


def _over_threshold(model: TextCnn, score: np.ndarray, part: pa.RecordBatch, lang_col: str | None) -> np.ndarray:
    langs = part.column(lang_col).to_pylist() if lang_col else [None] * len(score)
    return score >= np.array([model.thresholds.get(x, model.default_threshold) for x in langs], np.float64)


def toxicity(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Rows (id, score, toxic): toxic by the threshold of the row's language, or of all languages where it has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(part, flat):
        score = shared.value.score(flat)
        return {id_col: part.column(id_col), "score": score, "toxic": _over_threshold(shared.value, score, part, lang_col)}

    return map_slices(docs, [id_col, text_col, *([lang_col] if lang_col else [])], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "score": "double", "toxic": "boolean"}))


def without_toxic(docs: DataFrame, model: TextCnn, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs without the rows that are toxic by the threshold of their language; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_slices(docs, text_col, lambda part, flat: ~_over_threshold(shared.value, shared.value.score(flat), part, lang_col))

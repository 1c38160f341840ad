"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its features are its own and those of the lines before and after it; a
transition matrix ties neighbours. The field is fitted to lines that carry their document's label, then once more
after lines of bad documents that look good are taken as good (a document stays bad if all its lines would turn
good). Forward and backward passes give the chance that a line is good; their mean, weighted by the length of the
lines, is calibrated to a document score on rows kept apart.

Defined results: null and empty texts, and texts without words, get the score of an even chance; labels without
both classes give every text that share of positives; rows that repeat are scored alike; a text is scored whole,
however many lines; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .labelled import CALIBRATION, labelled_sample, platt, sigmoid
from .quality_rules import _IN, _POINT, _SMALL, _UPPER, repeated_lines
from .text import Flat, Schema, Spans, classes, cuts, group_of, map_slices, mix, per_group, repeated, repeated_windows, type_of, window_places

#: Labelled documents of a class and fold that the fit may take.
PER_CLASS = 1500
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_BANG = np.arange(256) == 33
_SALT = np.uint64(0x9E3779B97F4A7C15)


def line_features(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word, its length in code points, and the number of such lines of each text."""
    ls, le, per_text = flat.lines()
    ws, we, per_words = flat.words()
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    words = last - first
    has = words > 0
    text = group_of(per_text)
    spans = Spans(flat.buf)
    again = repeated_lines(spans, ls, le, text, has, first_too=True)
    word, line = spans.classes(spans.hash(ws, we), ws, we)[0], group_of(words)
    within = repeated(*classes(mix(word.astype(np.uint64) + line.astype(np.uint64) * _SALT), lambda i, j: (word[i] == word[j]) & (line[i] == line[j])), first_too=False)
    place, of = window_places(per_words, 3)
    twice = repeated_windows(word, place, of, 3)
    cover = np.zeros(len(ws) + 3, bool)
    for k in range(3):
        cover[place[twice] + k] = True

    def count(mask: np.ndarray) -> np.ndarray:
        t = flat.tally(mask[flat.buf])
        return (t[le] - t[ls])[has].astype(np.float64)

    def of_words(values: np.ndarray) -> np.ndarray:
        t = np.concatenate([[0], np.cumsum(values)])
        return (t[last] - t[first])[has].astype(np.float64)

    n = words[has].astype(np.float64)
    points = flat.tally(_POINT[flat.buf])
    chars = of_words(points[we] - points[ws])
    symbols, pipes, upper, small, digits, bang = (count(x) for x in (_IN["symbol"], _IN["pipe"], _UPPER, _SMALL, _DIGIT, _BANG))
    ending = _IN["ending"][flat.buf[we[last[has] - 1] - 1]] if has.any() else np.zeros(0, bool)
    X = np.stack([
        np.log1p(n) / 5, np.minimum(chars / n / 10, 2), np.minimum(symbols / n, 1.5), np.minimum(pipes / n, 1.5), upper / (upper + small + 1), np.minimum(digits / chars, 1),
        np.minimum(bang / n, 1.5), ending.astype(np.float64), again[has].astype(np.float64), of_words(within) / n, of_words(cover[: len(ws)]) / n, (n < 4).astype(np.float64),
    ], 1)
    return X, chars, per_group(has, per_text)


def with_neighbours(X: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends), and marks of the ends."""
    ends = np.cumsum(counts)
    head, tail = np.zeros(len(X), bool), np.zeros(len(X), bool)
    head[(ends - counts)[counts > 0]] = True
    tail[ends[counts > 0] - 1] = True
    before, after = np.zeros_like(X), np.zeros_like(X)
    before[1:], after[:-1] = X[:-1], X[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([X, before, after, head[:, None], tail[:, None], np.ones((len(X), 1))], 1)


def _steps(counts: np.ndarray) -> list[np.ndarray]:
    """Line numbers of each step: the t-th lines of all texts that have one."""
    order = np.argsort(-counts, kind="stable")
    start, left = (np.cumsum(counts) - counts)[order], counts[order]
    n_at = np.searchsorted(-left, -np.arange(int(counts.max(initial=0))), "left")
    return [start[:n] + t for t, n in enumerate(n_at)]


def forward_backward(u: np.ndarray, counts: np.ndarray, moves: np.ndarray, count_moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Chance that each line is good, and expected counts of the four moves (zeros without count_moves). u: log odds of each line alone."""
    emit = np.stack([sigmoid(-u), sigmoid(u)], 1)
    M = np.exp(moves)
    alpha, beta = emit.copy(), np.ones_like(emit)
    steps = _steps(counts)
    for t, at in enumerate(steps):
        if t:
            alpha[at] = (alpha[at - 1] @ M) * emit[at]
        alpha[at] /= alpha[at].sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for at in steps[:0:-1]:
        ahead = emit[at] * beta[at]
        if count_moves:
            both = alpha[at - 1][:, :, None] * M[None] * ahead[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        back = ahead @ M.T
        beta[at - 1] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs


@dataclass
class LineField:
    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def marginals(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        X, chars, counts = line_features(flat)
        Z = with_neighbours((X - self.mean) / self.scale, counts)
        return forward_backward(Z @ self.weights, counts, self.moves, False)[0], chars, counts

    def evidence(self, flat: Flat) -> np.ndarray:
        """Log odds of the length-weighted mean chance that a line is good."""
        return self._evidence(*self.marginals(flat))

    @staticmethod
    def _evidence(good: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = per_group(chars, counts)
        share = np.where(weight > 0, per_group(good * chars, counts) / np.maximum(weight, 1), 0.5)
        share = np.clip(share, 1e-3, 1 - 1e-3)
        return np.log(share / (1 - share))

    def score(self, good: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of texts from the marginals of their lines."""
        return sigmoid(self.slope * self._evidence(good, chars, counts) + self.intercept)


def _fit_lines(Z: np.ndarray, y: np.ndarray, counts: np.ndarray, weight: np.ndarray, w: np.ndarray, moves: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam steps on the penalised log likelihood of line labels."""
    inner = np.ones(len(y), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.concatenate([w, moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pairs = forward_backward(Z @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        g = np.concatenate([Z.T @ (weight * (good - y)), (pairs - seen).ravel() * weight.mean()]) / len(y) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, rounds: int = 60) -> LineField:
    """Fit on at most per_class documents of each class in each fold that is not held out."""
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    y, weight, part = (sample[c].to_numpy().astype(np.float64) for c in ("y", "weight", "fold"))
    column = sample["text"].combine_chunks()
    got = [line_features(Flat(column.slice(lo, hi - lo))) for lo, hi in cuts(column)] if len(y) else []
    dim = 12
    X = np.concatenate([g[0] for g in got]) if got else np.zeros((0, dim))
    counts = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.int64)
    model = LineField(np.zeros(3 * dim + 3), np.zeros((2, 2)), np.zeros(dim), np.ones(dim))
    if not len(X) or y.min() == y.max():
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        model.slope, model.intercept = 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
        return model
    train = part != CALIBRATION
    if not train.any() or y[train].min() == y[train].max():
        train = np.ones(len(y), bool)
    lines = np.repeat(train, counts)
    model.mean, model.scale = X[lines].mean(0), X[lines].std(0) + 1e-3
    Z = with_neighbours((X - model.mean) / model.scale, counts)[lines]
    n, of = counts[train], np.repeat(y[train], counts[train])
    even = np.where(of == 1, 0.5 / max(of.mean(), 1e-9), 0.5 / max(1 - of.mean(), 1e-9))
    w, moves = _fit_lines(Z, of, n, even, model.weights, model.moves, rounds)
    good, _ = forward_backward(Z @ w, n, moves)
    alone = sigmoid(Z @ w)
    turned = (of == 0) & (good > 0.5) & (alone > 0.5)
    all_turn = per_group(turned, n) == n
    turned &= ~np.repeat(all_turn, n)
    model.weights, model.moves = _fit_lines(Z, np.where(turned, 1.0, of), n, even, w, moves, rounds // 2)
    apart = np.flatnonzero(~train)
    apart = apart if len(apart) and y[apart].min() != y[apart].max() else np.arange(len(y))
    z = np.concatenate([model.evidence(Flat(column.slice(int(i), 1))) for i in apart])
    model.slope, model.intercept = platt(z, y[apart], weight[apart])
    return model


def quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, n_lines, good_lines). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(part, flat):
        m = shared.value
        good, chars, counts = m.marginals(flat)
        return {id_col: part.column(id_col), "score": m.score(good, chars, counts), "n_lines": counts, "good_lines": per_group(good > 0.5, counts)}

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "score": "double", "n_lines": "long", "good_lines": "long"}))

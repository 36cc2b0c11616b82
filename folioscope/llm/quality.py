"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is computed in linear time as
half of |sum v_j x_j|^2 - sum |v_j|^2 x_j^2. Features of a text: its distinct hashed words (frequency, scaled to
unit length), one bin of each structure statistic, and as metadata bins of its length in characters and lines.

Defined cases: null and empty texts count as texts without words (their bins are features, they get a score);
repeated rows and null ids give one row each; without labels of both kinds the score is the share of label 1, or
0.5 without any; an empty table gives an empty result; further columns pass through (one of
the score's name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from folioscope.llm.common import with_column
from folioscope.llm.labels import fit_sample, share_of_ones

WORD_BITS, FACTORS, BINS = 16, 8, 16
CACHE_WORDS, BATCH = 150_000, 512
_WORDS = 1 << WORD_BITS
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True
_UPPER, _DIGIT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
STATISTICS = ("symbols", "upper", "digits", "breaks", "pipes", "bangs", "word_length", "distinct", "repeats", "first_share", "chars", "lines")
_FEATURES = _WORDS + BINS * len(STATISTICS)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass")) & (_WORDS - 1)
        return h


_hashes = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (ascending) and values of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.lower().split()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, m = max(len(raw), 1), max(len(words), 1)
    hashed = np.array([_hashes[w] for w in words], dtype=np.int64)
    ids, freq = np.unique(hashed, return_counts=True)
    repeats = int((hashed[1:] == hashed[:-1]).sum())
    lines = raw.count(b"\n") + 1
    shares = {
        "symbols": counts[_SYMBOLS].sum() / m,
        "upper": counts[_UPPER].sum() / n,
        "digits": counts[_DIGIT].sum() / n,
        "breaks": lines / m,
        "pipes": counts[124] / m,
        "bangs": counts[33] / m,
        "word_length": n / m / 16,
        "distinct": len(ids) / m,
        "repeats": repeats / m,
        "first_share": (freq.max() if len(freq) else 0) / m,
        "chars": np.log2(n) / 20,
        "lines": np.log2(lines) / 16,
    }
    bins = [_WORDS + BINS * k + min(int(BINS * shares[s] ** (0.5 if shares[s] < 1 else 1)), BINS - 1) for k, s in enumerate(STATISTICS)]
    values = freq / max(float(np.sqrt((freq.astype(float) ** 2).sum())), 1.0)
    return np.concatenate([ids, bins]), np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        ids, x = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        vx = self.factors[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[ids] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.logits([features(t) for t in texts[i : i + BATCH]]) for i in range(0, len(texts), BATCH)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -40, 40)))


def fit(sample: list[tuple[str, int]], *, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; the classes weigh as in the sample."""
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in sample], dtype=float)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return Machine(40.0 * (2 * share - 1), np.zeros(_FEATURES, np.float32), np.zeros((_FEATURES, FACTORS), np.float32))
    rows = [features(t) for t, _ in sample]
    seen = np.bincount(np.concatenate([i for i, _ in rows]), minlength=_FEATURES)
    used = seen >= 3  # words of fewer documents stay at zero
    w = np.zeros(_FEATURES, np.float32)
    v = (rng.normal(0, 0.05, (_FEATURES, FACTORS)) * used[:, None]).astype(np.float32)
    gw, gv, bias, gb = np.full(_FEATURES, 1e-6), np.full((_FEATURES, FACTORS), 1e-6), float(np.log(share / (1 - share))), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            some = [rows[i] for i in part]
            delta = 1 / (1 + np.exp(-np.clip(Machine(bias, w, v).logits(some), -40, 40))) - y[part]
            owner = np.repeat(np.arange(len(some)), [len(i) for i, _ in some])
            ids, x = np.concatenate([i for i, _ in some]), np.concatenate([a for _, a in some])
            own = used[ids]
            owner, ids, x = owner[own], ids[own], x[own]
            vx = v[ids] * x[:, None]
            sums = np.zeros((len(some), FACTORS))
            np.add.at(sums, owner, vx)
            touched, place = np.unique(ids, return_inverse=True)
            d = delta[owner]
            dw = np.bincount(place, d * x) / len(some) + decay * w[touched]
            grad = d[:, None] * (sums[owner] - vx) * x[:, None]
            dv = np.stack([np.bincount(place, grad[:, f]) for f in range(FACTORS)], axis=1) / len(some) + decay * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += delta.mean() ** 2
            w[touched] -= (rate * dw / np.sqrt(gw[touched])).astype(np.float32)
            v[touched] -= (rate * dv / np.sqrt(gv[touched])).astype(np.float32)
            bias -= rate * delta.mean() / np.sqrt(gb)
    return Machine(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Machine:
    """Fits on a bounded sample and moves the bias from the sample's share of label 1 to the share among all labels."""
    sample = fit_sample(docs, labels, "quality", **bounds)
    machine = fit(sample)
    share, own = share_of_ones(labels, "quality"), sum(y for _, y in sample) / max(len(sample), 1)
    if 0 < own < 1:
        machine.bias += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return machine


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and quality_score (0 to 1) of every whole text, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return with_column(docs, text, "quality_score", DoubleType(), lambda column: model.value.scores(column))

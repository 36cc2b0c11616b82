"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word enters as the vector of its hashed form and the elementwise maximum over the vectors of its hashed
character n-grams. The network reads windows of WINDOW words, one every STRIDE words, so that they overlap and
cover the whole text; attention pools the states of a window and the text's score comes from its highest window.
Everything is numpy. The first component of every vector starts as the log odds of its n-gram or word among the
labelled documents; then all weights are trained by back-propagation through time, each toxic document standing
with its highest window, each other with its highest and a random one, chosen anew every round.

Defined cases: null and empty texts count as one window without words (they get a score); repeated rows and null
ids give one row each; without labels of both kinds the score is the share of label 1, or 0.5 without any; an
empty table gives an empty result; further columns pass through (one of
the score's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from folioscope.llm.common import with_column
from folioscope.llm.labels import fit_sample, share_of_ones
from folioscope.llm.simhash import fingerprint

WINDOW, STRIDE, HIDDEN, DIM = 32, 24, 8, 6
WORD_BITS, GRAM_BITS = 18, 18
_EDGE = ".,;:!?\"'()[]{}*#$%&|<>-"
CACHE_WORDS, CACHE_TOKENS, BATCH_WINDOWS, SPELL = 100_000, 1_000_000, 4096, 20_000
COPY_BITS, DOUBT = 8, 1.5


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


_RANDOM = np.random.default_rng(2024).integers(1, 1 << 63, 256 + 8, dtype=np.uint64) | np.uint64(1)
PREFIXES = range(3, 9)


def spelled(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words: of the word within its edges, of all its n-grams, and where each word's n-grams start.

    The n-grams are all runs of 3 and 4 characters of ^word$ and the word's beginnings of 3 to 8 characters.
    """
    marked = [f"^{w.strip(_EDGE) or w}$" for w in vocabulary]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(m) for m in marked])
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    pos = np.arange(len(codes)) - starts[owner]
    each = (codes + np.uint64(1)) * _RANDOM[pos & 255]
    sums = np.cumsum(each)
    owners, grams = [], []
    for n in (3, 4):
        at = np.flatnonzero(pos <= lengths[owner] - n)
        owners.append(owner[at])
        grams.append(sum(codes[at + k] * _RANDOM[256 + k] for k in range(n)) + _RANDOM[259 + n])
    for n in PREFIXES:
        some = np.flatnonzero(lengths - 2 >= n)
        owners.append(some)
        grams.append((sums[starts[some] + n] - sums[starts[some]]) * _RANDOM[261])
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(marked)))
    return _mixed(np.add.reduceat(each, starts), WORD_BITS), _mixed(grams[order], GRAM_BITS), first


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """words, grams: vectors by hash; the rest: weights of the two directions (0 forward, 1 backward) and the pooling."""

    words: np.ndarray
    grams: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def vectors(self, vocabulary: list[str]) -> np.ndarray:
        """The input vectors of words: word vector and maximum over its n-gram vectors."""
        words, grams, first = spelled(vocabulary)
        return np.concatenate([self.words[words], np.maximum.reduceat(self.grams[grams], first, axis=0)], axis=1)

    def inputs(self, vocabulary: list[str]) -> np.ndarray:
        """What every word adds to the gates of both directions (6 * HIDDEN numbers)."""
        return self.vectors(vocabulary) @ np.concatenate([self.w["x0"], self.w["x1"]], axis=1) + np.concatenate([self.w["b0"], self.w["b1"]])

    def run(self, gates: np.ndarray, table: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (time, window, 2 * HIDDEN) of windows given as rows of ``table`` (window, time)."""
        n, steps = table.shape
        states = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
        for d in (0, 1):
            own, wh = gates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], self.w[f"h{d}"]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                a, r = own[table[:, t]], h @ wh
                zr = _sigmoid(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if keep is not None:
                    keep.append((d, t, h, z, reset, c, r[:, 2 * HIDDEN :]))
                h = new
                states[t, :, HIDDEN * d : HIDDEN * (d + 1)] = h
        return states, table > 0

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of windows, attention (time, window) and pooled states."""
        e = states @ self.w["att"]
        real = real.T.copy()
        real[0] |= ~real.any(axis=0)
        e = np.where(real, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.w["out"] + self.w["c"][0], a, pooled

    def window_logits(self, gates: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(table), dtype=np.float32)
        for at in range(0, len(table), BATCH_WINDOWS):
            out[at : at + BATCH_WINDOWS] = self.pool(*self.run(gates, table[at : at + BATCH_WINDOWS]))[0]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; vocabulary and windows of so many texts as stay within the cache at a time."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            place: dict[str, int] = {}
            numbered, size = [], 0
            while at + len(numbered) < len(texts) and len(place) < CACHE_WORDS and size < CACHE_TOKENS:
                numbered.append(_numbered(split(texts[at + len(numbered)]), place))
                size += len(numbered[-1])
            gates = self.gates(list(place))
            tables = [windows(n) for n in numbered]
            logits = self.window_logits(gates, np.concatenate(tables))
            best = np.maximum.reduceat(logits, np.cumsum([0, *(len(t) for t in tables[:-1])]))
            out[at : at + len(numbered)] = _sigmoid(np.clip(self.scale * best + self.shift, -40, 40))
            at += len(numbered)
        return out

    def gates(self, vocabulary: list[str]) -> np.ndarray:
        """inputs() of the vocabulary after a first row of no word (number 0)."""
        out = np.empty((len(vocabulary) + 1, 6 * HIDDEN), dtype=np.float32)
        out[0] = np.concatenate([self.w["b0"], self.w["b1"]])
        for i in range(0, len(vocabulary), SPELL):
            out[i + 1 : i + 1 + SPELL] = self.inputs(vocabulary[i : i + SPELL])
        return out


def _numbered(tokens: list[str], place: dict[str, int]) -> np.ndarray:
    """Numbers from 1 of the tokens in the vocabulary, which grows by the new ones."""
    for t in set(tokens):
        place.setdefault(t, len(place) + 1)
    return np.array([place[t] for t in tokens], dtype=np.int32)


def windows(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text (window, time): one every STRIDE words until the end, filled up with 0."""
    count = max(1, -(-(len(numbers) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.int32)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _log_odds(rows: Iterable[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every hash by documents, less DOUBT standard errors, and the hashes of at least three documents."""
    ones, zeros = np.zeros(size), np.zeros(size)
    for ids, label in zip(rows, y, strict=True):
        (ones if label else zeros)[np.unique(ids)] += 1
    p, q = y.sum(), len(y) - y.sum()
    odds = np.log((ones + 0.5) / (p + 1)) - np.log((zeros + 0.5) / (q + 1))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5)), 0)
    often = ones + zeros >= 3
    return np.where(often, np.clip(sure, -1, 5), 0.0).astype(np.float32), often


def fit(sample: list[tuple[str, int]], *, share: float = 0.1, rounds: int = 3, steps: int = 120, batch: int = 96, rate: float = 0.01, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    sample = _without_copies(sample)
    y = np.array([label for _, label in sample], dtype=int)
    if len(set(y.tolist())) < 2:
        return Network(np.zeros((1, DIM)), np.zeros((1, DIM)), constant=float(y.mean()) if len(y) else 0.5)
    place: dict[str, int] = {}
    numbered = [_numbered(split(t), place) for t, _ in sample]
    vocabulary = list(place)
    word_of, grams_of = np.zeros(1, dtype=np.int64), [np.zeros(0, dtype=np.int32)]
    for i in range(0, len(vocabulary), SPELL):
        word_ids, gram_ids, first = spelled(vocabulary[i : i + SPELL])
        word_of = np.concatenate([word_of, word_ids])
        grams_of += np.split(gram_ids.astype(np.int32), first[1:])
    distinct = [np.unique(n) for n in numbered]
    words, word_used = _log_odds((word_of[n] for n in distinct), y, 1 << WORD_BITS)
    grams, gram_used = _log_odds((np.concatenate([grams_of[i] for i in n]) if len(n) else np.zeros(0, dtype=int) for n in distinct), y, 1 << GRAM_BITS)
    net = Network(np.zeros((1 << WORD_BITS, DIM), np.float32), np.zeros((1 << GRAM_BITS, DIM), np.float32))
    net.words[:, 0], net.grams[:, 0] = words, grams
    for d in (0, 1):
        net.w[f"x{d}"] = rng.normal(0, 0.3, (2 * DIM, 3 * HIDDEN)).astype(np.float32)
        net.w[f"h{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        net.w[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    net.w["att"], net.w["out"], net.w["c"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    tables = [windows(n) for n in numbered]
    lexical = np.concatenate([[0], np.maximum(words[word_of[1:]], 0) + np.array([max(grams[g].max(), 0) for g in grams_of[1:]])])
    best = [int(lexical[t].max(axis=1).argmax()) for t in tables]
    state = _Adam(net, rate)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(rounds):
        for _ in range(steps):
            pos, neg = rng.choice(ones, batch // 2), rng.choice(zeros, batch // 2)
            picked = [tables[i][best[i]] for i in (*pos, *neg)]
            picked[-(batch // 4) :] = [tables[i][rng.integers(len(tables[i]))] for i in neg[-(batch // 4) :]]
            table = np.stack(picked)
            state.step(*_gradients(net, table, np.repeat([1.0, 0.0], batch // 2), word_of, grams_of, word_used, gram_used))
        gates = net.gates(vocabulary)
        logits = net.window_logits(gates, np.concatenate(tables))
        at = np.cumsum([0, *map(len, tables)])
        best = [int(logits[a:b].argmax()) for a, b in zip(at, at[1:], strict=False)]
    top = np.array([logits[a:b].max() for a, b in zip(at, at[1:], strict=False)])
    net.scale, net.shift = _calibrated(top, y, share)
    return net


def _without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Near copies within the sample (by SimHash) stand once, lest the words of one text count as evidence of many."""
    kept, prints = [], {0: [], 1: []}
    for text, label in sample:
        own = np.uint64(fingerprint(text))
        if not (np.bitwise_count(np.array(prints[label], dtype=np.uint64) ^ own) <= COPY_BITS).any():
            prints[label].append(own)
            kept.append((text, label))
    return kept


def _calibrated(top: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the highest window's logit; label 1 weighs ``share``."""
    mean, sd = float(top.mean()), float(top.std()) or 1.0
    x, a, b = (top - mean) / sd, 1.0, 0.0
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    for _ in range(300):
        d = weight * (_sigmoid(np.clip(a * x + b, -30, 30)) - y)
        a, b = a - 4.0 * float((d * x).sum() + 1e-3 * a), b - 4.0 * float(d.sum())
    return a / sd, b - a * mean / sd


def _gradients(net: Network, table: np.ndarray, y: np.ndarray, word_of: np.ndarray, grams_of: list[np.ndarray], word_used: np.ndarray, gram_used: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the mean logistic loss: of the weights, and (rows, gradient) of the vectors."""
    used, place = np.unique(table, return_inverse=True)
    place = place.reshape(table.shape)
    real = used > 0
    chars = np.zeros((len(used), DIM), np.float32)
    winners = np.zeros((len(used), DIM), dtype=int)
    for i, u in enumerate(used):
        if u:
            own = net.grams[grams_of[u]]
            k = own.argmax(axis=0)
            chars[i], winners[i] = own[k, range(DIM)], grams_of[u][k]
    x = np.concatenate([net.words[word_of[used]] * real[:, None], chars], axis=1)
    gates = np.concatenate([x @ net.w[f"x{d}"] + net.w[f"b{d}"] for d in (0, 1)], axis=1).astype(np.float32)
    keep: list = []
    states, _ = net.run(gates, place, keep)
    logits, a, pooled = net.pool(states, table > 0)
    delta = ((_sigmoid(np.clip(logits, -30, 30)) - y) / len(y)).astype(np.float32)
    g = {"out": pooled.T @ delta, "c": np.array([delta.sum()])}
    dpooled = delta[:, None] * net.w["out"]
    da = np.einsum("tnh,nh->tn", states, dpooled)
    de = a * (da - (a * da).sum(axis=0))
    g["att"] = np.einsum("tn,tnh->h", de, states)
    dstates = a[:, :, None] * dpooled + de[:, :, None] * net.w["att"]
    dgates = np.zeros_like(gates)
    for d in (0, 1):
        wh, gh = net.w[f"h{d}"], np.zeros_like(net.w[f"h{d}"])
        dh = np.zeros((len(table), HIDDEN), np.float32)
        for _, t, h, z, reset, c, rc in reversed([k for k in keep if k[0] == d]):
            dh = dh + dstates[t, :, HIDDEN * d : HIDDEN * (d + 1)]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * rc * reset * (1 - reset)
            back = np.concatenate([dz, dr, dc * reset], axis=1)
            gh += h.T @ back
            np.add.at(dgates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], place[:, t], np.concatenate([dz, dr, dc], axis=1))
            dh = dh * (1 - z) + back @ wh.T
        own = dgates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
        g[f"h{d}"], g[f"b{d}"], g[f"x{d}"] = gh, own.sum(axis=0), x.T @ own
    dx = sum(dgates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] @ net.w[f"x{d}"].T for d in (0, 1))
    rows, vectors = word_of[used][real], dx[real, :DIM]
    own = word_used[rows]
    gram_rows, gram_vectors = winners[real], dx[real, DIM:]
    return g, {"words": (rows[own], vectors[own]), "grams": (gram_rows, gram_vectors * gram_used[gram_rows])}


class _Adam:
    """Adam for the weights, Adagrad for the vectors that a batch touches."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: [np.zeros_like(v, dtype=float), np.zeros_like(v, dtype=float)] for k, v in net.w.items()}
        self.seen = {"words": np.full(net.words.shape, 1e-4, np.float32), "grams": np.full(net.grams.shape, 1e-4, np.float32)}

    def step(self, g: dict, vectors: dict) -> None:
        self.t += 1
        for k, v in g.items():
            m, s = self.m[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            self.net.w[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        rows, d = vectors["words"]
        self._move("words", rows[:, None], np.arange(DIM)[None], d)
        rows, d = vectors["grams"]
        self._move("grams", rows, np.broadcast_to(np.arange(DIM), rows.shape), d)

    def _move(self, name: str, rows: np.ndarray, columns: np.ndarray, d: np.ndarray) -> None:
        target, seen = getattr(self.net, name), self.seen[name]
        np.add.at(seen, (rows, columns), d * d)
        np.add.at(target, (rows, columns), -self.rate * d / np.sqrt(seen[rows, columns]))


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Network:
    """Fits on a bounded sample; the score is calibrated to the share of label 1 among all labels outside the fold."""
    return fit(fit_sample(docs, labels, "toxic", **bounds), share=share_of_ones(labels, "toxic"))


def score(docs: DataFrame, network: Network, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and toxic_score (0 to 1) of every whole text, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    return with_column(docs, text, "toxic_score", DoubleType(), lambda column: model.value.scores(column))

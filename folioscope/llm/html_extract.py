"""Main text of HTML pages: a recurrent labeller of leaf blocks.

A numpy bidirectional LSTM reads the leaf blocks of a page in order. A block enters as the vector of its tag path,
the vector of its hashed words and a few measures (length, links, closing mark, place); the network sees the whole
page in both directions and gives every block the probability of belonging to the article.

Defined cases: null, empty and text-free pages give the empty string; text outside any element is a block like any
other; repeated rows and null keys give one row each; an empty table gives an empty result; further columns pass
through unchanged (a column ``text`` is replaced). Pages are read whole and no block is capped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from folioscope.llm.common import with_column
from folioscope.llm.html_blocks import Block, Node, blocks
from folioscope.llm.html_pages import LAYOUTS, made_page

PATH_BITS, WORD_BITS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 13, 17, 12, 6, 10, 12
INPUT = PATH_DIM + WORD_DIM + MEASURES
FIT_PAGES, CELLS, UNREAD, COMMON, KNOWN_PATHS = 2400, 60_000, 0.35, 0.005, 8


@lru_cache(maxsize=100_000)
def _hash(token: str, bits: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _measures(found: list[Block]) -> np.ndarray:
    """Length, links, closing mark, place; the share of the page's characters in the same container and in the one around it,
    and whether the blocks before and after have the same container."""
    n, total = len(found), sum(len(b.text) for b in found) or 1
    inner = [b.node.container() if b.node else None for b in found]
    outer = [c.container() if c else None for c in inner]
    held: dict = {}
    for b, i, o in zip(found, inner, outer, strict=True):
        for key in ((0, i), (1, o)):
            held[key] = held.get(key, 0) + len(b.text)
    rows = [
        (
            np.log1p(len(b.text)) / 8, b.linked, b.text[-1] in ".!?:;…", len(b.text) < 25, k / n, 1.0,
            held[0, inner[k]] / total, held[1, outer[k]] / total, k > 0 and inner[k] is inner[k - 1], k + 1 < n and inner[k] is inner[k + 1],
        )
        for k, b in enumerate(found)
    ]
    return np.array(rows, dtype=np.float32).reshape(n, MEASURES)


def _bags(bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and owners; every bag has one at least."""
    return np.array([i for b in bags for i in b], dtype=np.int64), np.repeat(np.arange(len(bags)), [len(b) for b in bags])


@dataclass
class Labeller:
    w: dict[str, np.ndarray]

    def inputs(self, pages: list[list[Block]], keep: dict | None = None) -> np.ndarray:
        """One row per block of the pages, one after another. Fitting (with ``keep``) lists the tokens of every path."""
        found = [b for p in pages for b in p]
        word_ids, word_of = _bags([[_hash(t, WORD_BITS) for t in b.text.lower().split()] for b in found])
        word_n = np.bincount(word_of)
        if keep is None:
            paths = self.paths(found)
        else:
            path_ids, path_of = _bags([[_hash(t, PATH_BITS) for t in b.path] or [_hash("", PATH_BITS)] for b in found])
            path_n = np.sqrt(np.bincount(path_of))
            paths = np.add.reduceat(self.w["path"][path_ids], np.searchsorted(path_of, np.arange(len(found))), axis=0) / path_n[:, None]
        words = np.add.reduceat(self.w["word"][word_ids], np.searchsorted(word_of, np.arange(len(found))), axis=0) / word_n[:, None]
        if keep is not None:
            keep |= {"path": (path_ids, path_of, path_n), "word": (word_ids, word_of, word_n)}
        return np.concatenate([paths, words, np.concatenate([_measures(p) for p in pages])], axis=1).astype(np.float32)

    def paths(self, found: list[Block]) -> np.ndarray:
        """The path vectors of blocks: sums along the shared nodes, each node added once."""
        known: list[Node] = []
        for b in found:
            new, at = [], b.node
            while at is not None and at.number < 0:
                at.number = -2  # on the way
                new.append(at)
                at = at.parent
            for node in reversed(new):
                node.number = len(known)
                known.append(node)
        own, owner = _bags([[_hash(t, PATH_BITS) for t in n.tokens] for n in known]) if known else (np.zeros(0, np.int64),) * 2
        sums = np.zeros((len(known) + 1, PATH_DIM))
        np.add.at(sums, owner, self.w["path"][own])
        sizes = [len(n.tokens) for n in known]
        for k, node in enumerate(known):
            if node.parent is not None:
                sums[k] += sums[node.parent.number]
                sizes[k] += sizes[node.parent.number]
        sums[-1] = self.w["path"][_hash("", PATH_BITS)]  # text outside any element
        at = np.array([len(known) if b.node is None else b.node.number for b in found], dtype=np.int64)
        for node in known:
            node.number = -1
        return sums[at] / np.sqrt(np.array([*sizes, 1]))[at][:, None]

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (page, time, input) -> states (page, time, 2 * HIDDEN)."""
        pages, steps, _ = x.shape
        out = np.zeros((pages, steps, 2 * HIDDEN), dtype=np.float32)
        for d in (0, 1):
            gates = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
            h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                a = gates[:, t] + h @ self.w[f"h{d}"]
                ifo = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
                i, f, o, g = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                new = f * c + i * g
                tc = np.tanh(new)
                if keep is not None:
                    keep.append((d, t, h, c, i, f, o, g, tc))
                c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
                out[:, t, HIDDEN * d : HIDDEN * (d + 1)] = h
        return out

    def logits(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        return states @ self.w["out"] + x @ self.w["skip"] + self.w["c"][0]

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of every block of every page; pages of like length run together."""
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        while order:
            group = [order.pop()]
            while order and len(pages[group[0]]) * (len(group) + 1) <= CELLS and 2 * len(pages[order[-1]]) >= len(pages[group[0]]):
                group.append(order.pop())
            x, mask = _padded([self.inputs([pages[i]]) for i in group])
            p = 1 / (1 + np.exp(-self.logits(x, self.states(x, mask))))
            for k, i in enumerate(group):
                out[i] = p[k, : len(pages[i])]
        return out

    def main_texts(self, pages: list[str | None]) -> list[str]:
        found = [blocks(p) for p in pages]
        return ["\n".join(b.text for b, p in zip(own, ps, strict=True) if p >= 0.5) for own, ps in zip(found, self.probabilities(found), strict=True)]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), max(map(len, rows)), INPUT), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def _gradients(net: Labeller, pages: list[list[Block]], y: list[np.ndarray], rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """With rng, a share of UNREAD blocks is taken without words, so that path and context have to tell them."""
    bags: dict = {}
    rows = net.inputs(pages, bags)
    read = np.ones(len(rows)) if rng is None else (rng.random(len(rows)) >= UNREAD).astype(float)
    rows[:, PATH_DIM : PATH_DIM + WORD_DIM] *= read[:, None]
    ends = np.cumsum([len(p) for p in pages])
    x, mask = _padded(np.split(rows, ends[:-1]))
    want = np.zeros_like(mask)
    for i, v in enumerate(y):
        want[i, : len(v)] = v
    keep: list = []
    states = net.states(x, mask, keep)
    delta = mask * (1 / (1 + np.exp(-net.logits(x, states))) - want) / mask.sum()
    g = {"out": np.einsum("pth,pt->h", states, delta), "skip": np.einsum("pti,pt->i", x, delta), "c": np.array([delta.sum()])}
    dx = delta[:, :, None] * net.w["skip"]
    dstates = delta[:, :, None] * net.w["out"]
    for d in (0, 1):
        wh = net.w[f"h{d}"]
        g[f"h{d}"], da_all = np.zeros_like(wh), np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((len(pages), HIDDEN)), np.zeros((len(pages), HIDDEN))
        for _, t, h, c, i, f, o, gg, tc in reversed([k for k in keep if k[0] == d]):
            m = mask[:, t, None]
            dh = dh + dstates[:, t, HIDDEN * d : HIDDEN * (d + 1)]
            dnew = m * (dc + dh * o * (1 - tc * tc))
            da = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), m * dh * tc * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
            da_all[:, t] = da
            g[f"h{d}"] += h.T @ da
            dc = dnew * f + (1 - m) * dc
            dh = da @ wh.T + (1 - m) * dh
        g[f"x{d}"], g[f"b{d}"] = np.einsum("pti,ptg->ig", x, da_all), da_all.sum(axis=(0, 1))
        dx += da_all @ net.w[f"x{d}"].T
    own = dx[mask > 0]
    for name, part in (("path", own[:, :PATH_DIM]), ("word", own[:, PATH_DIM : PATH_DIM + WORD_DIM] * read[:, None])):
        ids, owner, n = bags[name]
        g[name] = np.zeros_like(net.w[name])
        np.add.at(g[name], ids, (part / n[:, None])[owner])
    return g


def fit(pages: int = FIT_PAGES, *, layouts: tuple[str, ...] = LAYOUTS, epochs: int = 8, batch: int = 40, rate: float = 0.01, seed: int = 3) -> Labeller:
    """Adam on the logistic loss over ``pages`` made pages of these families of layouts."""
    rng = np.random.default_rng(seed)
    data = []
    for k in range(pages):
        markup, main = made_page(seed * 1_000_000 + k, layouts)
        found = blocks(markup)
        if found:
            data.append((found, np.array([b.text in main for b in found], dtype=np.float32)))
    w = {"path": rng.normal(0, 0.1, (1 << PATH_BITS, PATH_DIM)), "word": np.zeros((1 << WORD_BITS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "skip": rng.normal(0, 0.1, INPUT), "c": np.zeros(1)}
    pages_of_token = np.zeros(1 << PATH_BITS)
    for found, _ in data:
        pages_of_token[list({_hash(t, PATH_BITS) for b in found for t in b.path})] += 1
    pages_of_word = np.zeros(1 << WORD_BITS)
    for found, _ in data:
        pages_of_word[list({_hash(t, WORD_BITS) for b in found for t in b.text.lower().split()})] += 1
    common = (pages_of_word > COMMON * len(data))[:, None]  # rarer words keep a zero vector
    telling = (pages_of_token >= KNOWN_PATHS)[:, None]  # names that few pages share keep a zero vector, as unseen ones have
    w["path"] *= telling
    for d in (0, 1):
        w[f"x{d}"], w[f"h{d}"], w[f"b{d}"] = rng.normal(0, 0.25, (INPUT, 4 * HIDDEN)), rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
    net = Labeller({k: v.astype(np.float32) for k, v in w.items()})
    moments = {k: (np.zeros(v.shape, np.float32), np.zeros(v.shape, np.float32)) for k, v in net.w.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][0]) // 12 for i in order], kind="stable")]
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(groups)):
            t += 1
            for name, g in _gradients(net, [data[i][0] for i in groups[k]], [data[i][1] for i in groups[k]], rng).items():
                g = g * common if name == "word" else g * telling if name == "path" else g
                m, s = moments[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                net.w[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    return fit()


def extract(pages: DataFrame, net: Labeller | None = None, *, html: str = "html") -> DataFrame:
    """All columns of ``pages`` and text, the main text of every page (one line per block), without a shuffle."""
    model = pages.sparkSession.sparkContext.broadcast(net or labeller())
    return with_column(pages, html, "text", StringType(), lambda column: model.value.main_texts(column))

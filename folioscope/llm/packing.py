"""Cost-balanced packing of token ids into sequences.

A document costs ``linear`` per token and ``quadratic`` per squared token of attention. Each task packs windows of
its documents: whole sequences are cut off documents longer than one, what is left is assigned in descending
length to the sequence of lowest cost with remaining capacity, cut where that capacity ends. The capacities of a
window add up to its tokens: as many full sequences as fit, then one sequence for each power of two in the rest,
which needs no padding. Nothing is shuffled and a task holds one window.

Defined cases: a null text counts as empty; every document ends with ``end_id``, so it has one id at least; a
sequence that is a power of two long is not padded; repeated rows are packed one by one; null ids are kept; an
empty table gives an empty result; further columns are ignored. Documents of equal length go by id. Sequence ids
number the sequences of a partition from partition * 2^36 on; the rows of a partition must come in the same order
whenever it is computed again (as from files or a checkpoint).
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, END_ID, WINDOW = 1024, 0, 4_000_000
#: Rows whose texts are encoded together.
SLICE = 500
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Distinct chunks a task remembers at a time, and those a worker keeps for its next task.
KNOWN, KEPT = 500_000, 150_000
# White space as the split pattern of byte-level vocabularies sees it (fixed values, Unicode White_Space).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No token of such a vocabulary goes on from other characters to white space, nor from letters to digits or signs, and what
#: follows does not depend on what went before, so these chunks are encoded apart.
_CHUNKS = re.compile(f"[{_WHITE}]*[A-Za-z]+(?=[!-@\\[-`{{-~])|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_SPACED = re.compile(f"[{_WHITE}]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Texts -> ids (little-endian unsigned 32-bit) as the tokenizers library gives them, without special tokens added.

    With a byte-level vocabulary every distinct chunk (white space and what follows it) is encoded once and
    remembered, up to KNOWN chunks at a time and KEPT between tasks; other files take whole texts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, spec = _tokenizer(path), json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        byte_level = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        self.apart = byte_level and spec.get("normalizer") is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _SPACED.search(t["content"]) for t in spec["added_tokens"])
        # a special token must lie in one chunk
        self.apart = self.apart and all(_CHUNKS.fullmatch(t["content"]) and len(_CHUNKS.findall("a" + t["content"])) <= 2 for t in spec["added_tokens"])
        self.known: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False))]

    def trim(self, to: int) -> None:
        """Forgets all but the chunks met first, which are the frequent ones."""
        if len(self.known) > to:
            self.known = dict(itertools.islice(self.known.items(), to))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self.ids(texts)
        if len(self.known) > KNOWN:
            self.trim(KEPT)
        split = [_CHUNKS.findall(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, self.ids(new), strict=True))
        known = self.known
        return [b"".join([known[c] for c in chunks]) for chunks in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def assign(lengths: list[int], capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, start in it, length, sequence) pieces; lengths descending, capacities of at least as many tokens.

    The next longest item (or rest of one) goes to the sequence of lowest cost with remaining capacity.
    """
    waiting = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    most = max(capacities, default=0)
    full = [c for c in capacities if c == most]
    open_ = [(0.0, s) for s in range(len(full))]
    later = list(range(len(full), len(capacities)))
    left, pieces = list(capacities), []
    while waiting:
        if not open_:
            open_ = [(0.0, later.pop(0))]
        size, item, start = heapq.heappop(waiting)
        cost, s = heapq.heappop(open_)
        n = min(-size, left[s])
        pieces.append((item, start, n, s))
        left[s] -= n
        if left[s]:
            heapq.heappush(open_, (cost + linear * n + quadratic * n * n, s))
        if n < -size:
            heapq.heappush(waiting, (size + n, item, start + n))
    return pieces


def _window(docs: list[tuple[int | None, np.ndarray]], first: int, sequence: int) -> tuple[list[tuple], int]:
    """Pieces of one window and the number of its sequences; first: the id of its first sequence."""
    found, rests, used = [], [], 0
    for doc, ids in docs:
        whole = len(ids) // sequence
        found += [(doc, ids, k * sequence, sequence, first + used + k, 0) for k in range(whole)]
        used += whole
        if len(ids) % sequence:
            rests.append((doc, ids, whole * sequence))
    rests.sort(key=lambda r: (-(len(r[1]) - r[2]), r[0] is None, r[0] or 0))
    lengths = [len(ids) - start for _, ids, start in rests]
    total = sum(lengths)
    capacities = [sequence] * (total // sequence) + [1 << b for b in reversed(range(sequence.bit_length())) if (total % sequence) >> b & 1]
    filled = [0] * len(capacities)
    for item, start, n, s in assign(lengths, capacities):
        doc, ids, base = rests[item]
        found.append((doc, ids, base + start, n, first + used + s, filled[s]))
        filled[s] += n
    return found, used + len(capacities)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = [
            [p[0] for p in found],
            [p[2] for p in found],
            [p[3] for p in found],
            [crc32(p[1][p[2] : p[2] + p[3]].astype("<u4").tobytes()) for p in found],
            [len(p[1]) for p in found],
            [p[4] for p in found],
            [p[5] for p in found],
        ]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        first, held, size = TaskContext.get().partitionId() << 36, [], 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for docs_, texts in _slices(batches):
            for doc, ids in zip(docs_, encode(texts), strict=True):
                held.append((doc, np.frombuffer(ids + end, dtype="<u4")))
                size += len(held[-1][1])
                if size >= window:
                    found, used = _window(held, first, sequence)
                    yield rows(found)
                    first, held, size = first + used, [], 0
        encode.trim(KEPT)
        if held:
            yield rows(_window(held, first, sequence)[0])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)

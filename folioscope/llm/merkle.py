"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; a section ends at a blank line or at a paragraph whose digest starts with a small byte, so
sections follow the content and an edit changes only those around it. Roots are equal exactly for equal texts.

A fingerprint is the root and the branches below: consecutive leaves cut by content (places whose last characters
hash to many trailing zeros, ends of paragraphs and sections being favoured), each with its digest, its length and
the strength of its cut. Digests of neighbouring leaves compose to that of the text they cover, so the digest of any
branch above follows from the leaves, and leaves of a short text can be compared with the wider ones of a long text.
The leaves get wider with the text, so that there are about LEAVES at most: a fingerprint places an edit to about
1 / LEAVES of the text, and exactly in texts of up to LEAVES characters.

Two fingerprints are compared top-down: equal roots; then the longest head and tail whose composed digests agree, which
locates the edits between them; then the branches that both middles hold. The likeness is the share of characters
in agreeing branches.

Defined cases: a null text counts as empty and has the fingerprint of the empty text; null ids come first; rows
with the same id are ordered by a hash of the text; repeated rows give one row each; of a single row the next is itself;
an empty table gives an empty result; further columns are ignored. The rows of a DataFrame must come in the same
partitions whenever it is read (as from files or a checkpoint); rows that do not raise an error.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE, shuffle_partitions

#: Leaves of a fingerprint are 2^level characters wide on average, 4 * 2^level at most; level: the least for LEAVES leaves.
LEAVES = 128
#: Branches that occur at different places of two texts count from this level on (8 characters on average).
MOVED_LEVEL = 3
#: By so many levels the end of a paragraph, and that of a section once more, is a stronger cut than other places.
FAVOUR = 4
#: Characters of a text in hand at a time.
STRETCH = 1 << 20
#: Rows of a part (a range of ids) and of the sample that finds the ranges, for every part.
PART_BYTES, OVERSAMPLE = 64_000_000, 40
SECTION_BYTE = 64
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tree(text: str | bytes | None) -> list[list[bytes]]:
    """The paragraph digests of each section."""
    body = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
    sections: list[list[bytes]] = [[]]
    for paragraph in body.split(b"\n"):
        digest = sha256(b"\0" + paragraph).digest()
        sections[-1].append(digest)
        if not paragraph.strip() or digest[0] < SECTION_BYTE:
            sections.append([])
    return [s for s in sections if s]


def section_digests(sections: list[list[bytes]]) -> list[bytes]:
    return [sha256(b"\1" + b"".join(s)).digest() for s in sections]


def root(sections: list[list[bytes]]) -> bytes:
    return sha256(b"\2" + b"".join(section_digests(sections))).digest()


def differing(a: list[list[bytes]], b: list[list[bytes]]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The ranges of paragraphs (start, end) of either tree outside which both are equal; None for equal roots.

    Equal sections are skipped by their digests; only the first and last differing ones are opened.
    """
    if root(a) == root(b):
        return None

    def same(x: list[list[bytes]], y: list[list[bytes]], step: int) -> int:
        dx, dy = section_digests(x)[::step], section_digests(y)[::step]
        k = next((i for i, (p, q) in enumerate(zip(dx, dy, strict=False)) if p != q), min(len(dx), len(dy)))
        equal = sum(len(s) for s in x[::step][:k])
        rest = zip([p for s in x[::step][k:] for p in s[::step]], [p for s in y[::step][k:] for p in s[::step]], strict=False)
        for p, q in rest:
            if p != q:
                break
            equal += 1
        return equal

    sizes = [sum(map(len, t)) for t in (a, b)]
    head = same(a, b, 1)
    tail = min(same(a, b, -1), min(sizes) - head)
    return (head, sizes[0] - tail), (head, sizes[1] - tail)


@dataclass(frozen=True)
class Branches:
    """The leaves of a fingerprint: digests, lengths, strengths of the cuts after them; level and root."""

    root: str
    level: int
    digests: np.ndarray
    lengths: np.ndarray
    strengths: np.ndarray


def _mixed(points: np.ndarray) -> np.ndarray:
    x = (points + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _table(base: int) -> np.ndarray:
    out = np.full(STRETCH, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _table(_BASE), _table(_INVERSE)


def _power(base: int, table: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2^64."""
    if not len(exponents) or exponents.max() < STRETCH:
        return table[exponents]
    far = np.array([pow(base, STRETCH * k, 1 << 64) for k in range(int(exponents.max()) // STRETCH + 1)], dtype=np.uint64)
    return table[exponents % STRETCH] * far[exponents // STRETCH]


def _cuts(text: str, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, strengths, digests of the text up to each place), the last place being the end of the text."""
    widest, last, total = 4 << level, 0, 0
    places, strengths, digests = [], [], []
    before = np.zeros(3, dtype=np.uint64)
    for start in range(0, len(text), STRETCH):
        points = np.frombuffer(text[start : start + STRETCH].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(points)
        mixed = _mixed(points)
        sums = np.cumsum(mixed * _POWERS[:n]) * np.uint64(pow(_BASE, start, 1 << 64)) + np.uint64(total)
        context = np.concatenate([before, mixed])
        near = _mixed(context[3:] + context[2:-1] * np.uint64(3) + context[1:-2] * np.uint64(5) + context[:-3] * np.uint64(7))
        strength = np.bitwise_count((near & -near) - np.uint64(1)).astype(np.int64)
        line = points == 10
        strength += FAVOUR * line
        strength[1:] += FAVOUR * (line[1:] & line[:-1])
        own = np.flatnonzero(strength >= level)
        ends, power = np.append(own + 1, n), strength[own]
        starts = np.concatenate([[last - start], own + 1])
        more = np.maximum(ends - starts - 1, 0) // widest  # cuts where content gives none for too long
        forced = np.repeat(starts, more) + widest * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        at = np.concatenate([own + 1, forced])
        order = np.argsort(at, kind="stable")
        at = at[order]
        places.append(at + start)
        strengths.append(np.concatenate([power, np.zeros(len(forced), np.int64)])[order])
        digests.append(sums[at - 1])
        last = int(at[-1]) + start if len(at) else last
        before, total = context[-3:], int(sums[-1])
    found = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((places, np.int64), (strengths, np.int64), (digests, np.uint64))]
    if text and last < len(text):
        found = [np.append(x, v) for x, v in zip(found, (np.int64(len(text)), np.int64(0), np.uint64(total)), strict=True)]
    return found[0], found[1], found[2]


def branches(text: str | None) -> Branches:
    text = text or ""
    level = max(0, (-(-len(text) // LEAVES) - 1).bit_length())
    places, strengths, sums = _cuts(text, level)
    starts = np.concatenate([[0], places[:-1]]) if len(places) else places
    digests = np.diff(sums, prepend=np.uint64(0)) * _power(_INVERSE, _INVERSES, starts)
    return Branches(root(tree(text)).hex(), level, digests.astype(np.uint32), places - starts, np.minimum(strengths, 255))


def _length_type(level: int) -> str:
    return "<u2" if 4 << level < 1 << 16 else "<u4"


def printed(own: Branches) -> str:
    data = own.digests.astype("<u4").tobytes() + own.lengths.astype(_length_type(own.level)).tobytes() + own.strengths.astype("u1").tobytes()
    return f"{own.root}.{own.level:02x}{base64.b64encode(data).decode()}"


def fingerprint(text: str | None) -> str:
    """``<root, hex>.<level, hex><leaves: digests, lengths, strengths, base64>``"""
    return printed(branches(text))


def parsed(print_: str) -> Branches:
    """The branches of a fingerprint."""
    root_hex, rest = print_.split(".")
    data, level = base64.b64decode(rest[2:]), int(rest[:2], 16)
    width = np.dtype(_length_type(level))
    n = len(data) // (5 + width.itemsize)
    lengths = np.frombuffer(data[4 * n : -n or None], dtype=width).astype(np.int64)
    return Branches(root_hex, level, np.frombuffer(data[: 4 * n], dtype="<u4"), lengths, np.frombuffer(data[len(data) - n :], dtype="u1").astype(np.int64))


def _composed(b: Branches) -> tuple[np.ndarray, np.ndarray]:
    """(places, digests of the text up to them), the start included."""
    places = np.concatenate([[0], np.cumsum(b.lengths)])
    shift = _power(_BASE, _POWERS, places[:-1]).astype(np.uint32)
    return places, np.concatenate([np.zeros(1, np.uint32), np.cumsum(b.digests * shift, dtype=np.uint32)])


def _between(places: np.ndarray, sums: np.ndarray, first: np.ndarray, last: np.ndarray | int) -> np.ndarray:
    """Digests of the stretches between places of these numbers."""
    return (sums[last] - sums[first]) * _power(_INVERSE, _INVERSES, places[first]).astype(np.uint32)


def _ends(a: Branches, b: Branches) -> tuple[int, int]:
    """Characters of the longest head and of the longest tail beside it whose digests agree."""
    (pa_, sa), (pb, sb) = _composed(a), _composed(b)
    _, i, j = np.intersect1d(pa_, pb, assume_unique=True, return_indices=True)
    heads = pa_[i][sa[i] == sb[j]]
    head = int(heads[-1])
    _, i, j = np.intersect1d(pa_[-1] - pa_, pb[-1] - pb, assume_unique=True, return_indices=True)
    same = _between(pa_, sa, i, -1) == _between(pb, sb, j, -1)
    tails = (pa_[-1] - pa_[i])[same]
    tails = tails[tails <= min(pa_[-1], pb[-1]) - head]
    return head, int(tails.max(initial=0))


def changed(a: str, b: str) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The ranges of characters (start, end) of either text outside which both agree; None for equal roots."""
    x, y = parsed(a), parsed(b)
    if x.root == y.root:
        return None
    head, tail = _ends(x, y)
    return (head, int(x.lengths.sum()) - tail), (head, int(y.lengths.sum()) - tail)


def _wider(b: Branches, level: int, low: int, high: int) -> Counter:
    """(digest, length) of the branches of this level between two places."""
    places, sums = _composed(b)
    strengths = np.concatenate([[255], b.strengths])
    strengths[-1] = 255
    inside = np.flatnonzero((places >= low) & (places <= high))
    kept = inside[(strengths[inside] >= level) | (places[inside] == low) | (places[inside] == high)].tolist()
    widest, cuts = 4 << level, kept[:1]
    for k in kept[1:]:
        while places[k] - places[cuts[-1]] > widest:
            after = int(np.searchsorted(places, places[cuts[-1]] + widest))
            if after >= k:
                break
            cuts.append(after)
        cuts.append(k)
    first, last = np.array(cuts[:-1], dtype=np.int64), np.array(cuts[1:], dtype=np.int64)
    return Counter(zip(_between(places, sums, first, last).tolist(), (places[last] - places[first]).tolist(), strict=True))


def likeness(a: str, b: str) -> float:
    """The share (0 to 1) of characters in branches that two texts have in common, from their fingerprints; 1 exactly if the roots agree."""
    return alike(parsed(a), parsed(b))


def alike(x: Branches, y: Branches) -> float:
    """``likeness`` of parsed fingerprints."""
    if x.root == y.root:
        return 1.0
    n, m = int(x.lengths.sum()), int(y.lengths.sum())
    head, tail = _ends(x, y)
    shared, level = head + tail, max(x.level, y.level, MOVED_LEVEL)
    if min(n, m) > shared:
        moved = _wider(x, level, head, n - tail) & _wider(y, level, head, m - tail)
        shared += sum(length * k for (_, length), k in moved.items() if length >= 1 << MOVED_LEVEL)
    return min(2 * shared / (n + m), 1 - 1e-9)


def half_replaced(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _part(key: Column, bounds: list[tuple]) -> Column:
    """The number of bounds <= key (structs of three longs), found in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    bound = lambda b: F.struct(*(F.lit(v).cast("bigint").alias(n) for v, n in zip(b, ("key", "hash", "row"), strict=True)))
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    outer = below(F.array(*(bound(r[0]) for r in runs)))
    inner = F.element_at(F.array(*(F.array(*(bound(v) for v in r)) for r in runs)), F.greatest(outer, F.lit(1)))
    return F.when(outer == 0, 0).otherwise((outer - 1) * width + below(inner))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows part, turn, at, guest, doc_id, text sorted so that the row after another of the same part is its next.

    Rows are ordered by ``at``: id, hash of the text, row number. Parts are ranges of that order of about part_bytes,
    found from a sample, so that rows of one id, or equal rows, are many parts if they are many. The first row of a
    part stands once more, as a guest, at the end of the part before (of the first part: of the last): texts are
    shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    at = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("hash"), F.col("__row").alias("row"))
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(shuffle_partitions(docs.sparkSession), -(-(size or 0) // part_bytes))
    step = max(1, count // (parts * OVERSAMPLE))
    sample = sorted(tuple(r.at) for r in rows.where(F.pmod(F.xxhash64("__row"), F.lit(step)) == 0).select(at.alias("at")).collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    part = _part(F.col("at"), bounds).cast("int")
    placed = rows.select(at.alias("at"), "doc_id", "text").withColumn("part", part)
    firsts = sorted((r.part, tuple(r.first)) for r in placed.groupBy("part").agg(F.min("at").alias("first")).collect())
    guests = [(first, firsts[i - 1][0], int(i == 0)) for i, (_, first) in enumerate(firsts)]
    known = docs.sparkSession.createDataFrame(guests, "first struct<key: bigint, hash: bigint, row: bigint>, guest_part int, guest_turn int")
    own = F.struct(F.col("part"), F.lit(0).alias("turn"), F.lit(False).alias("guest"))
    other = F.struct(F.col("guest_part").alias("part"), F.col("guest_turn").alias("turn"), F.lit(True).alias("guest"))
    places = F.when(F.col("guest_part").isNull(), F.array(own)).otherwise(F.array(own, other))
    met = placed.join(F.broadcast(known), F.col("at") == F.col("first"), "left")
    dealt = met.select(F.explode(places).alias("p"), "at", "doc_id", "text").select("p.part", "p.turn", "at", "p.guest", "doc_id", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "turn", "at", "guest")


def fingerprints(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a row is ``half_replaced`` by the next row's in ascending order of ids.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, guest, doc_id, text, branches) of the row before

        def ended() -> None:
            if held and not held[1]:
                raise ValueError("the rows of the input came in other partitions when read again")

        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out = []
            parts, guests, ids, texts = (batch.column(i).to_pylist() for i in (0, 3, 4, 5))
            for now in zip(parts, guests, ids, texts, strict=True):
                now = (*now, branches(now[3]))
                if held and held[0] == now[0]:
                    edited = half_replaced(held[3], now[3])
                    other = branches(edited)
                    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[2], len(held[3]), digest, printed(held[4]), printed(other), alike(held[4], other), alike(held[4], now[4])))
                else:
                    ended()
                held = now
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        ended()

    return with_next(docs, **options).select("part", "turn", F.lit(0), "guest", "doc_id", "text").mapInArrow(run, SCHEMA)


def nodes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The trees as rows: doc_id, level (0 paragraph, 1 section, 2 root), position, parent, digest (hex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sections, k = tree(body), 0
                for s, (paragraphs, digest) in enumerate(zip(sections, section_digests(sections), strict=True)):
                    out += [(doc, 0, k + i, s, p.hex()) for i, p in enumerate(paragraphs)]
                    out.append((doc, 1, s, 0, digest.hex()))
                    k += len(paragraphs)
                out.append((doc, 2, 0, None, root(sections).hex()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "level", "position", "parent", "digest"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, level int, position int, parent int, digest string")

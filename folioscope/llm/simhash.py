"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's word shingles
(repeats included). Two fingerprints link at ``distance`` or fewer differing bits, and a document's component is
the set reachable over links.

Pigeonring: cut the ring of 64 bits into ``segments`` segments. If two fingerprints differ in at most d bits, some
start segment exists from which every chain of l consecutive segments has at most floor(l * d / segments)
differing bits. The longest chain with budget zero must be equal, so it is the join key (one key per start); the
longer chains prune a candidate before the full Hamming check.

Exact copies collapse into one fingerprint first. A key that more than BUCKET different fingerprints share is not
paired: there each fingerprint is put with all points at half the distance, and two fingerprints link exactly if
they share such a point (even distances) - linear in the fingerprints, and no link is lost.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle give
one shingle of all words; rows without an id (null) keep a fingerprint and take the component of their
fingerprint; repeated ids give one row each; an empty table gives an empty result; further columns are ignored
by ``components`` and kept by ``one_per_component``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioscope.llm.common import SLICE, checkpointed, shuffle_partitions, with_column
from folioscope.operators.graph import connected

SEED = 42
SEGMENTS = 16
BUCKET = 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLICE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: For sets of shingles: members of a chunk of a crowded key, documents of the sample that tells common shingles, how many of these are kept.
CHUNK, SAMPLE, COMMON = 256, 10_000, 1 << 17
#: Segments of 64 bits of the fingerprint that the members of a key are compared by.
RING = 8
#: Sets of rows are broadcast up to this number, else joined by shuffle.
BROADCAST = 1_000_000
_MEMBER = ["key", "node", "size", "place", "n"]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _SLICE):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at : at + _SLICE]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _turned(x: Column, bits: int) -> Column:
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _budgets(distance: int, segments: int) -> list[int]:
    return [(length * distance) // segments for length in range(1, segments + 1)]


def _chain_holds(x: Column, distance: int, segments: int) -> Column:
    """x: the differing bits, turned so that the chain starts at the top. Checks the last length of each budget."""
    width, budgets, held = 64 // segments, _budgets(distance, segments), None
    for length in range(1, segments + 1):
        if length < segments and budgets[length] == budgets[length - 1]:
            continue
        top = x if length == segments else F.shiftrightunsigned(x, 64 - width * length)
        test = F.bit_count(top) <= budgets[length - 1]
        held = test if held is None else held & test
    return held


def links(fps: DataFrame, *, distance: int = 2, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints of column fp whose components are those of all links.

    Inside a bucket of few fingerprints every link is an edge; for larger buckets the edges join each fingerprint
    to the smallest one around a shared half-way point, which keeps reachability (``distance`` must be even there).
    """
    if distance % 2 or 64 % segments:
        raise ValueError("distance must be even and segments divide 64")
    width = 64 // segments
    free = sum(b == 0 for b in _budgets(distance, segments))
    if not free:
        raise ValueError("too few segments for this distance")
    drop = 64 - width * free
    keys = F.array(*(F.struct(F.lit(i).alias("start"), F.shiftrightunsigned(_turned(F.col("fp"), width * i), drop).alias("key")) for i in range(segments)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.key")
    shared = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1")
    met = keyed.join(shared, ["start", "key"])
    groups = met.where(F.col("n") <= bucket).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    turned = F.element_at(F.array(*(F.lit(width * i) for i in range(segments))), F.col("start") + 1)

    def paired(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        chain = F.call_function("shiftleft", x, turned).bitwiseOR(F.call_function("shiftrightunsigned", x, (F.lit(64) - turned) % 64))
        return (a < b) & _chain_holds(chain, distance, segments) & (_hamming(a, b) <= distance)

    near = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: paired(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    few = groups.select(F.explode(near).alias("e")).select("e.a", "e.b")
    crowded = met.where(F.col("n") > bucket).select("fp").distinct()
    return few.unionByName(_around_points(crowded, distance)).distinct()


def _within_one_bit(point: Column) -> Column:
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(v - (1 << 64) if v >> 63 else v).cast("bigint") for v in (1 << i for i in range(64))))
    return F.transform(flips, lambda flip: point.bitwiseXOR(flip))


def _around_points(fps: DataFrame, distance: int) -> DataFrame:
    """Joins fingerprints over the points within distance / 2 bits of them; a point has at most 65 for distance 2."""
    points = F.array(F.col("fp"))
    for _ in range(distance // 2):
        points = F.array_distinct(F.flatten(F.transform(points, _within_one_bit)))
    around = fps.select("fp", F.explode(points).alias("point"))
    groups = around.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """id, fp and component_id (the smallest id reachable) of every row."""
    fps = checkpointed(fingerprints(docs, id_col=id_col, text=text, words=words))
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = connected(links(classes.select("fp"), distance=distance, segments=segments, bucket=bucket))
    near = classes.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = near.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = checkpointed(near.join(named, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; texts of at most ``words`` words are one shingle of all words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], dtype=np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], dtype=np.uint64)
    mixed = np.zeros(len(tokens) - words + 1, dtype=np.uint64)
    for k in range(words):
        mixed = (mixed + hashes[k : k + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _marks(words: int):
    """16 bytes of digest and a fingerprint of the set of every text: a power of two of bits, at least twice the shingles.

    A bit is the parity of the shingles that hash to it, so fingerprints differ in at most as many bits as sets in shingles.
    """

    def mark(text: str | None) -> bytes:
        hashes = shingle_hashes(text, words)
        size = 1 << max((64 * RING - 1).bit_length(), (2 * len(hashes) - 1).bit_length())
        bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        return xxhash.xxh3_128_digest(hashes.tobytes(), SEED) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()

    return lambda texts: [mark(t) for t in texts]


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of ``size`` segments: that of the lower bits of the hashes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _ring(marks: DataFrame) -> DataFrame:
    """node and ring: its fingerprint folded to RING segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [_folded(np.frombuffer(m, dtype="<u8", offset=16), RING).tobytes() for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rings, pa.binary())], names=["node", "ring"])

    return marks.select("node", "mark").mapInArrow(run, "node bigint, ring binary")


def _room(size, other, similarity: float):
    """How many shingles two sets of these sizes may differ in."""
    return size + other - 2 * np.ceil((size + other) * (similarity / (1 + similarity)) - 1e-6)


def _possible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole fingerprints allow the similarity; none that has it is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            kept = []
            for a, b, n, m, x, y in zip(*part, strict=True):
                one, two = np.frombuffer(x, dtype="<u8", offset=16), np.frombuffer(y, dtype="<u8", offset=16)
                size = min(len(one), len(two))
                if np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum() <= _room(n, m, similarity):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    asked = _small(checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    marks = marks.join(asked, "node", "left_semi")
    first = marks.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("mark").alias("x"))
    second = marks.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("mark").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast up to BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield tuple(c.to_pylist() for c in batch.slice(start, SLICE).columns)


def _common(texts: DataFrame, words: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met repeatedly in a sample of ``texts``, sorted, and how often. It only orders shingles: what it misses costs time, not links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,) in _sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(t, words) for t in part]).view(np.int64))], names=["key"])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, count // SAMPLE))) == 0).select("text")
    met = sample.mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = met.orderBy(F.desc("n"), "key").limit(COMMON).collect()
    hashes, counts = np.array([r["key"] for r in found], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in found], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefixes(words: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """The first shingles of a text, rare ones first: two texts of this similarity share one among those of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in _sliced(batches):
            keys, sizes = [], []
            for text in texts:
                own = shingle_hashes(text, words)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]
                sizes.append(len(own))
                keys.append(own[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1])
            lengths = [len(k) for k in keys]
            places = np.concatenate([np.arange(n) for n in lengths])
            columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), lengths), np.repeat(sizes, lengths), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "size", "place"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups (rows in order of the first ``names`` columns) and the place after each row's group."""

    def ended(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:names]])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])
        return columns, np.repeat(starts[1:], np.diff(starts))

    rest: list[list[np.ndarray]] = []  # the last group may go on in the next batch
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in columns[:names]]))[0])
        if rest and not cut and all(c[0] == r[0] for c, r in zip(columns[:names], rest[-1], strict=False)):
            rest.append(columns)
            continue
        if rest or cut:
            yield ended([*rest, [c[:cut] for c in columns]])
        rest = [[c[cut:] for c in columns]]
    if rest:
        yield ended(rest)


def _shared(similarity: float):
    """Rows of keys with several members, with their number; rows of small groups only with a member of possible sizes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, size, place), end in _whole_groups(batches, 1):
            number = end - np.searchsorted(end, end)
            own = number > CHUNK
            at, step = np.flatnonzero((number > 1) & ~own), 0
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                good = at[_may_reach(similarity, size[at], place[at], size[at + step], place[at + step])]
                own[good] = own[good + step] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (key, node, size, place, number)], names=_MEMBER)

    return run


def _may_reach(similarity: float, size, place, other_size, other_place):
    """Whether texts of these sizes that share the shingles at these places of their orders can be alike enough."""
    overlap = np.minimum(place, other_place) + 1 + np.minimum(size - place, other_size - other_place) - 1
    return overlap >= np.ceil((size + other_size) * (similarity / (1 + similarity)) - 1e-6)


def _spanning(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a forest that joins what all edges join; edges by number of their first node, then step."""
    first = int(min(one.min(initial=0), two.min(initial=0)))
    root = list(range(int(max(one.max(initial=0), two.max(initial=0))) - first + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip((one - first).tolist(), (two - first).tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _met(similarity: float):
    """Pairs (a < b) of different roots inside every block of a key that can be alike enough.

    Sizes and places come first, then the fingerprints: cumulative differences around the ring of segments may not pass
    the budget in proportion to the two sizes. A pair that passes it on the whole ring has a start from which every
    chain keeps to its share, so the whole ring is tested at once. Of blocks that are marked ``forest`` only a spanning forest of these pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, low, high, own, node, root, size, place, forest, *ring), end in _whole_groups(batches, 3):
            at, step, ones, twos = np.arange(len(node)), 0, [], []
            while True:
                step += 1
                at = at[at + step < end[at]]
                if not len(at):
                    break
                to = at + step
                good = (root[at] != root[to]) & ((low[at] == high[at]) | (own[at] != own[to]))
                good &= _may_reach(similarity, size[at], place[at], size[to], place[to])
                x, y = at[good], to[good]
                apart = sum(np.bitwise_count((r[x] ^ r[y]).view(np.uint64)).astype(np.int64) for r in ring)
                near = apart <= _room(size[x], size[y], similarity)
                ones.append(x[near])
                twos.append(y[near])
            if not ones:
                continue
            one, two = np.concatenate(ones), np.concatenate(twos)
            if forest.any():
                order = np.argsort(one, kind="stable")
                one, two = one[order], two[order]
                crowded = forest[one] > 0
                kept = np.concatenate([np.flatnonzero(~crowded), np.flatnonzero(crowded)[_spanning(one[crowded], two[crowded])]])
                one, two = one[kept], two[kept]
            pairs = np.unique(np.stack([np.minimum(node[one], node[two]), np.maximum(node[one], node[two])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def _pairs(blocks: DataFrame, rings: DataFrame, parts: int, similarity: float) -> DataFrame:
    """Pairs of rows key, low, high, own, node, root, size, place, forest that can be alike enough."""
    words = [F.conv(F.hex(F.substring("ring", 8 * k + 1, 8)), 16, -10).cast("bigint").alias(f"ring{k}") for k in range(RING)]
    names = ["key", "low", "high", "own", "node", "root", "size", "place", "forest"]
    met = blocks.join(rings, "node").select(*(F.col(n).cast("bigint") for n in names), *words)
    dealt = met.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return dealt.mapInArrow(_met(similarity), "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for part in _sliced([batch]):
                last, one = None, np.zeros(0, dtype=np.uint64)
                for a, b, x, y in zip(*part, strict=True):
                    if a != last:
                        last, one = a, shingle_hashes(x, words)
                    two = shingle_hashes(y, words)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                        kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    asked = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = texts.join(_small(asked), "node", "left_semi")
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _similar_rows(docs: DataFrame, id_col: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with __row and __digest, and __digest, component_id and chosen (a row) of every class of rows with an id."""
    spark = docs.sparkSession
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = checkpointed(with_column(numbered, text, "__mark", BinaryType(), _marks(words)).withColumn("__digest", F.substring("__mark", 1, 16)))
    least = F.min(F.struct(F.col(id_col).cast("bigint").alias("id"), F.col("__row").alias("node")))
    classes = checkpointed(rows.where(F.col(id_col).isNotNull()).groupBy("__digest").agg(least.alias("x")).select("__digest", "x.id", "x.node"))
    again = checkpointed(rows.select(F.col("__row").alias("node")).join(classes.select("node"), "node", "left_anti").select("node"))
    single = rows.select(F.col("__row").alias("node"), F.col(text).alias("text"), F.col("__mark").alias("mark")).join(_small(again), "node", "left_anti")
    texts = single.select("node", "text")
    common, counts = _common(texts, words, classes.count())
    keyed = texts.select("node", "text").mapInArrow(_prefixes(words, similarity, common, counts), "key bigint, node bigint, size bigint, place bigint")
    parts = shuffle_partitions(spark)
    shared = checkpointed(keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_shared(similarity), ", ".join(f"{c} bigint" for c in _MEMBER)))
    sized = checkpointed(shared.groupBy("node").agg(F.first("size").alias("size")))
    marks = single.select("node", "mark").join(_small(sized), "node")
    rings = checkpointed(_ring(marks))

    # Every key: all pairs of small groups, and of crowded ones a forest of the pairs inside each chunk
    c = F.col
    chunks = F.ceil(c("n") / CHUNK)
    own = F.pmod(F.xxhash64("node"), c("chunks"))
    held = shared.withColumn("chunks", chunks).withColumn("own", own)
    inside = held.select("key", c("own").alias("low"), c("own").alias("high"), "own", "node", c("node").alias("root"), "size", "place", (c("chunks") > 1).alias("forest"))
    tried = checkpointed(_pairs(inside, rings, parts, similarity))
    found = checkpointed(_verified(checkpointed(_possible(tried, marks, similarity)), texts, words, similarity))

    # Crowded keys that still hold several components: all pairs of different components, by blocks of two chunks
    crowded = held.where("chunks > 1").join(connected(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = crowded.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    dealt = crowded.join(several, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), c("chunks") - 1)))
    blocks = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "size", "place", F.lit(False).alias("forest"))
    pairs = checkpointed(_pairs(blocks, rings, parts, similarity).join(tried, ["a", "b"], "left_anti"))
    edges = found.unionByName(checkpointed(_verified(checkpointed(_possible(pairs, marks, similarity)), texts, words, similarity)))

    named = classes.join(connected(edges), "node", "left").select("__digest", F.coalesce("root", "node").alias("root"), F.struct("id", "node").alias("x"))
    chosen = named.groupBy("root").agg(F.min("x").alias("x"))
    return rows, checkpointed(named.select("__digest", "root").join(chosen, "root").select("__digest", c("x.id").alias("component_id"), c("x.node").alias("chosen")))


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id and component_id of rows; texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more are linked.

    Exact but for equal 64-bit hashes of different shingles. Of two such sets, each in one order of all shingles (rare
    ones first), the first n - ceil(similarity * n) + 1 shingles share one; these are the join keys, as chains of a
    fingerprint give none at this distance. Members of a key are compared in place by sizes, places and fingerprints whose
    bits differ at most as much as the sets; pairs that these allow are held against the texts. No key is cut: a
    crowded one is compared by chunks of CHUNK members first, of which a forest of pairs is tested, then, where several components are left,
    by all blocks of two chunks. Equal sets collapse first. Rows without an id are left out.
    """
    rows, classes = _similar_rows(docs, id_col, text, words, similarity)
    held = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), "__digest")
    return held.join(classes, "__digest").select("id", "component_id")


def one_per_similar(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every component of ``similar_components``: of the smallest id and, where that is repeated, one of its rows.

    Rows are told apart by themselves, not by their id: texts under a repeated id stay or leave each for itself, and of
    equal rows one stays. Rows without an id have no component and stay.
    """
    rows, classes = _similar_rows(docs, id_col, text, words, similarity)
    found = rows.where(F.col(id_col).isNotNull()).select(F.col("__row").alias("__gone"), "__digest").join(classes, "__digest")
    gone = found.where(F.col("__gone") != F.col("chosen")).select("__gone")
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*docs.columns)


def _chains(fp: Column, distance: int, segments: int) -> Column:
    """The join keys of a fingerprint: each start with its longest chain of budget zero, in one long."""
    width, free = 64 // segments, sum(b == 0 for b in _budgets(distance, segments))
    if 64 % segments or not free or segments.bit_length() + width * free > 62:
        raise ValueError("segments must divide 64, and their keys have a place beside the start")
    turned = lambda i: F.shiftrightunsigned(_turned(fp, width * i), 64 - width * free)
    return F.array(*(F.shiftleft(F.lit(i).cast("bigint"), width * free).bitwiseOR(turned(i)) for i in range(segments)))


def _ring_holds(key: np.ndarray, one: np.ndarray, two: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Whether the chains that begin at the start of the key keep to their budgets, the whole ring (full Hamming) last."""
    width, budgets = 64 // segments, _budgets(distance, segments)
    apart = (one ^ two).view(np.uint64)
    turn = (key >> (width * sum(b == 0 for b in budgets))).astype(np.uint64) * np.uint64(width)
    ring = (apart << turn) | (apart >> ((np.uint64(64) - turn) % np.uint64(64)))
    held = np.ones(len(ring), dtype=bool)
    for length in range(1, segments + 1):
        if length == segments or budgets[length] != budgets[length - 1]:
            held &= np.bitwise_count(ring >> np.uint64(64 - width * length)) <= budgets[length - 1]
    return held


def _shared_chains(distance: int, segments: int):
    """Rows of keys with several members, with their number; rows of small groups only with a member that they link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, fp), end in _whole_groups(batches, 1):
            number = end - np.searchsorted(end, end)
            own = number > CHUNK
            at, step = np.flatnonzero((number > 1) & ~own), 0
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                good = at[_ring_holds(key[at], fp[at], fp[at + step], distance, segments)]
                own[good] = own[good + step] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (key, node, fp, number)], names=["key", "node", "fp", "n"])

    return run


def _met_chains(distance: int, segments: int):
    """Linked pairs (a < b) of different roots inside every block of a key; of blocks marked ``forest`` a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, low, high, own, node, root, fp, forest), end in _whole_groups(batches, 3):
            at, step, ones, twos = np.arange(len(node)), 0, [], []
            while True:
                step += 1
                at = at[at + step < end[at]]
                if not len(at):
                    break
                to = at + step
                good = (root[at] != root[to]) & ((low[at] == high[at]) | (own[at] != own[to]))
                x, y = at[good], to[good]
                near = _ring_holds(key[x], fp[x], fp[y], distance, segments)
                ones.append(x[near])
                twos.append(y[near])
            if not ones:
                continue
            one, two = np.concatenate(ones), np.concatenate(twos)
            if forest.any():
                order = np.argsort(one, kind="stable")
                kept = order[_spanning(one[order], two[order])]
                one, two = one[kept], two[kept]
            pairs = np.unique(np.stack([np.minimum(node[one], node[two]), np.maximum(node[one], node[two])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def one_per_linked(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, segments: int = SEGMENTS, checked_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every group of near copies: of the smallest id and, where that is repeated, one of its rows.

    Two texts link if their fingerprints differ in at most ``distance`` bits and their sets of shingles of ``checked_words``
    words have a Jaccard similarity of ``similarity`` or more; equal sets collapse first. Pigeonring: chains with budget zero
    are the join keys, longer chains prune, full Hamming follows, then the texts. No key is cut: in every chunk of CHUNK members of a
    key a forest of the linked pairs is held against the texts first, then, where a key still has several components, all
    pairs between these, by blocks of two chunks. Rows leave by row, not by id; rows without an id stay.
    """
    spark, c = docs.sparkSession, F.col
    digest = lambda t: xxhash.xxh3_128_digest(shingle_hashes(t, checked_words).tobytes(), SEED)
    both = lambda texts: [fingerprint(t, words).to_bytes(8, "big") + digest(t) for t in texts]
    marked = with_column(docs.withColumn("__row", F.monotonically_increasing_id()), text, "__both", BinaryType(), both)
    rows = checkpointed(marked.withColumn("__digest", F.substring("__both", 9, 16)))
    least = F.min(F.struct(c(id_col).cast("bigint").alias("id"), c("__row").alias("node")))
    classes = checkpointed(rows.where(c(id_col).isNotNull()).groupBy("__digest").agg(least.alias("x")).select("__digest", "x.id", "x.node"))
    again = checkpointed(rows.select(c("__row").alias("node")).join(classes.select("node"), "node", "left_anti").select("node"))
    single = rows.select(c("__row").alias("node"), c(text).alias("text"), "__both").join(_small(again), "node", "left_anti")
    texts, parts = single.select("node", "text"), shuffle_partitions(spark)
    fp = F.conv(F.hex(F.substring("__both", 1, 8)), 16, -10).cast("bigint")
    keyed = single.select("node", fp.alias("fp")).select(F.explode(_chains(c("fp"), distance, segments)).alias("key"), "node", "fp")
    shared = checkpointed(keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_shared_chains(distance, segments), "key bigint, node bigint, fp bigint, n bigint"))
    held = shared.withColumn("chunks", F.ceil(c("n") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("node"), c("chunks")))

    def pairs(blocks: DataFrame, forest: bool) -> DataFrame:
        names = ["key", "low", "high", "own", "node", "root", "fp"]
        dealt = blocks.select(*(c(n).cast("bigint") for n in names), F.lit(int(forest)).alias("forest")).repartition(parts, "key", "low", "high")
        return dealt.sortWithinPartitions("key", "low", "high", "node").mapInArrow(_met_chains(distance, segments), "a bigint, b bigint").distinct()

    def verified(found: DataFrame) -> DataFrame:
        return checkpointed(_verified(found, texts, checked_words, similarity))

    inside = held.withColumn("low", c("own")).withColumn("high", c("own")).withColumn("root", c("node"))
    tried = checkpointed(pairs(inside, True))
    found = verified(tried)
    rooted = held.join(connected(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    dealt = rooted.join(several, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), c("chunks") - 1)))
    blocks = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    edges = found.unionByName(verified(checkpointed(pairs(blocks, False).join(tried, ["a", "b"], "left_anti"))))

    named = classes.join(connected(edges), "node", "left").select("__digest", F.coalesce("root", "node").alias("root"), F.struct("id", "node").alias("x"))
    chosen = named.groupBy("root").agg(F.min("x").alias("x"))
    stays = checkpointed(named.join(chosen.withColumnRenamed("x", "y"), "root").select("__digest", c("y.node").alias("chosen")))
    gone = rows.where(c(id_col).isNotNull()).select(c("__row").alias("__gone"), "__digest").join(stays, "__digest").where(c("__gone") != c("chosen")).select("__gone")
    return rows.join(gone, c("__row") == c("__gone"), "left_anti").select(*docs.columns)


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    found = components(docs, id_col=id_col, **options)
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

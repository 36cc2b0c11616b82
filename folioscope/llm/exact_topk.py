"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are laid out vertically (one row per dimension). Each query takes the dimensions in descending order of its
own components, so most of its mass comes first, and the products are added up dimension block by dimension block.
What the remaining dimensions can still add is at most the product of the query's remaining norm and the vector's
norm (Cauchy-Schwarz), so after every block the candidates whose upper bound is below the k-th best known score are
dropped and the survivors compacted. The k-th best score is known early: the most promising candidates after two
blocks are scored whole, and it goes on from one block of vectors to the next.

The stated query set meets all rows in blocks. Up to QUERIES queries are broadcast (a bounded table) and the vectors
are read where they lie; beyond, queries and vectors are dealt to blocks, each pair of blocks being one group of
bounded size. Both ways search alike and give the same rows.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor rows without an
id; empty vectors score 0; a shorter vector counts as padded with zeros; ties go to the smaller id; every query row
is answered, and only that row itself is no candidate: of rows that repeat an id each is a query and a candidate of the
others; an empty table gives an empty result; further columns are ignored. Scores must fit a long. The rows of a
DataFrame must come in the same partitions whenever it is read (as from files or a checkpoint).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import shuffle_partitions

QUERIES, QUERY_BLOCK, VECTOR_BLOCK, DIM_BLOCK = 1 << 14, 2048, 1 << 14, 8
_SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """row (its number), id and v = floor(scale * component) (array<bigint>) of the rows that take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.col(vector).isNotNull() & whole & F.col(id_col).isNotNull()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector).alias("v"), F.coalesce(fits, F.lit(False)).alias("fits"))
    return rows.where("fits").select("row", F.col("id").cast("bigint").alias("id"), F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """The vectors as columns: dims x rows, padded with zeros."""
    lists = table.column("v").combine_chunks()
    flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    if len(ends) > 1 and (np.diff(ends) == dims).all():
        return np.ascontiguousarray(flat.reshape(-1, dims).T)
    out = np.zeros((dims, table.num_rows), dtype=np.int64)
    for i in range(table.num_rows):
        row = flat[ends[i] - ends[0] : ends[i + 1] - ends[0]]
        out[: len(row), i] = row
    return out


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def best_of_block(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, skip: int, ids: np.ndarray, k: int, bar: float = -np.inf, block: int = DIM_BLOCK, survivors: list | None = None) -> np.ndarray:
    """Columns of ``vectors`` with the k best products and these products, best first, ties to the smaller id.

    norms: of every vector; skip: a column that may not answer (or -1); bar: scores below it are not asked for;
    survivors: takes the number of candidates after every block.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.sqrt(np.append(np.cumsum((query[order].astype(float) ** 2)[::-1])[::-1], 0.0))
    alive, sums = None, np.zeros(vectors.shape[1], dtype=vectors.dtype)
    for at in range(0, len(query), block):
        for d in order[at : at + block]:
            if query[d]:
                sums += query[d] * (vectors[d] if alive is None else vectors[d][alive])
        if at == block and len(sums) > 4 * k:
            likely = np.argpartition(sums, len(sums) - 4 * k)[len(sums) - 4 * k :]
            likely = likely if alive is None else alive[likely]
            bar = max(bar, _kth(query @ vectors[:, likely[likely != skip]], k))
        if len(sums) > k and at + block < len(query):
            room = rest[min(at + block, len(query))] * (norms if alive is None else norms[alive]) * (1 + 1e-9) + 1e-3
            keep = np.flatnonzero(sums + room >= bar)
            if len(keep) < len(sums):
                alive, sums = keep if alive is None else alive[keep], sums[keep]
        if survivors is not None:
            survivors.append(len(sums))
    alive = np.arange(len(sums)) if alive is None else alive
    own = (alive != skip) & (sums >= bar)
    alive, sums = alive[own], sums[own]
    if len(sums) > k:
        own = sums >= _kth(sums, k)
        alive, sums = alive[own], sums[own]
    order = np.lexsort((ids[alive], -sums))[:k]
    return np.stack([alive[order], sums[order].astype(np.int64)])


class _Searcher:
    """The k best of every query over the blocks of vectors seen so far."""

    def __init__(self, queries: pa.Table, k: int) -> None:
        self.k, self.rows, self.ids = k, queries.column("row").to_numpy(), queries.column("id").to_numpy()
        self.dims = int(np.diff(np.asarray(queries.column("v").combine_chunks().offsets)).max(initial=0))
        self.queries = np.ascontiguousarray(_matrix(queries, self.dims).T)
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.rows]  # (-score, id), best first

    def see(self, vectors: pa.Table) -> None:
        if not vectors.num_rows or not len(self.rows):
            return
        dims = max(self.dims, int(np.diff(np.asarray(vectors.column("v").combine_chunks().offsets)).max(initial=0)))
        x, q = _matrix(vectors, dims), self.queries if dims == self.dims else np.pad(self.queries, ((0, 0), (0, dims - self.dims)))
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dims, 1)
        if most < 2**52:  # sums of such products are exact in doubles
            q, x = q.astype(np.float64), x.astype(np.float64)
        norms, ids, places = np.sqrt((x.astype(float) ** 2).sum(axis=0)), vectors.column("id").to_numpy(), vectors.column("row").to_numpy()
        order = np.argsort(places)
        own = order[np.minimum(np.searchsorted(places[order], self.rows), len(places) - 1)]
        own = np.where(places[own] == self.rows, own, -1)
        for i, best in enumerate(self.found):
            bar = -best[-1][0] if len(best) == self.k else -np.inf
            cols, scores = best_of_block(q[i], x, norms, int(own[i]), ids, self.k, bar)
            if len(cols):
                best += zip((-scores).tolist(), ids[cols].tolist(), strict=True)
                best.sort()
                del best[self.k :]

    def answers(self) -> pa.Table:
        flat = [(row, query, vec, -score) for row, query, best in zip(self.rows.tolist(), self.ids.tolist(), self.found, strict=True) for score, vec in best]
        columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
        return pa.table({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(_SCHEMA.split(", "), columns, strict=True)})


def _in_place(queries: pa.Table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, held, size = _Searcher(queries, k), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= VECTOR_BLOCK:
                searcher.see(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            searcher.see(pa.Table.from_batches(held))
        yield from searcher.answers().to_batches()

    return run


def _of_blocks(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        searcher = _Searcher(queries, k)
        searcher.see(vectors)
        return searcher.answers()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each row of ``vectors`` with ``is_query``.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = quantised(vectors, **options)
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    if asked <= QUERIES:
        queries = rows.where(is_query).toArrow()
        found = rows.mapInArrow(_in_place(queries, k), _SCHEMA)
    else:
        query_blocks = -(-asked // QUERY_BLOCK)
        vector_blocks = max(1, -(-total // VECTOR_BLOCK), shuffle_partitions(vectors.sparkSession) // query_blocks)

        def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
            mine = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
            return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

        queries = dealt(rows.where(is_query), "q", query_blocks, "c", vector_blocks)
        found = queries.groupBy("q", "c").cogroup(dealt(rows, "c", vector_blocks, "q", query_blocks).groupBy("q", "c")).applyInArrow(_of_blocks(k), _SCHEMA)
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("vec_id")).alias("last"))), asc=False), 1, k)
    merged = found.groupBy("query_row", "query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), (-F.col("b.last")).alias("vec_id"), F.col("b.score").alias("score")
    )

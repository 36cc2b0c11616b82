"""BPE encoding and decoding over a distinct-word table.

Words are runs of non-white-space: the tokenizer here (NFC, white space to one space, lower case, a split pattern
that never crosses white space) treats each word alone. Texts are grouped into blocks; a block asks for each of
its different words once. The words of all blocks meet by their hash, where each distinct word is encoded once, and
the answers go back to the blocks, where ids are put together by position and pieces found by id. Only distinct words of blocks and texts move, both compressed, as a row for every word of a block would
take three times the room; no table of words is broadcast, so a very frequent word costs one entry per block.

Defined cases: a null text counts as empty; an empty or blank text has no ids and decodes to the empty string;
repeated rows and null ids give one row each; an empty table gives an empty result; further columns are ignored.
The rows of a DataFrame must come in the same partitions whenever it is read (as from files or a checkpoint);
a block whose answers do not fit raises an error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import shuffle_partitions

BLOCK_CHARS = 12_000_000
#: The words of about so many characters of text meet in one task, so its table stays bounded as the input grows.
ROUTE_CHARS = 32_000_000
#: A vocabulary of more entries is not broadcast but joined by shuffle.
PIECES = 1 << 20
#: White space as regular expressions of the tokenizer see it (fixed values, Unicode White_Space).
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters at which str.split() cuts, though they belong to words here.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str]:
    """Runs of characters that are not white space."""
    return [w for w in _WHITE.split(text) if w] if _SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary as rows: id, piece, special tokens included."""
    spec = json.loads(open(path, encoding="utf-8").read())
    by_id = {i: piece for piece, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    if spec.get("decoder") is not None:
        raise ValueError("this decoder joins pieces by one space; the tokenizer has a decoder of its own")
    table = spark.createDataFrame(sorted(by_id.items()), "id int, piece string")
    return F.broadcast(table) if len(by_id) <= PIECES else table


def spelled(encoded: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, ids and decoded (the pieces of ids joined by one space) of all rows with ids; ``key`` must be unique."""
    ids = encoded.select(key, F.posexplode("ids").alias("at", "id")).join(vocabulary, "id", "left")
    whole = ids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "id", F.coalesce("piece", F.lit("")).alias("piece")))).alias("x"))
    return whole.select(key, F.col("x.id").alias("ids"), F.array_join("x.piece", " ").alias("decoded"))


def _piece_table(path: str) -> list[str]:
    """id -> piece, special tokens included."""
    spec = json.loads(open(path, encoding="utf-8").read())
    by_id = {i: piece for piece, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    if spec.get("decoder") is not None:
        raise ValueError("this decoder joins pieces by one space; the tokenizer has a decoder of its own")
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[int, list, list[str]]]:
    """(block, ids, texts): consecutive rows of this partition of about block_chars characters together."""
    ids, texts, size, k = [], [], 0, 0
    part = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 1
            if size >= block_chars:
                yield part + k, ids, texts
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield part + k, ids, texts


def _asked(routes: int, block_chars: int):
    """Distinct words of each block, by route of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches, block_chars):
            distinct: set[str] = set()
            for t in texts:
                distinct.update(words(t))
            by_route: list[list[bytes]] = [[] for _ in range(routes)]
            for w in sorted(distinct):
                b = w.encode()
                by_route[crc32(b) % routes].append(b)
            used = [r for r in range(routes) if by_route[r]]
            if used:
                yield pa.RecordBatch.from_pydict(
                    {
                        "route": pa.array(used, pa.int32()),
                        "block": pa.array([block] * len(used), pa.int64()),
                        "asked": pa.array([_pack(b"\n".join(by_route[r])) for r in used], pa.binary()),
                    }
                )

    return run


def _answers(path: str):
    """Encodes each distinct word of this partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        requests = [(b, w) for batch in batches for b, w in zip(batch.column("block").to_pylist(), batch.column("asked").to_pylist(), strict=True)]
        if not requests:
            return
        place: dict[bytes, int] = {}
        for _, asked in requests:
            for w in _unpack(asked).split(b"\n"):
                place.setdefault(w, len(place))
        table, tokenizer = list(place), _tokenizer(path)
        ids: list[list[int]] = []
        for at in range(0, len(table), 20_000):
            ids += [e.ids for e in tokenizer.encode_batch([w.decode() for w in table[at : at + 20_000]], add_special_tokens=False)]
        for block, asked in requests:
            own = [ids[place[w]] for w in _unpack(asked).split(b"\n")]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "asked": pa.array([asked], pa.binary()),
                    "lengths": pa.array([_pack(np.array([len(x) for x in own], dtype="<u4").tobytes())], pa.binary()),
                    "ids": pa.array([_pack(np.array([i for x in own for i in x], dtype="<u4").tobytes())], pa.binary()),
                }
            )

    return run


def _texts(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches, block_chars):
            encoded = [t.encode() for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(t) for t in encoded]], pa.list_(pa.int64())),
                    "body": pa.array([_pack(b"".join(encoded))], pa.binary()),
                }
            )

    return run


def _joined(path: str):
    """Puts the ids and pieces of every document together by the position of its words."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = _piece_table(path)
        id_bytes: dict[str, bytes] = {}
        decoded: dict[str, str] = {}
        for asked, lengths, ids in zip(*(answers.column(c).to_pylist() for c in ("asked", "lengths", "ids")), strict=True):
            flat, at = _unpack(ids), 0
            numbers = np.frombuffer(flat, dtype="<u4").tolist()
            for w, n in zip(_unpack(asked).decode().split("\n"), np.frombuffer(_unpack(lengths), dtype="<u4").tolist(), strict=True):
                id_bytes[w] = flat[4 * at : 4 * (at + n)]
                decoded[w] = " ".join([pieces[i] for i in numbers[at : at + n]])
                at += n
        doc_ids, encoded, texts_out = [], [], []
        for block in texts.to_pylist():
            body, at = _unpack(block["body"]), 0
            doc_ids += block["doc_ids"]
            for length in block["sizes"]:
                split = words(body[at : at + length].decode())
                at += length
                encoded.append(b"".join([id_bytes[w] for w in split]))
                texts_out.append(" ".join([d for w in split if (d := decoded[w])]))
        columns = [pa.array(doc_ids, pa.int64()), pa.array(encoded, pa.binary()), pa.array(texts_out, pa.string())]
        return pa.table(columns, names=["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (the ids' pieces joined) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    routes = max(shuffle_partitions(docs.sparkSession), -(-chars // ROUTE_CHARS))
    asked = rows.mapInArrow(_asked(routes, block_chars), "route int, block bigint, asked binary")
    answers = asked.repartition(routes, "route").mapInArrow(_answers(tokenizer_path), "block bigint, asked binary, lengths binary, ids binary")
    texts = rows.mapInArrow(_texts(block_chars), "block bigint, doc_ids array<bigint>, sizes array<bigint>, body binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(tokenizer_path), "doc_id bigint, ids binary, decoded string")


def decode_ids(encoded: DataFrame, tokenizer_path: str, *, ids: str = "ids") -> DataFrame:
    """Adds ``text``: the pieces of ``ids`` (little-endian 32-bit) joined by one space, through the id-to-piece join.

    Each distinct list of ids is spelled once; a null list counts as empty, an unknown id as an empty piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b, dtype="<u4").astype("<i4") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["__key", "ids"])

    distinct = encoded.select(F.col(ids).alias("__key")).where("octet_length(__key) > 0").distinct()
    numbers = distinct.mapInArrow(run, "__key binary, ids array<int>")
    table = spelled(numbers, pieces(encoded.sparkSession, tokenizer_path), "__key").select("__key", F.col("decoded").alias("__text"))
    met = encoded.join(table, F.col(ids) == F.col("__key"), "left")
    return met.select(*(F.col(f"`{c}`") for c in encoded.columns if c != "text"), F.coalesce("__text", F.lit("")).alias("text"))

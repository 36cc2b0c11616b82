import random
import re
from collections import defaultdict
from difflib import SequenceMatcher
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import exact_topk, merkle, packing, word_table

TEXTS = [
    "Hello  world\n\nthe 2nd line's here ",
    None,
    "",
    " \t\n",
    "Ünïcode ÇA VA? ΣΑΣ İi 中文 ❤️ á",
    "<|endoftext|> a<|endoftext|>b <|startoftext|>",
    "x\x1cy \x1f z w v​u\u0085q",
    "word " * 3000,
    "same text", "same text",
    "a" * 5000,
    "don't we'll 12345 $$$ %%% tab\tnew\r\nline  \n  end",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id here", 1, "clash"), (3, "id again", 2, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, block string").repartition(3, "text")


def test_word_table_equals_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        e = tokenizer.encode(r.text or "", add_special_tokens=False)
        want.append((r.doc_id, np.array(e.ids, dtype="<u4").tobytes(), tokenizer.decode(e.ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for block_chars in (word_table.BLOCK_CHARS, 100):
        encoded = word_table.encode_documents(docs, path, block_chars=block_chars)
        assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in encoded.collect()), key=key) == sorted(want, key=key)
    back = word_table.decode_ids(encoded.drop("decoded"), path).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in back), key=key) == sorted(want, key=key)
    assert word_table.encode_documents(docs.limit(0), path).count() == 0


def random_texts(count, seed):
    """Texts over control characters, all white space, marks, letters of several scripts, with and without spaces."""
    rnd = random.Random(seed)
    chars = [*map(chr, range(0x20)), *" \u0085\xa0\u1680\u2003\u2028\u202f\u3000\u200b\ufeff\x7f", *"abcXYZ'std09.,!?-_<|>", *"éÅßΣσςİıﬁ中文ع", "\u0301", "\u0345", "🎉", "'ll", "n't", "<|endoftext|>"]
    return ["".join(rnd.choices(chars, k=rnd.randint(0, 12))) for _ in range(count)]


def test_word_table_equals_the_library_on_random_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a\x1cb", "\x1f", *random_texts(10_000, 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    got = word_table.encode_documents(rows, path, block_chars=9_000).collect()
    assert len(got) == len(texts)
    for r in got:
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want, texts[r.doc_id]
        assert r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_chunks_encode_as_whole_texts(monkeypatch):
    """Every code point beside letters and between white space, all runs of white space, and random texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    white = [chr(c) for c in (*range(9, 14), 32, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}!{c} {c}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += [f"x{a}{b}{c}y{a} z{b}\n" for a in white for b in ["", *white] for c in ("", " ", "\n")] + random_texts(10_000, 7)
    monkeypatch.setattr(packing, "KNOWN", 50_000)
    got = [np.frombuffer(b, dtype="<u4").tolist() for at in range(0, len(texts), 500) for b in encode(texts[at : at + 500])]
    for text, own, want in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == want.ids, text


@pytest.mark.parametrize("window", [packing.WINDOW, 2000])
def test_packing_covers_every_id_without_padding(docs, window):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    rows = packing.pack(docs, path, window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc, key=str) == sorted({(d, len(i)) for d, x in want.items() for i in x}, key=str)
    for (doc, n), pieces in by_doc.items():
        ids = next(i for i in want[doc] if len(i) == n)
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == n
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    assert packing.pack(docs.limit(0), path).count() == 0


def test_assign_takes_the_cheapest_open_sequence():
    pieces = packing.assign([6, 5, 3, 2], [8, 8])
    assert pieces[:2] == [(0, 0, 6, 0), (1, 0, 5, 1)] and pieces[2][:3] == (2, 0, 3) and pieces[2][3] == 1
    assert sum(p[2] for p in pieces) == 16


def test_merkle_edited_and_next(spark, docs):
    hashed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    got = merkle.fingerprints(docs).collect()
    want = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(merkle.fingerprint, (text, edited, following))
        want.append((doc, len(text), sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert merkle.fingerprints(docs.limit(0)).count() == 0
    one = merkle.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_merkle_roots_and_edit_places(spark):
    rnd = random.Random(1)
    paragraphs = [" ".join(rnd.choices("abcdefgh", k=8)) + str(i) for i in range(60)]
    a = merkle.tree("\n".join(paragraphs))
    changed = [*paragraphs[:20], "new", *paragraphs[21:40], *paragraphs[41:]]
    assert merkle.differing(a, a) is None
    assert merkle.differing(a, merkle.tree("\n".join(changed))) == ((20, 41), (20, 40))
    assert merkle.root(merkle.tree("a\nb")) != merkle.root(merkle.tree("a\n\nb")) != merkle.root(merkle.tree("a b"))
    nodes = merkle.nodes(spark.createDataFrame([(1, "\n".join(paragraphs)), (2, None)], "doc_id long, text string")).collect()
    assert sum(n.level == 0 for n in nodes) == 61 and sum(n.level == 2 for n in nodes) == 2


def test_merkle_hot_ids_are_many_parts(spark):
    """Equal ids, null ids and equal rows are dealt to several parts; each row still has its next."""
    rows = [(None, f"no id {i % 7}") for i in range(300)] + [(5, "one text")] * 300 + [(5, f"text {i}") for i in range(300)] + [(i, f"own {i}") for i in range(6, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    dealt = merkle.with_next(docs, part_bytes=300)
    sizes = [r["count"] for r in dealt.where("not guest").groupBy("part").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == len(rows)
    hashed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    want = sorted((d or 0, sha256(merkle.half_replaced(a, b).encode()).hexdigest()) for (d, a), (_, b) in zip(order, order[1:] + order[:1], strict=True))
    got = merkle.fingerprints(docs, part_bytes=300).collect()
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) == want


def words_in_common(a, b):
    """Share of characters in words that both texts have in the same order."""
    x, y = (re.findall(r"\S+\s?|\s", t) for t in (a, b))
    blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    return 2 * sum(len("".join(x[m.a : m.a + m.size])) for m in blocks) / (len(a) + len(b))


def test_merkle_likeness_against_difflib():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnoprstuvwz", k=rnd.randint(2, 9)))
    body = lambda n: "".join(word() + rnd.choice([" "] * 9 + ["\n", "\n\n"]) for _ in range(n))
    for n in (4, 6, 10, 20, 50, 100, 300, 1000, 3000) * 4:
        a, b = body(n), body(rnd.choice([n, n // 2 + 1, 2 * n]))
        half = merkle.half_replaced(a, b)
        cut = a.index(" ", len(a) // 3) if " " in a[len(a) // 3 :] else len(a) // 2
        for other in (half, b, a[:cut] + " new words " + a[cut:], a[cut:], "first " + a, a + b):
            near = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(other))
            kept = 2 * (len(a) - len(a) // 2) / (len(a) + len(half)) if other == half else words_in_common(a, other)
            assert near < 1 and abs(near - kept) <= 0.1 + (2 / n if n < 30 else 0), (n, near, kept, other[:40])
            assert near == merkle.likeness(merkle.fingerprint(other), merkle.fingerprint(a))


def test_merkle_edits_from_fingerprints(monkeypatch):
    """Exact places in short texts; within a few leaves in long ones, whatever is read at a time."""
    text = "It was a calm day.\nNothing happened, or so\nthey say."
    other = text.replace("calm", "dull")
    assert merkle.changed(merkle.fingerprint(text), merkle.fingerprint(other)) == ((9, 13), (9, 13))
    assert merkle.changed(merkle.fingerprint(text), merkle.fingerprint(text)) is None
    assert merkle.likeness(merkle.fingerprint(None), merkle.fingerprint("")) == 1.0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0.0
    rnd = random.Random(9)
    long = "".join(rnd.choices("abcdefgh \n", k=60_000))
    edited = long[:20_000] + "other" + long[20_100:]
    (a, b), (c, d) = merkle.changed(merkle.fingerprint(long), merkle.fingerprint(edited))
    wide = 8 * 60_000 // merkle.LEAVES
    assert a == c and 20_000 - wide <= a <= 20_000 and 20_100 <= b <= 20_100 + wide and b - d == 95
    whole = [merkle.fingerprint(t) for t in (text, long, "word " * 5000, "")]
    monkeypatch.setattr(merkle, "STRETCH", 1000)
    assert [merkle.fingerprint(t) for t in (text, long, "word " * 5000, "")] == whole


def test_parts_of_rows_in_two_steps(spark):
    bounds = [(3, 0, 0), (5, 0, 0), (8, -7, 2), (8, 5, 0), (21, 0, 0), (34, 0, 0)]
    at = F.struct(F.col("id").alias("key"), F.lit(0).cast("bigint").alias("hash"), F.lit(0).cast("bigint").alias("row"))
    rows = spark.range(40).select("id", merkle._part(at, bounds).alias("p")).collect()
    assert all(r.p == sum(b <= (r.id, 0, 0) for b in bounds) for r in rows)


def brute(vectors, k):
    q = [[int(np.floor(256 * float(x))) for x in v] if v is not None and all(x is not None and np.isfinite(x) for x in v) else None for _, v in vectors]
    out = []
    for i, (query, _) in enumerate(vectors):
        if query is None or query % 50 or q[i] is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), v) for j, (v, _) in enumerate(vectors) if v is not None and j != i and q[j] is not None)
        out += [(query, r, v, -s) for r, (s, v) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(5, 40))
    vectors = [(i, (centres[i % 5] + rnd.normal(size=40) * 0.2).astype("f4").tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)]
    vectors += [(400, None), (450, [None] * 40), (451, [float("nan")] * 40), (452, [float("inf")] * 40), (None, vectors[0][1]), (500, [1.5, 2.0]), (100, vectors[3][1]), (50, vectors[50][1]), (9, vectors[9][1]), (550, [])]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in vectors], "vec_id long, embedding array<float>, score double")
    want = brute(vectors, 5)
    for queries, *blocks in ((1 << 14, 2048, 1 << 14), (1 << 14, 2048, 40), (0, 2048, 1 << 14), (0, 3, 50)):
        monkeypatch.setattr(exact_topk, "QUERIES", queries)
        monkeypatch.setattr(exact_topk, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(exact_topk, "VECTOR_BLOCK", blocks[1])
        assert sorted(map(tuple, exact_topk.top_k(df, F.col("id") % 50 == 0, 5).collect())) == want
    assert exact_topk.top_k(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0
    few = exact_topk.top_k(df.where("vec_id in (0, 3)"), F.col("id") % 50 == 0, 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 3)]


def test_topk_bounds_drop_candidates():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(64, 16_000))
    x = np.floor(256 * x / np.linalg.norm(x, axis=0))
    norms, ids = np.linalg.norm(x, axis=0), np.arange(16_000)
    for i in range(5):
        seen: list = []
        cols, scores = exact_topk.best_of_block(x[:, i].copy(), x, norms, i, ids, 5, survivors=seen)
        every = x[:, i] @ x
        every[i] = -np.inf
        assert scores.tolist() == np.sort(every)[::-1][:5].astype(int).tolist() and every[cols].astype(int).tolist() == scores.tolist()
        assert seen[3] < 0.6 * 16_000 and seen[4] < 0.2 * 16_000 and seen[5] < 0.05 * 16_000

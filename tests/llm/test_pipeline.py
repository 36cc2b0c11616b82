"""The pipeline's stages on made documents, each against a plain version of its rule."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(3)
    syllables = [a + b for a in "bdklmnrst" for b in "aeio"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        lines = [" ".join(word() for _ in range(rnd.randint(5, 15))) for _ in range(rnd.randint(2, 8))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            lines[rnd.randrange(len(lines))] += " grudnik" + rnd.choice(syllables)
        if not good:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        rows.append([i, "\n".join(["Site header line", *lines] if good else lines), "en", f"s{i % 2}", 0])
        labels.append((i, int(good), int(toxic)))
    rows += [[600 + i, rows[41 + 4 * i][1], "en", rows[41 + 4 * i][3], 0] for i in range(20)]  # exact copies
    rows += [[700, None, "en", "s0", None], [701, "", None, None, 0], [702, "calm words " * 20_000, "en", "s1", 0]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:450], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """The rows before and after every stage, each written and read again."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ({r.doc_id: r for r in docs.collect()}, after.collect(), after.columns)
        docs = after
    return out


def test_stages_in_order_keep_the_columns(staged):
    assert list(staged) == ["toxicity", "quality", "line_dedup", "simhash", "packing"]
    assert all(staged[n][2] == COLUMNS for n in list(staged)[:-1])


def test_filters_reject_their_documents_only(staged):
    before, after, _ = staged["toxicity"]
    kept = {r.doc_id for r in after}
    wrong = [i for i in before if i < 600 and (i in kept) != (i % 5 != 0)]
    assert len(wrong) <= 6 and 702 in kept and {r.doc_id: r for r in after}[702] == before[702]
    before, after, _ = staged["quality"]
    kept = {r.doc_id for r in after}
    assert len([i for i in before if i < 600 and (i in kept) != (i % 4 != 0)]) <= 6


def test_line_dedup_by_counting(staged):
    before, after, _ = staged["line_dedup"]
    pages, counts = Counter(r.source for r in before.values()), defaultdict(set)
    for r in before.values():
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                counts[r.source, line.strip(" ")].add(r.doc_id)
    gone = {k for k, v in counts.items() if len(v) >= queries.LINE_PAGES and len(v) / pages[k[0]] > queries.LINE_RATIO}
    assert any(line == "Site header line" for _, line in gone)
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        old = before[r.doc_id].text
        want = None if old is None else "\n".join(x for x in old.split("\n") if (r.source, x.strip(" ")) not in gone)
        assert r.text == want and r.n_chars == (None if want is None else len(want))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_one_of_each_group(staged):
    """Texts of these documents are equal or unrelated: the smallest id of equal ones stays, all others too."""
    before, after, _ = staged["simhash"]
    first: dict = {}
    for i in sorted(before):
        first.setdefault(frozenset(shingles(before[i].text)), i)
    assert {r.doc_id for r in after} == set(first.values())


def test_one_of_each_by_fingerprints(spark, monkeypatch):
    """Against all pairs: SimHash fingerprints within 3 bits and a similarity of 0.8; copies beyond either stay, crowded keys are whole."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([60, 300, 900]))
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    passage = " ".join(rnd.choices(words, k=20))
    texts += [" ".join([*rnd.choices(words, k=60), *[passage] * 60]) for _ in range(12)]  # alike by fingerprint only
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i, texts[k], "en", "s", len(texts[k])) for i, k in enumerate(order)]
    prints, sets = [simhash.fingerprint(r[1]) for r in rows], [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    kinds = Counter()
    for i in range(len(rows)):
        for j in range(i):
            near, alike = (prints[i] ^ prints[j]).bit_count() <= 3, len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            kinds[near, alike] += 1
            if sets[i] == sets[j] or near and alike:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(kinds) == 4, kinds
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == sorted(set(root))


def test_packing_holds_every_token(staged):
    before, after, _ = staged["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(before)
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(before[i].text or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_run_equals_the_stages(spark, sf_dir, staged):
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    tokens = lambda rows: sum(r[2] for r in rows)
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in staged["packing"][1]}
    assert {r[0] for r in got} == {r[0] for r in want} and tokens(got) == tokens(want)


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
    assert docs.select(F.col("text")).count() == 0

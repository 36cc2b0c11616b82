import hashlib
import itertools

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import chat_format, line_dedup, simhash

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    out = chat_format.digests(chat_format.format_chats(df)).collect()
    return {r.conv_id: r for r in out}


def test_chat_digests_order_and_machine(spark):
    rows = [
        (1, 1, "assistant", "b\\<|im_end|>"),
        (1, 0, "user", None),
        (2, 0, "assistant", "first"),
        (3, 0, "system", "s"),
        (3, 1, "user", "u"),
        (3, 2, "assistant", ""),
        (4, None, None, "x"),
    ]
    out = formatted(spark, rows)
    one = "user\n\nassistant\nb\\<|im_end|>\n"
    assert out[1].turns_sha256 == hashlib.sha256(one.encode()).hexdigest()
    assert out[1].loss_chars == 12 and out[1].n_turns == 2 and out[1].valid
    assert out[1].loss_sha256 == hashlib.sha256(b"b\\<|im_end|>").hexdigest()
    assert not out[2].valid and out[3].valid and not out[4].valid
    assert out[3].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()


def test_chat_empty_table_and_long_conversation(spark):
    assert formatted(spark, []) == {}
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    out = formatted(spark, rows)[1]
    text = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert out.n_turns == 300 and out.turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and out.valid


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="<|im_end>\\ \nab", max_size=30), min_size=1, max_size=6))
def test_chat_round_trip(spark, texts):
    rows = [(i, 0, t[:5], t) for i, t in enumerate(texts)]
    out = formatted(spark, rows)
    for i, t in enumerate(texts):
        assert out[i].turns_sha256 == hashlib.sha256(f"{t[:5]}\n{t}\n".encode()).hexdigest()


def test_line_dedup(spark):
    pages = [(i, "h", f"head\nbody {i}\n\nhead ", "n") for i in range(6)] + [(9, "g", "head\nx", "n"), (10, None, None, "n"), (11, "h", "", "n")]
    df = spark.createDataFrame(pages, "id long, host string, text string, ratio string")
    out = {r.id: r for r in line_dedup.drop_boilerplate(df, F.col("host"), max_ratio=0.5, min_pages=3).collect()}
    assert out[0].text == "body 0\n" and out[0].n_dropped == 2 and out[0].n_lines == 4 and out[0].ratio == "n"
    assert out[9].text == "head\nx" and out[10].text is None and out[11].text == ""
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("host")).count() == 0


def test_line_dedup_shuffled_join_is_equal(spark, monkeypatch):
    pages = [(i, f"h{i % 2}", f"head{i % 3}\nbody {i}") for i in range(60)]
    df = spark.createDataFrame(pages, "id long, host string, text string")
    a = sorted(map(tuple, line_dedup.drop_boilerplate(df, F.col("host"), max_ratio=0.1, min_pages=3).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    b = sorted(map(tuple, line_dedup.drop_boilerplate(df, F.col("host"), max_ratio=0.1, min_pages=3).collect()))
    assert a == b and any(r[2].startswith("body") for r in a)


def slow_fingerprint(text, k):
    w = bytes(text or "", "utf-8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, distance):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps.items(), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_fingerprint_cases():
    for text in (None, "", "  \n", "One", "A b", "É b C", "a b c d e f g a b c d", "x " * 70_000):
        assert simhash.fingerprint(text, 3) == slow_fingerprint(text, 3)


def test_components_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(1500)) for _ in range(25)]
    docs = []
    for b in base:
        for _ in range(rnd.randint(1, 6)):
            w = b.split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "zz"
            docs.append(" ".join(w))
    docs += ["", None, "x"]
    rows = [(i, t, "c") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = slow_components({i: slow_fingerprint(t, 3) for i, t, _ in rows}, 2)
    exact = {slow_fingerprint(t, 3): i for i, t, _ in rows}
    assert len(set(want.values())) < len(exact)  # some link between different texts
    for bucket in (48, 1):
        got = {r.id: r.component_id for r in simhash.components(df, bucket=bucket).collect()}
        assert got == want
    assert simhash.components(df.limit(0)).count() == 0
    kept = {r.doc_id for r in simhash.one_per_component(df).collect()}
    assert kept == set(want.values())


def test_connected_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_simhash_without_ids_and_repeated_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "only here one two"), (7, "A B c d e f g"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in simhash.components(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 5), (9, 9)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_per_component(df).collect()), key=str)
    assert kept == sorted([(5, rows[0][1]), (5, rows[0][1]), (None, rows[0][1]), (None, rows[3][1]), (9, None)], key=str)


def test_line_dedup_with_clashing_names(spark):
    rows = [(i, f"top\nx{i}", "h", "k", "q", -1, -1) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, text string, host string, host_key string, key string, n_lines int, pages int")
    out = {r.id: r for r in line_dedup.drop_boilerplate(df, F.col("host"), max_ratio=0.5, min_pages=3).collect()}
    assert out[3].text == "x3" and (out[3].host_key, out[3].key, out[3].pages, out[3].n_lines) == ("k", "q", -1, 2)


def test_chat_hot_conversation_with_equal_turns(spark):
    rows = [(1, 0, "user", f"t{i % 3}") for i in range(400)] + [(i, None, None, None) for i in range(2, 30)]
    out = formatted(spark, rows)
    text = "".join(f"user\n{t}\n" for t in sorted(r[3] for r in rows[:400]))
    assert out[1].n_turns == 400 and out[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and not out[1].valid
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_similar_components_by_shingle_sets(spark, monkeypatch):
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    docs, family = [], []
    for f in range(12):
        base = [word() for _ in range(400)]
        for c in range(1 if f % 3 == 0 else 5 if f < 10 else 60):
            copy = list(base)
            for _ in range(0 if c == 0 else rnd.randint(1, 4)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
            family.append(f)
    docs += ["", None, " \n", "two words", "two words"]
    family += ["e", "e", "e", "w", "w"]
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(docs)] + [(None, docs[0], 0, 0)], "doc_id long, text string, node int, key int")
    want = {i: family.index(f) for i, f in enumerate(family)}
    for chunk in (256, 8):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r.id: r.component_id for r in simhash.similar_components(df).collect()}
        assert got == want
    kept = [r.doc_id for r in simhash.one_per_similar(df).collect()]
    assert sorted(kept, key=str) == sorted([*set(want.values()), None], key=str)
    assert simhash.similar_components(df.limit(0)).count() == 0


def jaccard_components(texts):
    """Smallest index reachable over pairs of five-word shingle sets of Jaccard similarity 0.8 or more, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return dict(enumerate(root))


def test_pairs_spread_over_a_crowded_key(spark, monkeypatch):
    """Groups of two around 0.8, all of them over the same long passage, so that prefixes meet in crowded keys."""
    import random

    rnd = random.Random(5)
    passage, texts = [f"p{i}" for i in range(80)], []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(rnd.choice([4, 12, 40]))]
        for _ in range(2):
            copy = passage + own
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = f"r{rnd.random()}"
            texts.append(" ".join(copy))
    want = jaccard_components(texts)
    assert 20 < len(set(want.values())) < 110
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (256, 4):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert {r.id: r.component_id for r in simhash.similar_components(df).collect()} == want


def test_a_repeated_passage_does_not_link_texts(spark):
    import random

    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [" ".join([f"t{t}w{i}" for i in range(300)] + [passage] * 20) for t in range(6)]
    texts.append(texts[0] + f" one more {rnd.random()}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.similar_components(df).collect()}
    assert got == jaccard_components(texts) == {**{i: i for i in range(6)}, 6: 0}


def test_one_per_similar_with_repeated_ids(spark):
    one, two = "a b c d e f g", "other words that stand alone here"
    rows = [(3, one), (5, one), (5, two), (7, two), (9, "x y"), (9, "x y"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_per_similar(df).collect()), key=str)
    assert kept == sorted([(3, one), (5, two), (9, "x y"), (None, "x y")], key=str)


@pytest.mark.parametrize("marks", [("[INST]", "{T}", "[/INST]\n"), ("$1", "$2", "$3\n"), (".*", "^-", "(?")])
def test_chat_templates_of_other_marks(spark, marks):
    """Texts made of the marks come back, whatever the marks; those that could arise at borders are refused."""
    for bad in (("<<", "<|", "|>"), ("ab", "abc", "ad"), ("a", "b|", "c|"), ("a\\", "b|", "c|")):
        with pytest.raises(ValueError):
            chat_format.ChatTemplate(*bad)
    template = chat_format.ChatTemplate(*marks)
    bits = [*marks, *(m[:2] for m in marks), *(m[0] for m in marks), *(m[1:] for m in marks), "\\", " ", "x", "\n", "$1", "<|im_end|>"]
    rnd = __import__("random").Random(3)
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 9))) for _ in range(120)]
    rows = [(i, t, ("user", "assistant")[t], texts[2 * i + t]) for i in range(60) for t in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(df, template), template)
    for r in back.collect():
        assert r.roles == ["user", "assistant"] and r.texts == texts[2 * r.conv_id : 2 * r.conv_id + 2] and r.loss_text == texts[2 * r.conv_id + 1]

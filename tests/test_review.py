import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markup
from folioscope.operators import metrics, review


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_routing(spark):
    df = spark.createDataFrame([("Body", None), ("x", "prose"), ("notation", ""), ("table", None), ("odd", None), ("unknown", None)], "type string, forced string")
    out = [(r.domain, r.primary, r.confidence, r.cost) for r in review.routed(df).collect()]
    assert out == [("prose", "line", 0.9, 1.0), ("prose", "line", 0.95, 1.0), ("notation", "glyph", 0.95, 1.5), ("table", "special", 0.85, 3.0), ("unknown", "glyph", 0.35, 2.0), ("unknown", "glyph", 0.45, 2.0)]
    queue = spark.createDataFrame([("a", 1, "table", 50, "open"), ("b", 2, "table", 90, "open")], "id string, page int, kind string, severity int, status string")
    assert [r.id for r in review.queue_filter(queue, kind="table", minimum=60).collect()] == ["b"] and review.queue_filter(queue, page=1, status="x").count() == 0
    with pytest.raises(Exception, match="unknown kind: odd"):
        spark.range(1).select(review.checked(F.lit("odd"), ["a"], "kind")).collect()


def test_described(spark):
    codes = spark.createDataFrame([(1, "lost", {"n": "3"}), (1, "lost", {"n": "3"}), (1, "odd", {})], "key int, code string, values map<string,string>")
    templates = spark.createDataFrame([("lost", "{n} characters lost")], "code string, template string")
    assert {r.sentence for r in review.described(codes, templates).collect()} == {"3 characters lost", "odd"}


def test_letters(spark):
    c = F.array(*(F.struct(F.lit(x).alias("char"), F.lit(0.5).alias("p")) for x in ("a", "ã", "ç", "ñ", "♘")))
    chars = lambda lang: [x.char for x in one(spark, review.allowed_letters(c, F.lit(lang)))]
    assert chars("en") == ["a", "♘"] and chars("pt") == ["a", "ã", "ç", "♘"] and len(chars("xx")) == 5


def test_line_reasons_and_confidence(spark):
    s = "fragment boolean, text string, anchor string, engine_text string, domain string, source string, primary string, dropped int, filled int"
    rows = [
        (True, "", "", "", "prose", "glyph", "line", 9, 0), (False, " ", "", "", "prose", "line", "line", 2, 0), (False, "", "", "", "prose", "line", "line", 0, 0), (False, "a word", "", "other", "prose", "glyph", "line", 0, 0),
        (False, "3.♖e8+ ♕", "", "", "notation", "glyph", "glyph", 2, 1), (False, ":", "", "", "prose", "line", "line", 0, 0), (False, "1.s used w~x", "", "", "prose", "line", "line", 0, 0), (False, "e4 1-", "", "", "notation", "glyph", "glyph", 0, 0),
    ]
    out = [r.c for r in spark.createDataFrame(rows, s).select(review.line_reasons().alias("c")).collect()]
    assert out == [[], ["line_lost"], [], ["engine_disagreed"], ["dropped_in_notation", "malformed_move"], ["stray_mark"], ["malformed_move_number", "engine_garbage"], ["result_incomplete"]]
    conf = lambda codes, sim, src: one(spark, review.line_confidence(F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>"), F.lit(sim).cast("double"), F.lit(src)))
    assert conf([], 0.9, "line") == 0.9 and conf([], 0.9, "glyph") == 0.75 and conf(["line_lost", "stray_mark"], 0.9, "line") == 0.0 and conf(["stray_mark"], 0.9, "line") == 0.7


def test_corrections_and_candidates(spark):
    events = spark.createDataFrame([("e1", "d", "p", "t1", "a", "b", "u", []), ("e2", "d", "p", "t1", "b", "a", "u", ["undo"]), ("e3", "d", "p", "gone", "b", "a", "u", [])], "event_id string, document_id string, page_id string, target_id string, before string, after string, user string, reason_codes array<string>")
    blocks = spark.createDataFrame([("t1", "diagram", "s", [0.9, 0.4])], "id string, kind string, source_id string, confidences array<double>")
    found = review.corrections(events, blocks).collect()
    assert [(r.record_id, r.confidence, r.impact, r.editor) for r in found] == [("e1", 0.4, 100.0, "u")]
    assert review.corpus_items(review.corrections(events, blocks)).first().layout == "unknown"
    pages = lambda *rows: review.candidates(spark.createDataFrame(list(rows), "document string, page_index int, families array<string>"))
    assert [r.id for r in pages(("doc", 7, []), ("doc", 1234, [])).collect()] == ["doc-p007", "doc-p1234"]
    for bad in (("a/b", 1, []), ("doc", 0, []), ("..", 1, [])):
        with pytest.raises(Exception, match="plain document name"):
            pages(bad).collect()
    cand = spark.createDataFrame([("c1", "d", 1, "h", "unreviewed"), ("c2", "d", 2, "h", "reviewed"), ("c3", "d", 3, "h", "unreviewed")], "id string, document string, page_index int, sha256 string, status string")
    rev = spark.createDataFrame([("c1", "d", 1, "h", "reviewed"), ("c2", "d", 2, "h", "reviewed"), ("c3", "d", 3, "other", "reviewed"), ("c9", "d", 1, "h", "reviewed")], "candidate_id string, document string, page_index int, sha256 string, status string")
    assert {r.candidate_id: r.violation for r in review.provenance_violations(rev, cand).collect()} == {"c2": "candidate already reviewed", "c3": "other source", "c9": "no candidate"}


def test_datasets(spark):
    rows = [("A", "a", 9, 9), ("A2", "a", 9, 8), ("B", "b", 0, 0), ("C", "c", 2, 2), ("?", None, 5, 5)]
    out = {(r.problem, r["where"]) for r in review.dataset_problems(spark.createDataFrame(rows, "folder string, char string, samples int, readable int"), 5).collect()}
    assert out == {("invalid name", "?"), ("empty", "B"), ("few samples", "C"), ("unreadable", "A2"), ("collision", "A, A2")}
    classes = spark.createDataFrame([("a", "a", 3), ("old_a", "a", 2), ("old_b", "b", 1), ("none", None, 4), ("empty", "e", 0)], "folder string, canonical string, samples long")
    assert {r.folder: (r.step, r.to) for r in review.migration_plan(classes).collect()} == {"old_a": ("merge", "a"), "old_b": ("rename", "b"), "none": ("quarantine", None), "empty": ("remove", None)}
    done, converged = review.migrated(classes)
    assert converged and {r.folder: r.samples for r in done.collect()} == {"a": 5, "b": 1}


def test_lines_and_mining(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 1, "b", 0.5, 5, 0, 9, 4), (1, 0, 0, 0, 0, "a", 1.0, 0, 1, 4, 5), (1, 0, 0, 1, 0, "c", 1.0, 0, 9, 4, 12)], "page int, block int, par int, line int, pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = review.words_to_lines(words).orderBy("place").collect()
    assert [(r.text, r.confidence, r.x1, r.y1, r.x2, r.y2) for r in out] == [("a b", 0.75, 0, 0, 9, 5), ("c", 1.0, 0, 9, 4, 12)]
    pairs = spark.createDataFrame([(1, list("casa"), list("caza"))] * 1 + [(2, list("as"), list("az")), (3, list("ab"), list("b"))], "k int, reference array<string>, prediction array<string>")
    aligned = metrics.aligned_tokens(pairs, "k").withColumn("confidence", F.lit(0.95))
    mined = review.mined_errors(aligned, 0.9)
    assert {(r["read"], r.expected, r["kind"], r.n) for r in mined.collect()} == {("z", "s", "swapped", 2), ("", "a", "lost", 1)}
    assert [(r.expected, r.n) for r in review.classes_to_train(mined).collect()] == [("s", 2)]
    box = "page int, pos int, x1 double, y1 double, x2 double, y2 double"
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 10.0), (1, 1, 0.0, 8.0, 100.0, 18.0)], box)
    reads = spark.createDataFrame([(1, 0, 0.0, 4.0, 100.0, 14.0), (1, 1, 0.0, 1.0, 100.0, 10.0), (1, 2, 300.0, 0.0, 400.0, 10.0)], box)
    assert {r.line: r.reading for r in review.line_matches(lines, reads).collect()} == {0: 1, 1: 0}
    anchors = spark.createDataFrame([(1, i) for i in range(3)], "line int, box int")
    chars = spark.createDataFrame([(1, 0, "x", "c"), (1, 1, "y", None), (1, 2, None, "q"), (1, 3, "z", "z")], "line int, pos int, ref string, pred string")
    assert [r.text for r in review.spread_reading(anchors, chars).orderBy("box").collect()] == ["c", "q", "z"]


def test_fuzzy_suggestions(spark):
    lex = spark.createDataFrame([("cavalo",), ("craval",), ("torre",), ("bispo",), ("peao",)], "word string")
    out = review.fuzzy_suggestions(spark.createDataFrame([("cavalu",), ("xispo",), ("zzzz",)], "word string"), lex, 2)
    assert sorted((r.word, r.place, r.candidate) for r in out.collect()) == [("cavalu", 1, "cavalo"), ("cavalu", 2, "craval"), ("xispo", 1, "bispo")]


def test_packages_groups_and_stacks(spark):
    m = spark.createDataFrame([("s1", "p1", "c1")], "schema string, pipeline_version string, config_hash string")
    assert review.incompatibilities(m, "s1", "p2", "c2").first().reasons == ["pipeline_version", "config_hash"] and review.incompatibilities(m).first().compatible
    keys = {one(spark, review.cache_key(F.lit("a"), F.lit(x))) for x in ("b", "c")}
    assert len(keys) == 2
    rnd = random.Random(4)
    pts = [(1, i, rnd.random() * 10, rnd.random() * 10) for i in range(60)]
    root = {i: i for _, i, _, _ in pts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, i, x, y in pts:
        for _, j, a, b in pts:
            if i < j and abs(x - a) <= 1 and abs(y - b) <= 1:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.id: r.root for r in review.spatial_groups(spark.createDataFrame(pts, "page int, id long, x double, y double"), "page", 1.0).collect()}
    assert got == {i: find(i) for i in root}
    ops = [(1, i, o, v) for i, (o, v) in enumerate([("undo", None), ("save", "a"), ("save", "b"), ("undo", None), ("undo", None), ("redo", None), ("undo", None), ("save", "c"), ("redo", None)])]
    r = review.snapshot_stack(spark.createDataFrame(ops, "k int, pos int, op string, value string"), "k").first()
    assert (r.value, r.past, r.future) == ("c", 2, 0)
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    q = spark.createDataFrame([(1, "x", "confirmed", True), (2, "y", "confirmed", True), (3, "z", "confirmed", False), (4, "w", "no", True)], "k int, v string, decision string, readable boolean")
    new, out = review.promoted(q, base, "k")
    assert {r.k: r.v for r in new.collect()} == {1: "a", 2: "y"} and {r.k: r.reason for r in out.collect()} == {3: "unreadable", 4: "refused"}
    rows = spark.createDataFrame([("a", float(i)) for i in range(100)], "c string, v double")
    assert sorted(r.v for r in review.outside_bounds(rows, review.bounds_by_class(rows, "c", "v", 0.02, 0.98), "c", "v").collect()) == [0.0, 1.0, 98.0, 99.0]


def test_markup(spark):
    fixed = markup.repair('<p class=a class=b>x<p>y & <b>z</i><br>')
    assert fixed["html"] == '<p class="a">x</p><p>y &amp; <b>z<br/></b></p>'
    assert [c["what"] for c in fixed["changes"]] == ["repeated class", "unclosed <p>", "stray </i>", "unclosed <b>", "unclosed <p>"]
    assert one(spark, markup.repaired(F.lit("<i>a")))["html"] == "<i>a</i>"
    out = one(spark, markup.cleaned(F.lit('<p class="MsoNormal x"><span>a<span> </span></span></p>')))
    assert out.html == '<p class="x">a</p>' and out.report == {"classes": 1, "empty spans": 1, "plain spans": 1}
    rules = one(spark, markup.css_rules(F.lit("/* c */ p, .a { color: red ; margin:0 } .a{color:blue}")))
    assert [(r.selector, r.name, r.value, r.order) for r in rules] == [("p", "color", "red", 0), ("p", "margin", "0", 0), (".a", "color", "red", 0), (".a", "margin", "0", 0), (".a", "color", "blue", 1)]
    fields = F.create_map(F.lit("b"), F.lit('x"&'), F.lit("a"), F.lit("1"))
    text = one(spark, markup.data_attributes(fields))
    assert text == 'data-a="1" data-b="x&quot;&amp;"' and one(spark, markup.from_data_attributes(F.lit(text))) == {"a": "1", "b": 'x"&'}
    assert one(spark, markup.applied_clip(F.lit("<b>$0</b>$1$2"), F.lit("s"), F.array(F.lit("g")))) == "<b>s</b>g"
    runs = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(f).alias("fmt")) for t, f in (("abc", "r"), ("def", "b"), ("ghi", "r"))))
    change = lambda a, b, new: [(r.text, r.fmt) for r in one(spark, markup.replaced_in_runs(runs, F.lit(a), F.lit(b), F.lit(new)))]
    assert change(2, 7, "X") == [("abX", "r"), ("hi", "r")] and change(3, 6, "Y") == [("abc", "r"), ("Y", "b"), ("ghi", "r")] and change(1, 1, "Z") == [("aZbc", "r"), ("def", "b"), ("ghi", "r")]

from pyspark.sql import functions as F

from folioscope.functions import notation as N
from folioscope.operators import pages as P
from folioscope.sources.readers import PAGE

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def test_page_and_corpus_metrics(spark):
    kind = "struct<" + PAGE.replace(" ", ":", 1).replace(", ", ",").replace(",lines ", ",lines:").replace(",paragraphs ", ",paragraphs:").replace(",regions ", ",regions:").replace(",boxes ", ",boxes:").replace(",diagrams ", ",diagrams:").replace(",notation ", ",notation:") + ">"
    page = lambda text, lines=None, regions=None, fens=None, moves=None: (text, lines, None, regions, None, fens and [(f,) for f in fens], moves)
    rows = [
        (1, page("Casa azul.", ["a", "b"], [("body", 0), ("table", 1)], [START, START], ["1.e4 e5"]), page("Casa  aznl.", ["a"], [("body", 0)], [START.replace("KQkq - 0 1", "- - 5 9")], ["1.e4 e6"])),
        (2, page(""), page("x", ["q"])),
    ]
    df = spark.createDataFrame(rows, f"page int, ref {kind}, pred {kind}")
    out = {r.page: r for r in P.page_metrics(df).collect()}
    assert (out[1].text.errors, out[1].text.total, out[1].words.errors, out[1].words.total) == (1, 10, 1, 3)
    assert (out[1].lines.errors, out[1].lines.exact, out[1].layout.right, out[1].layout.order) == (1, 0.0, 1, False)
    assert (out[1].diagrams.exact, out[1].diagrams.legal, out[1].diagrams.missing, out[1].notation.exact, out[1].notation.legal) == (1, 1, 1, 0, 1)
    assert out[2].lines is None and out[2].layout is None and out[2].text.errors == 1
    total = P.corpus_metrics(P.page_metrics(df)).first()
    assert (total.pages, total.cer, total.layout_types, total.layout_order, total.diagrams_exact, total.diagrams_legal) == (2, 0.2, 50.0, False, 0.5, 1.0)
    limits = spark.createDataFrame([("diagrams_exact", 0.6), ("cer", 0.1), ("absent", 0.0)], "metric string, limit double")
    assert {r.metric for r in P.gated(P.corpus_metrics(P.page_metrics(df)), limits, "diagrams_exact", "cer").collect()} == {"diagrams_exact", "absent"}


def test_reports(spark):
    d = spark.createDataFrame([("a", None, False, "x"), ("b", START, True, " "), ("c", START.split()[0], False, "l")], "id string, fen string, review boolean, legend string")
    assert {(r.id, r.problem) for r in P.diagram_report(d).collect()} == {("a", "no position"), ("b", "needs review"), ("b", "no legend"), ("c", "side unknown")}
    b = spark.createDataFrame([("x", "heading", []), ("x", "list", ["w"])], "doc string, kind string, warnings array<string>")
    r = P.conversion_report(b, "doc").first()
    assert (r.heading, r.list, r.figure, r.with_warnings) == (1, 1, 0, 1)


def test_repairs(spark):
    lex = spark.createDataFrame([("modern",), ("knight",), ("burn",)], "word string")
    aligned = spark.createDataFrame([(1, "kniqht", "knight,"), (2, "knight", "modern"), (3, "zzz", "yyy"), (4, "x", None)], "k int, ref string, pred string")
    assert [(r.word, r.repaired) for r in P.repaired_words(aligned, lex).orderBy("k").collect()] == [("knight,", True), ("knight", False), ("zzz", False), ("x", False)]
    words = spark.createDataFrame([("rnodern",), ("bum",), ("knight",), ("rnrn",)], "word string")
    confusions = spark.createDataFrame([("rn", "m"), ("m", "rn")], "read string, meant string")
    assert {r.word: r.to for r in P.joined_letters(words, lex, confusions).collect()} == {"rnodern": "modern", "bum": "burn"}


def test_small_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [r.char for r in P.character_names(spark, "white chess knight").collect()][:1] == ["♘"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "name string, pos int, pattern string")
    assert {r.name: r.pattern for r in P.saved_searches(rows).collect()} == {"a": "y", "b": "z"}
    box = spark.createDataFrame([(0.5, 0.0, 2.5, 3.0), (1.0, 1.0, 1.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [(r.area, r.valid) for r in box.select(*(c.alias(k) for k, c in P.box_geometry().items())).collect()] == [(6, True), (0, False)]
    s = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("t"))
    assert one(P.equal_without(s(1, "a"), s(2, "a"), "id")) and not one(P.equal_without(s(1, "a"), s(1, "b"), "id"))
    blocks = spark.createDataFrame([("c1", 0, ["n1"]), ("c1", 1, ["n2"])], "chapter string, pos int, refs array<string>")
    notes = spark.createDataFrame([("n1", "c1"), ("n2", "c1"), ("n3", "c1")], "note string, chapter string")
    moved, kept = P.split_with_notes(blocks, notes, 1, "c2")
    assert [r.chapter for r in moved.orderBy("pos").collect()] == ["c1", "c2"] and {r.note: r.chapter for r in kept.collect()} == {"n1": "c1", "n2": "c2", "n3": "c1"}
    lex = spark.range(1).select(F.explode(N.lexemes(F.lit("1.e4! $1 e5?! 2.Nf3 $14 *"))).alias("x")).select("x.*")
    assert [(r.code, r.sign, r.n) for r in P.nag_counts(lex).collect()] == [(1, "!", 2), (6, "?!", 1), (14, "⩲", 1)]

    def read(item):
        return item.upper(), len(item)

    out = spark.createDataFrame([("ab",), (None,)], "t string").select(P.recogniser(read)("t").alias("r")).collect()
    assert (out[0].r.text, out[0].r.confidence, out[0].r.error) == ("AB", 1.0, None) and out[1].r.text is None and "AttributeError" in out[1].r.error

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.sources import readers, writers


def test_pages_and_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "x", "lines": ["l"], "boxes": [{"char": "c", "x1": 1}]}))
    (tmp_path / "b.txt").write_text("plain\ntext")
    out = {r.path.rsplit("/", 1)[1]: r.page for r in readers.pages(spark, str(tmp_path)).collect()}
    assert out["a.json"].lines == ["l"] and out["a.json"].boxes[0].char == "c" and out["b.txt"].text == "plain\ntext" and out["b.txt"].lines is None
    m = {"name": "n", "documents": [{"id": "d", "language": "en", "split": "holdout", "pages": [{"id": "p1", "page_index": 3, "predictions": {"e": "f.txt"}}, {"id": "p2"}]}, {"id": "e", "pages": []}]}
    path = tmp_path / "m"
    path.mkdir()
    (path / "m.json").write_text(json.dumps(m))
    rows = readers.corpus_pages(spark, str(path)).orderBy("page_pos").collect()
    assert [(r.document_id, r.page_id, r.split) for r in rows] == [("d", "p1", "holdout"), ("d", "p2", "holdout")] and rows[0].predictions == {"e": "f.txt"}
    (path / "m.json").write_text(json.dumps(m | {"documents": [{"id": "d", "split": "odd", "pages": [{"id": "p"}]}]}))
    with pytest.raises(Exception, match="unknown split"):
        readers.corpus_pages(spark, str(path)).collect()
    (path / "m.json").write_text("[1, 2")
    with pytest.raises(Exception):  # noqa: B017
        readers.json_objects(spark, str(path), readers.PAIRS).collect()


def test_glyph_boxes(spark, tmp_path):
    (tmp_path / "p.box").write_text("a 1 2 3 4 0\n\\~ 1 2 3 4 0 90 1\n~ 5 6 7 8 1\nbroken\n")
    rows = readers.glyph_boxes(spark, str(tmp_path), height=10).orderBy("pos").collect()
    assert [(r.char, r.x1, r.y1, r.x2, r.y2, r.page) for r in rows] == [("a", 1, 6, 3, 8, 0), ("~", 1, 6, 3, 8, 0), ("", 5, 2, 7, 4, 1)]
    assert rows[1].angle == 90 and rows[1].negative and rows[0].angle is None


def test_lists_and_lexica(spark, tmp_path):
    (tmp_path / "gt.tsv").write_text('a.png\tsome "text\tmore\nbroken\nb.png\t\n')
    rows = readers.labelled_list(spark, str(tmp_path / "gt.tsv")).collect()
    assert [(r.path, r.text) for r in rows] == [("a.png", 'some "text\tmore'), ("b.png", "")]
    have = spark.createDataFrame([("b.png",)], "path string")
    assert readers.labelled_list(spark, str(tmp_path / "gt.tsv"), have).count() == 1
    with gzip.open(tmp_path / "w.txt.gz", "wt") as f:
        f.write("Word 12\nother\n\nword\n")
    assert {r.word for r in readers.word_list(spark, str(tmp_path / "w.txt.gz")).collect()} == {"word", "other"}
    (tmp_path / "x.aff").write_text("SFX S Y 2\nSFX S y ies [^aeiou]y\nSFX S 0 s/Q .\nPFX U 0 un .\n")
    assert {(r.kind, r.flag, r.strip, r.add) for r in readers.affix_rules(spark, str(tmp_path / "x.aff")).collect()} == {("suffix", "S", "y", "ies"), ("suffix", "S", "", "s"), ("prefix", "U", "", "un")}
    (tmp_path / "x.dic").write_text("2\ncity/SU\nplay\n")
    assert {(r.root, r.flag) for r in readers.affix_roots(spark, str(tmp_path / "x.dic")).collect()} == {("city", "S"), ("city", "U")}


def test_journal_round_trip(spark, tmp_path):
    event = {"event_id": "e1", "document_id": "d", "target_id": "t", "after": '"x"', "reason_codes": ["undo"], "created_at": "2024-01-01T00:00:00+00:00"}
    (tmp_path / "j.jsonl").write_text(json.dumps(event) + "\n" + json.dumps(event | {"event_id": "e2"}) + "\n")
    assert [r.event_id for r in readers.journal(spark, str(tmp_path / "j.jsonl")).orderBy("event_id").collect()] == ["e1", "e2"]
    df = spark.createDataFrame([(1, "a", None)], "b int, a string, c string")
    assert df.select(writers.canonical_json(df).alias("j")).first().j == '{"a":"a","b":1,"c":null}'
    writers.write_manifest(df, str(tmp_path / "out"))
    assert len(spark.read.json(str(tmp_path / "out")).first().digest) == 64
    writers.write_report(df, str(tmp_path / "rep"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "rep")).collect()).startswith("{")


def test_text_and_html_blocks(spark):
    text = "INTRO\n\nFirst line\nsecond.\n \n- item\n\n| a | b |\n\n[^1]: note"
    df = spark.createDataFrame([(1, text), (2, None)], "k int, text string")
    assert [r.kind for r in readers.text_blocks(df, "k").orderBy("pos").collect()] == ["heading", "paragraph", "list", "table", "note"]
    page = spark.createDataFrame([(1, "<h2>T &amp; x</h2><p>a<br>b <b>c</b><ul><li>i</ul><script>no</script>tail"), (2, None)], "k int, html string")
    rows = readers.html_blocks(page, "k").orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 2, "T & x"), ("paragraph", None, "a b c"), ("list", None, "i"), ("paragraph", None, "tail")]
    html = writers.exported(readers.html_blocks(page, "k"), "k", "html").first().value
    assert "<h2>T &amp; x</h2>" in html and "<li>i</li>" in html
    assert writers.exported(readers.html_blocks(page, "k"), "k", "text").first().value.startswith("## T & x\n\na b c\n\n- i")
    with pytest.raises(ValueError):
        writers.exported(page, "k", "odd")


def test_epub_round_trip(spark, tmp_path):
    chapters = spark.createDataFrame([("book", 1, "One", "<p>1</p>"), ("book", 0, "Zero", "<p>0</p>")], "book string, pos int, title string, html string")
    data = writers.epub_files(chapters, "book").first().content
    (tmp_path / "b.epub").write_bytes(bytes(data))
    found = readers.epub_chapters(spark, str(tmp_path)).orderBy("spine").collect()
    assert ["<p>0</p>" in found[0].html, "<p>1</p>" in found[1].html, len(found)] == [True, True, 2]
    assert readers.epub_problems(readers.epub_resources(spark, str(tmp_path))).count() == 0
    with zipfile.ZipFile(tmp_path / "b.epub", "a") as z:
        z.writestr("stray.txt", "x")
    assert readers.epub_problems(readers.epub_resources(spark, str(tmp_path))).first().problem == "unlisted entries"


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda style, text: f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p('<w:pStyle w:val="Heading1"/>', "Head") + p('<w:numPr><w:numId w:val="1"/></w:numPr>', "item") + p("", "para") + p("", " ")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    rows = readers.docx_blocks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 1, "Head"), ("list", None, "item"), ("paragraph", None, "para")]


def test_games(spark, tmp_path):
    (tmp_path / "g.pgn").write_text('[Event "E"]\n[White "A"]\n\n1. e4 (1. d4) e5 1-0\n\n[Event "F"]\n\n1. c4 *\n')
    rows = readers.games(spark, str(tmp_path)).orderBy("game").collect()
    assert [r.tags["Event"] for r in rows] == ["E", "F"] and [x.text for x in rows[0].lexemes][:2] == ["1.", "e4"]


def test_page_ranges(spark):
    cases = {"1-3, 5; 8": [1, 2, 3, 5, 8], "3 3 1": [1, 3], "5-2": None, "0": None, "11": None, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", readers.page_numbers(F.col("t"), F.lit(10)).alias("p")).collect()} == cases
    assert spark.range(1).select(readers.page_ranges(F.array(*map(F.lit, [1, 2, 3, 5, 8, 9]))).alias("r")).first().r == "1-3,5,8-9"


def test_pdf_syntax():
    """Strings with escapes, arrays with steps, Unicode maps, compressed objects, inherited resources; broken and encrypted files."""
    import zlib

    from folioscope.sources.pdf import Pdf

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    content = b"BT /F1 10 Tf 5 700 Td [(Hel) 20 (lo) -300 (w\\157rld \\(x\\))] TJ 0 -12 TD (next) Tj T* (third) Tj /F2 8 Tf 1 0 0 1 50 60 Tm <000300100012> Tj ET"
    packed = b"6 0 7 45 " + b"<< /Type /Pages /Kids [4 0 R] /Resources 7 0 R >>".ljust(45) + b"<< /Font << /F1 8 0 R /F2 9 0 R >> >>"
    first = packed.index(b"<<")
    packed = (b"6 0 7 %d " % (packed.index(b"<< /Font") - first)).ljust(first) + packed[first:]
    stream = lambda body, more=b"": b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), more, body)
    objects = {
        1: b"<< /Type /Catalog /Pages 6 0 R >>", 4: b"<< /Type /Page /Contents [5 0 R] >>", 5: stream(zlib.compress(content), b"/Filter /FlateDecode"),
        8: b"<< /Type /Font >>", 9: b"<< /Type /Font /ToUnicode 10 0 R >>", 10: stream(cmap), 11: stream(zlib.compress(packed), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % first),
    }
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer << /Root 1 0 R >>"
    pdf = Pdf(data)
    (page,) = pdf.pages()
    assert [(x, y, t) for x, y, _, t in pdf.texts(page)] == [(5, 700, "Hello world (x)"), (5, 688, "next"), (5, 676, "third"), (50, 60, "éAC")]
    assert not list(Pdf(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 2 0 R")).pages())
    for broken in (b"", b"%PDF-1.4 nothing", data[:200], data.replace(b"endstream", b"")):
        assert all(isinstance(t, tuple) for p in Pdf(broken).pages() for t in Pdf(broken).texts(p))

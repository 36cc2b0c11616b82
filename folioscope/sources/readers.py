"""Readers: manifests, pages, glyph boxes, journals, lists, text, HTML, EPUB, DOCX, word lists, affix rules, games.

All input goes through Spark's readers, so any file system of the session works. Zip containers are opened in Arrow
batches, one file per row; a container must fit in memory.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import notation

PAGE = "text string, lines array<string>, paragraphs array<string>, regions array<struct<type:string,order:int>>, boxes array<struct<char:string,x1:double,y1:double,x2:double,y2:double>>, diagrams array<struct<fen:string>>, notation array<string>"
CORPUS = (
    "schema string, name string, version string, documents array<struct<id:string,title:string,language:string,source_kind:string,source:string,split:string,metadata:map<string,string>,"
    "pages:array<struct<id:string,page_index:int,image:string,reference:string,pdf_text:string,predictions:map<string,string>,domains:array<string>,metadata:map<string,string>>>>>"
)
PAIRS = "name string, version string, pages array<struct<id:string,image:string,reference:string,prediction:string,document:string,split:string,difficulty:string>>"
EVENT = (
    "event_id string, document_id string, page_id string, target_id string, before string, after string, status string, reason_codes array<string>, user string, created_at string, "
    "model_version string, source_refs array<string>, before_status string"
)
SAMPLE = "text string, image string, source string, metadata map<string,string>"
SPLITS = ("train", "validation", "test", "holdout", "unsplit")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per file; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path and page: .json files are page objects, others a page of their text."""
    body = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    parsed = F.from_json("value", PAGE, {"mode": "FAILFAST"})
    plain = F.from_json(F.to_json(F.struct(F.col("value").alias("text"))), PAGE)
    return body.select("path", F.when(F.col("path").endswith(".json"), parsed).otherwise(plain).alias("page"))


def corpus_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of a corpus manifest, in order, with a check of the split."""
    docs = json_objects(spark, path, CORPUS).select("name", F.posexplode("documents").alias("doc_pos", "d"))
    rows = docs.select("name", "doc_pos", F.col("d.id").alias("document_id"), "d.language", "d.split", F.posexplode("d.pages").alias("page_pos", "p"))
    known = F.coalesce(F.col("split"), F.lit("unsplit"))
    checked = F.when(known.isin(*SPLITS), known).otherwise(F.raise_error(F.concat(F.lit("unknown split "), known)).cast("string"))
    return rows.select("name", "doc_pos", "document_id", "language", checked.alias("split"), "page_pos", F.col("p.id").alias("page_id"), "p.page_index", "p.reference", "p.predictions", "p.domains", "p.metadata")


def page_pairs(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark, path, PAIRS).select("name", F.posexplode("pages").alias("pos", "p")).select("name", "pos", "p.*")


def glyph_boxes(spark: SparkSession, path: str, height: int | None = None) -> DataFrame:
    """path, pos, char, x1, y1, x2, y2, page, angle, negative. With a height, y is turned to count from the top.

    ``char x1 y1 x2 y2 page [angle [negative]]``; a backslash escapes a character, a lone tilde is an empty one.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    p = F.split(F.col("value"), " ")
    char = F.when(p[0] == "~", "").when(F.length(p[0]) > 1, F.regexp_replace(p[0], r"\\(.)", "$1")).otherwise(p[0])
    n = lambda i: F.get(p, F.lit(i)).cast("int")
    low, high = (n(2), n(4)) if height is None else (F.lit(height) - n(4), F.lit(height) - n(2))
    rows = whole.where(F.size(p) >= 6)
    return rows.select("path", "pos", char.alias("char"), n(1).alias("x1"), low.alias("y1"), n(3).alias("x2"), high.alias("y2"), n(5).alias("page"), F.get(p, F.lit(6)).cast("double").alias("angle"), (F.get(p, F.lit(7)) == "1").alias("negative"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Review events of a journal (JSON lines)."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).json(path)


def labelled_list(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """path TAB text lines; malformed ones are skipped, and with ``existing`` (path) those without a file too."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("path"), parts[1].alias("text"))
    return rows if existing is None else rows.join(existing.select("path"), "path", "left_semi")


def text_blocks(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, kind, text of plain text: blank-line paragraphs, list items, pipe tables, notes and headings."""
    block = F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("pos", "text")
    shape = lambda p: F.col("text").rlike(p)
    kind = (
        F.when(shape(r"^\s*[-*•]\s+\S") | shape(r"^\s*\d+[.)]\s+\S"), "list").when(shape(r"^\s*\|.*\|\s*$"), "table").when(shape(r"^\[\^?\w+\]:?\s"), "note")
        .when(shape(r"^#{1,6}\s") | (shape(r"^[^\n]{1,60}$") & (F.upper("text") == F.col("text")) & shape(r"\p{L}")), "heading").otherwise("paragraph")
    )
    return rows.select(key, block).where(F.trim("text") != "").select(key, "pos", kind.alias("kind"), "text")


class _Blocks(HTMLParser):
    """Blocks of a chapter: (kind, text) of headings, paragraphs, items, cells and quotes."""

    KINDS = {"p": "paragraph", "li": "list", "td": "table", "th": "table", "blockquote": "quote", "pre": "code", "figcaption": "caption", **{f"h{i}": "heading" for i in range(1, 7)}}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, int | None, str]] = []
        self.kind, self.level, self.parts, self.skip = "paragraph", None, [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.kind, self.level, text))
        self.parts, self.kind, self.level = [], "paragraph", None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "title")
        if tag in self.KINDS or tag in ("div", "section", "article", "ul", "ol", "table", "tr"):
            self.flush()
            self.kind = self.KINDS.get(tag, "paragraph")
            self.level = int(tag[1]) if self.kind == "heading" else None
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "title") and self.skip > 0
        if tag in self.KINDS or tag in ("div", "section", "article", "ul", "ol", "table", "tr"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def blocks_of_html(markup: str | None) -> list[tuple[str, int | None, str]]:
    parser = _Blocks()
    parser.feed(markup or "")
    parser.close()
    parser.flush()
    return parser.out


def html_blocks(rows: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, kind, level, text of the blocks of every chapter, in Arrow batches."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, *block) for k, markup in zip(b[key], b[html], strict=True) for i, block in enumerate(blocks_of_html(markup))]
            yield pd.DataFrame(out, columns=[key, "pos", "kind", "level", "text"]).astype({"level": "Int32"})

    return rows.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, kind string, level int, text string")


def _epub(data: bytes) -> Iterator[tuple[str, int | None, str, bytes]]:
    """name, place in the spine, media type and bytes of every entry."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        items = {e.attrib["id"]: (f"{base}/{e.attrib['href']}".lstrip("/"), e.attrib.get("media-type", "")) for e in package.iter() if e.tag.endswith("}item")}
        spine = {items[e.attrib["idref"]][0]: i for i, e in enumerate(e for e in package.iter() if e.tag.endswith("}itemref")) if e.attrib["idref"] in items}
        media = {name: kind for name, kind in items.values()}
        for name in z.namelist():
            if not name.endswith("/"):
                yield name, spine.get(name), media.get(name, ""), z.read(name)


def _docx(data: bytes) -> Iterator[tuple[str, int | None, str]]:
    """kind, level and text of the paragraphs of a document."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for p in body.iter(f"{w}p"):
        text = "".join((t.text or "") if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" if t.tag == f"{w}br" else "" for t in p.iter())
        style = next((s.attrib.get(f"{w}val", "") for s in p.iter(f"{w}pStyle")), "")
        level = re.fullmatch(r"(?:Heading|Ttulo|Título|berschrift|Titre)\s?(\d)", style)
        kind = "heading" if level else "list" if next(p.iter(f"{w}numPr"), None) is not None else "paragraph"
        if text.strip():
            yield kind, int(level[1]) if level else None, text


def epub_resources(spark: SparkSession, path: str) -> DataFrame:
    """path, name, spine (place or null), media, content of every entry of EPUB files."""
    return epub_entries(spark.read.format("binaryFile").load(path).select("path", "content"))


def epub_entries(files: DataFrame) -> DataFrame:
    """``epub_resources`` of rows path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *e) for e in _epub(data)], columns=["path", "name", "spine", "media", "content"]).astype({"spine": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, name string, spine int, media string, content binary")


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """path, name, spine, html of the chapters."""
    return epub_resources(spark, path).where("spine is not null").select("path", "name", "spine", F.decode("content", "UTF-8").alias("html"))


def epub_problems(resources: DataFrame) -> DataFrame:
    """Files without the mimetype entry first, without chapters or with entries that no manifest lists."""
    by = resources.groupBy("path").agg(F.max((F.col("name") == "mimetype").cast("int")).alias("m"), F.count("spine").alias("c"), F.sum(((F.col("media") == "") & ~F.col("name").rlike("^(mimetype|META-INF/.*|.*\\.opf)$")).cast("int")).alias("u"))
    found = F.array_compact(F.array(F.when(F.col("m") == 0, "no mimetype"), F.when(F.col("c") == 0, "empty spine"), F.when(F.col("u") > 0, "unlisted entries")))
    return by.select("path", F.explode(found).alias("problem"))


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, kind, level, text of the paragraphs of DOCX files."""
    return docx_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def docx_rows(files: DataFrame) -> DataFrame:
    """``docx_blocks`` of rows path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, i, *e) for i, e in enumerate(_docx(data))], columns=["path", "pos", "kind", "level", "text"]).astype({"level": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, pos int, kind string, level int, text string")


def trace(spark: SparkSession, path: str) -> DataFrame:
    """stage, at and metrics (map of texts) of the runs traced in a folder."""
    return spark.read.schema("stage string, at timestamp, metrics map<string,string>").json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: one per line, gzip or not, a count or flags after white space or a slash left out."""
    word = F.lower(F.trim(F.regexp_extract("value", r"^\s*([^\s/#]+)", 1)))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def affix_rules(spark: SparkSession, path: str) -> DataFrame:
    """kind (prefix or suffix), flag, strip, add, condition of an affix file."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^(SFX|PFX)\s+\S+\s+\S+\s+\S+\s+\S+"))
    blank = lambda c: F.when(c == "0", "").otherwise(F.split(c, "/")[0])
    return rows.select(F.when(p[0] == "SFX", "suffix").otherwise("prefix").alias("kind"), p[1].alias("flag"), blank(p[2]).alias("strip"), blank(p[3]).alias("add"), p[4].alias("condition"))


def affix_roots(spark: SparkSession, path: str) -> DataFrame:
    """root and flag (one row each) of a dictionary of roots."""
    p = F.split(F.trim("value"), "/")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^[^\d\s]"))
    flags = F.explode(F.split(F.coalesce(F.get(p, F.lit(1)), F.lit("")), ""))
    return rows.select(p[0].alias("root"), flags.alias("flag")).where("flag <> ''")


def games(spark: SparkSession, path: str) -> DataFrame:
    """path, game, tags and lexemes of the games of PGN files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"(?m)(?=^\[Event )")).alias("game", "text"))
    some = whole.where(F.trim("text") != "")
    moves = F.regexp_replace("text", r'(?m)^\[\w+\s+"[^"]*"\]\s*', "")
    return some.select("path", "game", notation.pgn_tags(F.col("text")).alias("tags"), notation.lexemes(moves).alias("lexemes"))


def page_numbers(ranges: Column, total: Column) -> Column:
    """Sorted unique pages of ``1-3, 5; 8``: null if a part is malformed, reversed or out of range."""
    parts = F.filter(F.split(F.trim(ranges), r"[,;\s]+"), lambda p: p != "")
    low, high = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), lambda p: F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
    good = F.forall(parts, lambda p: p.rlike(r"^\d+(-\d+)?$") & (low(p) >= 1) & (low(p) <= high(p)) & (high(p) <= total))
    return F.when(good & (F.size(parts) > 0), F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def page_ranges(pages_: Column) -> Column:
    """The inverse: runs of consecutive pages as ``a-b``."""
    runs = F.aggregate(
        F.array_sort(pages_), F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] + 1 == p), F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.element_at(acc, -1)["a"].alias("a"), p.alias("b")))).otherwise(F.array_append(acc, F.struct(p.alias("a"), p.alias("b")))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))), ",")

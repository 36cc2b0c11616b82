"""Writers: JSON, manifests with digests, reports, HTML, text, games, EPUB. Rows are written by the executors."""

from __future__ import annotations

import html as html_
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with its fields in the order of their names."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def digest(df: DataFrame) -> Column:
    return F.sha2(canonical_json(df), 256)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with a digest of each."""
    rows.withColumn("digest", digest(rows)).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def in_order(blocks: DataFrame, doc: str, make: Column, separator: str) -> DataFrame:
    """One row per document: its blocks made to text and joined in order of ``pos``."""
    rows = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", make.alias("t")))).alias("b"))
    return rows.select(doc, F.array_join(F.transform("b", lambda x: x["t"]), separator).alias("value"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_block() -> Column:
    """Of columns kind, level, text."""
    t, tag = _escaped(F.col("text")), F.concat(F.lit("h"), F.coalesce(F.col("level"), F.lit(2)).cast("string"))
    wrap = lambda name: F.concat(F.lit(f"<{name}>"), t, F.lit(f"</{name}>"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<"), tag, F.lit(">"), t, F.lit("</"), tag, F.lit(">")))
        .when(F.col("kind") == "list", wrap("li")).when(F.col("kind") == "quote", wrap("blockquote")).when(F.col("kind") == "code", wrap("pre")).otherwise(wrap("p"))
    )


def text_block() -> Column:
    return F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(2))), F.lit(" "), F.col("text"))).when(F.col("kind") == "list", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))


def exported(blocks: DataFrame, doc: str, form: str, mode: str = "clean") -> DataFrame:
    """Documents of ordered blocks (pos, kind, level, text) in a format: html or text.

    ``faithful`` keeps headers, footers and page breaks, ``clean`` leaves them out.
    """
    if form not in ("html", "text"):
        raise ValueError(f"unknown format {form}")
    rows = blocks if mode == "faithful" else blocks.where(~F.col("kind").isin("header", "footer", "page_break"))
    if form == "html":
        whole = in_order(rows, doc, html_block(), "\n")
        return whole.withColumn("value", F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), "value", F.lit("\n</body></html>\n")))
    return in_order(rows, doc, text_block(), "\n\n")


def traced(rows: DataFrame, path: str, stage: str, /, **metrics: Column) -> None:
    """Runs over ``rows`` and appends one line with the observed metrics of this stage to the trace in a folder."""
    seen = Observation()
    rows.observe(seen, *(m.alias(k) for k, m in metrics.items())).write.format("noop").mode("overwrite").save()
    found = {k: str(v) for k, v in seen.get.items()}
    line = rows.sparkSession.range(1).select(F.lit(stage).alias("stage"), F.current_timestamp().alias("at"), F.create_map(*(F.lit(x) for kv in found.items() for x in kv)).alias("metrics"))
    line.coalesce(1).write.mode("append").json(path)


def epub_files(chapters: DataFrame, book: str) -> DataFrame:
    """book and content: an EPUB file of each book's chapters (pos, title, html), with its navigation. A book must fit one task.

    The chapters may hold pictures as data; a column ``css`` of the first chapter that has one becomes the style sheet.
    """
    kind = dict(chapters.dtypes)[book]
    styled = "css" in chapters.columns

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        rows = rows.sort_values("pos")
        names, titles = [f"c{i}.xhtml" for i in range(len(rows))], [html_.escape(t) for t in rows["title"].fillna("")]
        css = next((c for c in rows["css"] if isinstance(c, str) and c), "") if styled else ""
        title = html_.escape(str(key[0]))
        listed = [(f"i{i}", n, "application/xhtml+xml", "") for i, n in enumerate(names)]
        listed += [("nav", "nav.xhtml", "application/xhtml+xml", ' properties="nav"'), ("ncx", "toc.ncx", "application/x-dtbncx+xml", "")]
        listed += [("css", "style.css", "text/css", "")] if css else []
        items = "".join(f'<item id="{i}" href="{n}" media-type="{m}"{more}/>' for i, n, m, more in listed)
        spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(names)))
        links = "".join(f'<li><a href="{n}">{t}</a></li>' for n, t in zip(names, titles, strict=True))
        points = "".join(f'<navPoint id="p{i}" playOrder="{i + 1}"><navLabel><text>{t}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, t) in enumerate(zip(names, titles, strict=True)))
        head = '<link rel="stylesheet" type="text/css" href="style.css"/>' if css else ""
        with zipfile.ZipFile(out, "w") as z:
            entry = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name), data, how)  # noqa: E731  fixed dates
            entry("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
            entry("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
            entry("book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{title}</dc:identifier><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine toc="ncx">{spine}</spine></package>')
            entry("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
            entry("toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{title}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>')
            if css:
                entry("style.css", css)
            for n, t, body in zip(names, titles, rows["html"].fillna(""), strict=True):
                entry(n, f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{t}</title>{head}</head><body>{body}</body></html>')
        return pd.DataFrame([(key[0], out.getvalue())], columns=[book, "content"])

    return chapters.groupBy(book).applyInPandas(run, f"{book} {kind}, content binary")


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx_paragraph(kind: str, level: int | None, text: str) -> str:
    parts = html_.escape(text, quote=False).replace("\t", "</w:t><w:tab/><w:t xml:space=\"preserve\">").replace("\n", "</w:t><w:br/><w:t xml:space=\"preserve\">")
    style = f'<w:pStyle w:val="Heading{level or 1}"/>' if kind == "heading" else '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' if kind == "list" else '<w:pStyle w:val="Quote"/>' if kind == "quote" else ""
    return f'<w:p>{f"<w:pPr>{style}</w:pPr>" if style else ""}<w:r><w:t xml:space="preserve">{parts}</w:t></w:r></w:p>'


def docx_files(blocks: DataFrame, doc: str) -> DataFrame:
    """doc and content: a DOCX file of each document's blocks (pos, kind, level, text); neighbouring table blocks are one table.

    A table block's text has its cells parted by bars. A document must fit one task.
    """
    kind = dict(blocks.dtypes)[doc]
    types = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 7))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body, table = [], []

        def close() -> None:
            if table:
                body.append(f"<w:tbl>{''.join(table)}</w:tbl>")
                table.clear()

        for k, level, text in rows.sort_values("pos")[["kind", "level", "text"]].itertuples(index=False):
            if k == "table":
                cells = [c.strip() for c in (text or "").strip().strip("|").split("|")]
                table.append(f"<w:tr>{''.join(f'<w:tc>{_docx_paragraph("paragraph", None, c)}</w:tc>' for c in cells)}</w:tr>")
                continue
            close()
            body.append(_docx_paragraph(k, None if pd.isna(level) else int(level), text or ""))
        close()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            entry = lambda name, data: z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + data, zipfile.ZIP_DEFLATED)  # noqa: E731  fixed dates
            entry("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{types}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{types}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{types}.numbering+xml"/></Types>')
            relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            entry("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="word/document.xml"/></Relationships>')
            entry("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/styles" Target="styles.xml"/><Relationship Id="r2" Type="{relation}/numbering" Target="numbering.xml"/></Relationships>')
            entry("word/styles.xml", f'<w:styles xmlns:w="{_WORD}">{headings}<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/></w:style></w:styles>')
            entry("word/numbering.xml", f'<w:numbering xmlns:w="{_WORD}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
            entry("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>')
        return pd.DataFrame([(key[0], out.getvalue())], columns=[doc, "content"])

    return blocks.select(doc, "pos", "kind", "level", "text").groupBy(doc).applyInPandas(run, f"{doc} {kind}, content binary")

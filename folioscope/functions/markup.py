"""Markup helpers in Arrow batches: cleanup, repair, style sheets; codecs of attributes and snippets."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Repair(HTMLParser):
    """Writes well-formed markup and notes what it changed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.changes: list[tuple[int, str]] = []

    def note(self, what: str) -> None:
        self.changes.append((self.getpos()[0], what))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and "p" in self.open:
            self.handle_endtag("p", noted="unclosed <p>")
        seen, parts = set(), []
        for k, v in attrs:
            if k in seen:
                self.note(f"repeated {k}")
                continue
            seen.add(k)
            if v is None:
                self.note(f"{k} without a value")
            parts.append(f' {k}="{escape(k if v is None else v)}"')
        self.out.append(f"<{tag}{''.join(parts)}{'/' if tag in VOID else ''}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str, noted: str | None = None) -> None:
        if tag in VOID or tag not in self.open:
            self.note(f"stray </{tag}>")
            return
        if noted:
            self.note(noted)
        while self.open:
            last = self.open.pop()
            self.out.append(f"</{last}>")
            if last == tag:
                return
            self.note(f"unclosed <{last}>")

    def handle_data(self, data: str) -> None:
        self.out.append(escape(data, quote=False))

    def finish(self) -> None:
        self.close()
        while self.open:
            self.note(f"unclosed <{self.open[-1]}>")
            self.out.append(f"</{self.open.pop()}>")


def repair(markup: str | None) -> dict:
    r = _Repair()
    r.feed(markup or "")
    r.finish()
    return {"html": "".join(r.out), "changes": [{"line": n, "what": w} for n, w in r.changes]}


_REPAIRED = StructType([StructField("html", StringType()), StructField("changes", ArrayType(StructType([StructField("line", IntegerType()), StructField("what", StringType())])))])


@F.pandas_udf(_REPAIRED)
def repaired(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(m) for m in markup], columns=["html", "changes"])


# Classes that word processors leave behind.
TOOL_CLASS = re.compile(r"^(Mso\w*|calibre\d*|sgc-\d+|Apple-\w[\w-]*|kindle-\w[\w-]*)$")


def clean(markup: str | None) -> dict:
    """Without tool classes, empty spans and spans that say nothing; what was taken out is counted."""
    report: dict[str, int] = {}

    def count(what: str, n: int = 1) -> None:
        report[what] = report.get(what, 0) + n

    def classes(m: re.Match) -> str:
        names = m[1].split()
        kept = [n for n in names if not TOOL_CLASS.match(n)]
        if len(kept) == len(names):
            return m[0]
        count("classes", len(names) - len(kept))
        return f' class="{" ".join(kept)}"' if kept else ""

    out = re.sub(r'\sclass="([^"]*)"', classes, markup or "")
    for pattern, what, new in ((r"<span[^>]*>\s*</span>", "empty spans", ""), (r"<span>((?:(?!</?span).)*)</span>", "plain spans", r"\1")):
        n = 1
        while n:
            out, n = re.subn(pattern, new, out, flags=re.S)
            if n:
                count(what, n)
    return {"html": out, "report": report}


@F.pandas_udf(StructType([StructField("html", StringType()), StructField("report", MapType(StringType(), IntegerType()))]))
def cleaned(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clean(m) for m in markup], columns=["html", "report"])


def css_rules(sheet: Column) -> Column:
    """array<struct<selector, name, value, order>>: declarations in order, comments left out, one row per selector."""
    bare = F.regexp_replace(sheet, r"(?s)/\*.*?\*/", "")
    blocks = F.filter(F.split(bare, r"\}"), lambda b: b.contains("{"))
    rule = lambda b, i: F.flatten(
        F.transform(
            F.split(F.split(b, r"\{")[0], ","),
            lambda s: F.transform(
                F.filter(F.split(F.split(b, r"\{")[1], ";"), lambda d: d.contains(":")),
                lambda d: F.struct(F.trim(F.regexp_replace(s, r"\s+", " ")).alias("selector"), F.trim(F.regexp_replace(F.split(d, ":", 2)[0], r"\s+", "")).alias("name"), F.trim(F.regexp_replace(F.split(d, ":", 2)[1], r"\s+", " ")).alias("value"), i.alias("order")),
            ),
        )
    )
    return F.flatten(F.transform(blocks, rule))


def specificity(selector: Column) -> Column:
    """2 for a class, 1 for an element."""
    return F.when(selector.contains("."), 2).otherwise(1)


def data_attributes(fields: Column) -> Column:
    """A map of fields as data attributes, sorted by name."""
    pairs = F.array_sort(F.map_entries(fields))
    quoted = lambda v: F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("data-"), e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), " ")


def from_data_attributes(text: Column) -> Column:
    """The map that ``data_attributes`` wrote."""
    names, values = (F.regexp_extract_all(text, F.lit(r'data-([\w-]+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(v, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    return F.map_from_arrays(names, plain)


def applied_clip(template: Column, selection: Column, groups: Column) -> Column:
    """A snippet with $0 for the selection and $1, $2, ... for groups (array); missing groups are empty."""
    filled = F.aggregate(F.sequence(F.lit(9), F.lit(1), F.lit(-1)), template, lambda acc, i: F.replace(acc, F.concat(F.lit("$"), i.cast("string")), F.coalesce(F.try_element_at(groups, i), F.lit(""))))
    return F.replace(filled, F.lit("$0"), selection)


def replaced_in_runs(runs: Column, start: Column, end: Column, new: Column) -> Column:
    """array<struct<text, fmt>> with characters [start, end) replaced; the new text takes the format of the first run hit."""
    before = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, r: a + F.length(r["text"]))
    first = F.coalesce(F.array_min(F.filter(F.transform(runs, lambda r, i: F.when((before(i) + F.length(r["text"]) > start) | (i == F.size(runs) - 1), i)), lambda x: x.isNotNull())), F.lit(0))

    def cut(r: Column, i: Column) -> Column:
        at, n = before(i), F.length(r["text"])
        head = F.substring(r["text"], F.lit(1), F.greatest(F.least(start - at, n), F.lit(0)))
        skip = F.greatest(F.least(end - at, n), F.lit(0))
        tail = F.substring(r["text"], skip + 1, n)
        middle = F.when(i == first, new).otherwise(F.lit(""))
        kept = F.when((at + n <= start) & (i != first), r["text"]).otherwise(F.concat(head, middle, tail))
        return F.struct(kept.alias("text"), r["fmt"].alias("fmt"))

    return F.filter(F.transform(runs, cut), lambda r: r["text"] != "")

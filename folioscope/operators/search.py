"""Search and replace, saved batches, typography proposals."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Search:
    """What to look for; plain text unless ``regex``."""

    pattern: str
    regex: bool = False
    ignore_case: bool = False
    whole_word: bool = False
    dot_all: bool = False
    replacement: str = ""

    def java(self) -> str:
        """The Java regular expression; white space of a plain text also stands for no-break spaces."""
        body = self.pattern if self.regex else "".join(r"[ \u00A0\u202F]" if c == " " else re.escape(c) if c in r"\.^$|?*+()[]{}" else c for c in self.pattern)
        if self.whole_word:
            body = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
        return f"(?m{'i' if self.ignore_case else ''}{'s' if self.dot_all else ''}{'u' if self.ignore_case else ''}){body}"

    def java_replacement(self) -> str:
        """Back-references only in regex mode (\\1 as $1), literal otherwise."""
        if self.regex:
            return re.sub(r"\\(\d)", r"$\1", self.replacement.replace("$", r"\$"))
        return self.replacement.replace("\\", "\\\\").replace("$", r"\$")


def count(text: Column, search: Search) -> Column:
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(search.java()), F.lit(0)), lambda m: m != ""))


def replaced(text: Column, search: Search) -> Column:
    return F.regexp_replace(text, F.lit(search.java()), F.lit(search.java_replacement()))


def replaced_and_counted(text: Column, search: Search) -> Column:
    """struct<text, n> of ``replaced`` and ``count``; one pass of the expression where it cannot match the empty string.

    Every replacement leaves a private mark, which is counted and taken out again; texts that hold the mark are read twice.
    """
    mark = "\ue0ff"
    if re.compile(search.pattern if search.regex else re.escape(search.pattern)).match(""):
        return F.struct(replaced(text, search).alias("text"), count(text, search).alias("n"))
    marked = F.regexp_replace(text, F.lit(search.java()), F.lit(search.java_replacement() + mark))
    bare = F.replace(marked, F.lit(mark), F.lit(""))
    plain = F.struct(replaced(text, search).alias("text"), count(text, search).alias("n"))
    return F.when(F.contains(text, F.lit(mark)), plain).otherwise(F.struct(bare.alias("text"), (F.length(marked) - F.length(bare)).alias("n")))


def occurrences(rows: DataFrame, key: str, text: str, search: Search, context: int = 30) -> DataFrame:
    """key, n, at (characters before), line, column, found, around for every non-empty match.

    Offsets come from splitting the text at its matches, all in the JVM.
    """
    found = rows.select(key, F.col(text).alias("t"), F.regexp_extract_all(text, F.lit(search.java()), F.lit(0)).alias("m"), F.split(text, search.java(), -1).alias("p"))
    some = found.where(F.size("m") > 0).select(key, "t", "p", F.posexplode("m").alias("n", "found")).where("found <> ''")
    before = F.array_join(F.slice("p", 1, F.col("n") + 1), "")
    matched = F.aggregate(F.slice(F.regexp_extract_all("t", F.lit(search.java()), F.lit(0)), F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + F.length(x))
    at = some.withColumn("at", F.length(before) + matched).drop("p")
    head = F.substring(F.col("t"), F.lit(1), F.col("at"))
    return at.select(
        key, "n", "at", (F.regexp_count(head, F.lit("\n")) + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"), "found",
        F.substring(F.col("t"), F.greatest(F.col("at") - context, F.lit(0)) + 1, F.least(F.col("at"), F.lit(context)) + F.length("found") + context).alias("around"),
    )


def batch(text: Column, searches: dict[str, Search], names: list[str]) -> tuple[Column, dict[str, str]]:
    """Named replacements one after another; a missing name or a bad expression is an error and the rest goes on."""
    errors: dict[str, str] = {}
    for name in names:
        if name not in searches:
            errors[name] = "no such search"
            continue
        try:
            re.compile(searches[name].pattern if searches[name].regex else "")
        except re.error as bad:
            errors[name] = str(bad)
            continue
        text = replaced(text, searches[name])
    return text, errors


# Fixed values of the typography rules: opening and closing quotes by language.
QUOTES = {"pt": "“”", "en": "“”", "es": "«»", "fr": "«»", "de": "„“"}
RULES = (
    ("castling", r"\b0-0(?:-0)?\b", lambda m, q: m[0].replace("0", "O")),
    ("dash", r"(?<= )--?(?= )", lambda m, q: "—"),
    ("quotes", r'"([^"\n]*)"', lambda m, q: f"{q[0]}{m[1]}{q[1]}"),
    ("ellipsis", r"\.\.\.(?!\.)", lambda m, q: "…"),
    ("move_space", r"(?<=\d\.) (?=[KQRBNa-hO♔♕♖♗♘])", lambda m, q: "\u00a0"),
)
_PROPOSAL = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *(StructField(n, StringType()) for n in ("old", "new", "rule"))]))


def proposals_of(text: str | None, language: str | None) -> list[dict]:
    """Candidates of all rules by (start, end); one that overlaps an earlier one is left out."""
    quotes = QUOTES.get((language or "en")[:2], QUOTES["en"])
    found = sorted(((m.start(), m.end(), m[0], make(m, quotes), rule) for rule, pattern, make in RULES for m in re.finditer(pattern, text or "")), key=lambda p: p[:2])
    out, end = [], 0
    for start, stop, old, new, rule in found:
        if start >= end and old != new:
            out.append({"start": start, "end": stop, "old": old, "new": new, "rule": rule})
            end = stop
    return out


@F.pandas_udf(_PROPOSAL)
def proposals(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([proposals_of(t, x) for t, x in zip(text, language, strict=True)])

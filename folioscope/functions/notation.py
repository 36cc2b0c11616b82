"""Chess notation as text: positions, moves, marks, games. No legality: no rules engine is assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Piece letters K Q R B N by language.
LETTERS = {"en": "KQRBN", "pt": "RDTBC", "es": "RDTAC", "de": "KDTLS", "fr": "RDTFC"}
FIGURES = "♔♕♖♗♘"
LEXEME = r"\{[^}]*\}|;[^\n]*|\(|\)|\$\d+|\d+\.(?:\.\.)?|1-0|0-1|1/2-1/2|\*|[^\s(){};]+"
SQUARE, ARROW = r"(?<!-)\b[a-h][1-8]\b(?!-)", r"\b[a-h][1-8]-[a-h][1-8]\b"


def fen_shape(fen: Column) -> Column:
    """Eight ranks of eight squares, one king a side and a side to move."""
    board = F.split(F.split(fen, " ")[0], "/")
    squares = lambda rank: F.length(F.regexp_replace(rank, "[1-8]", "")) + F.aggregate(F.split(F.regexp_replace(rank, "[^1-8]", ""), ""), F.lit(0), lambda a, d: a + F.coalesce(F.expr("0") + d.try_cast("int"), F.lit(0)))
    ranks = F.forall(board, lambda r: (squares(r) == 8) & r.rlike("^[KQRBNPkqrbnp1-8]+$"))
    one = lambda piece: F.length(F.split(fen, " ")[0]) - F.length(F.replace(F.split(fen, " ")[0], F.lit(piece), F.lit(""))) == 1
    return (F.size(board) == 8) & ranks & one("K") & one("k") & fen.rlike(r"^\S+( [wb]( \S+){0,4})?$")


def fen_key(fen: Column) -> Column:
    """Placement and side to move, without castling, en passant and counters."""
    parts = F.split(fen, " ")
    return F.concat_ws(" ", parts[0], F.coalesce(F.get(parts, 1), F.lit("w")))


def fen_board(fen: Column) -> Column:
    """The board as eight lines of characters, a dot for an empty square."""
    out = F.split(fen, " ")[0]
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return F.replace(out, F.lit("/"), F.lit("\n"))


def to_letters(text: Column, language: str = "en") -> Column:
    return F.translate(text, FIGURES, LETTERS[language])


def to_figures(text: Column, language: str = "en") -> Column:
    """Piece letters of move tokens to figurines; other words stay."""
    words = F.split(text, " ")
    move = r"^(\d+\.(\.\.)?)?[" + LETTERS[language] + r"][a-h]?[1-8]?x?[a-h][1-8].*$"
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(move), F.translate(w, LETTERS[language], FIGURES)).otherwise(w)), " ")


def substituted(text: Column, glyphs: dict[str, str]) -> Column:
    """Characters of a font with an encoding of its own to those that it prints."""
    return F.translate(text, "".join(glyphs), "".join(glyphs.values()))


def marks(text: Column) -> Column:
    """Squares and arrows named in a text, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(ARROW), F.lit(0)), F.regexp_extract_all(text, F.lit(SQUARE), F.lit(0))))


def lexemes(text: Column) -> Column:
    """array<struct<text, kind, depth>>: comments, parentheses, NAGs, move numbers, results and moves with their depth."""
    raw = F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))
    kind = lambda x: (
        F.when(x.rlike(r"^[{;]"), "comment").when(x == "(", "open").when(x == ")", "close").when(x.rlike(r"^\$\d+$"), "nag")
        .when(x.rlike(r"^\d+\.(\.\.)?$"), "number").when(x.isin("1-0", "0-1", "1/2-1/2", "*"), "result").otherwise("move")
    )
    steps = F.transform(raw, lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0))
    depth = lambda i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0), lambda a, s: a + s)
    return F.transform(raw, lambda x, i: F.struct(x.alias("text"), kind(x).alias("kind"), depth(i).alias("depth")))


def player_key(name: Column) -> Column:
    """Given Family to Family, Given; names with a comma stay."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(clean.contains(",") | ~clean.contains(" "), clean).otherwise(F.concat(F.regexp_extract(clean, r"(\S+)$", 1), F.lit(", "), F.regexp_extract(clean, r"^(.*) \S+$", 1)))


def side_to_move(caption: Column, move: Column) -> Column:
    """w or b from a caption's phrase, else from the dots after a move number; null without evidence."""
    said = F.lower(caption)
    white = said.rlike(r"(white|brancas|blancas|weiß|les blancs).{0,12}(to move|jogam|juegan|am zug|jouent)")
    black = said.rlike(r"(black|pretas|negras|schwarz|les noirs).{0,12}(to move|jogam|juegan|am zug|jouent)")
    dots = F.when(move.rlike(r"^\d+\.\.\."), "b").when(move.rlike(r"^\d+\.(?!\.)"), "w")
    return F.coalesce(F.when(white, "w").when(black, "b"), dots)


def pgn_tags(text: Column) -> Column:
    """map<tag, value> of a game's headers; of a repeated tag the last."""
    names, values = (F.regexp_extract_all(text, F.lit(r'(?m)^\[(\w+)\s+"([^"]*)"\]'), F.lit(i)) for i in (1, 2))
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e: F.lit(True)))


def pgn_text(tags: Column, moves: Column, result: Column) -> Column:
    """Headers, an empty line, numbered moves and the result."""
    head = F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat(F.lit("["), e["key"], F.lit(' "'), e["value"], F.lit('"]'))), "\n")
    body = F.array_join(F.transform(moves, lambda m, i: F.concat(F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "))).otherwise(F.lit("")), m)), " ")
    return F.concat(head, F.lit("\n\n"), body, F.lit(" "), result, F.lit("\n"))

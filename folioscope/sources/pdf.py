"""PDF files: the text layer as positioned rows, and paginated or searchable files made of lines.

Files are opened in Arrow batches, one a row; a file must fit in memory. Read are classic and compressed objects,
flate streams, page trees, and fonts with a Unicode map or the Windows encoding; what is encrypted gives no rows, nor do pages of
pixels only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TEXT = "path string, page int, pos int, x double, y double, size double, text string"
_NAME, _SPACE, _MARKS = b"/", b" \t\r\n\f\0", b"()<>[]{}/%"


class Ref(int):
    """The number of another object."""


class Word(str):
    """An operator or keyword."""


class Key(str):
    """A name."""


class _Scan:
    """Values of PDF syntax from a place in some bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            if c == b"%":
                end = re.compile(rb"[\r\n]").search(self.data, self.at)
                self.at = end.end() if end else len(self.data)
            elif c in _SPACE:
                self.at += 1
            else:
                return

    def plain(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at : self.at + 1] not in _SPACE and self.data[self.at : self.at + 1] not in _MARKS:
            self.at += 1
        return self.data[start : self.at]

    def string(self) -> bytes:
        out, depth = bytearray(), 1
        named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = self.data[self.at : self.at + 1]
                self.at += 1
                out += named.get(c, b"" if c in (b"\n", b"\r") else c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self):
        """The next value, or None at the end (or after a closing mark, which is passed)."""
        self.skip()
        two, c = self.data[self.at : self.at + 2], self.data[self.at : self.at + 1]
        if not c:
            return None
        if two == b"<<":
            self.at += 2
            found, key = {}, None
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>" or self.at >= len(self.data):
                    self.at += 2
                    return found
                v = self.value()
                if key is None and isinstance(v, Key):
                    key = v
                elif key is not None:
                    found[key], key = v, None
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]" or self.at >= len(self.data):
                    self.at += 1
                    return out
                out.append(self.value())
        if c == b"(":
            self.at += 1
            return self.string()
        if c == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end if end >= 0 else len(self.data)])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == _NAME:
            self.at += 1
            return Key(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.plain()).decode("latin-1"))
        if c in _MARKS:
            self.at += 1
            return Word(c.decode())
        word = self.plain()
        if re.fullmatch(rb"[+-]?\d+", word):
            ref = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)
            if ref:
                self.at = ref.end()
                return Ref(word)
            return int(word)
        return float(word) if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word) else Word(word.decode("latin-1"))


class Pdf:
    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.packed = data, {int(m[1]): m.end() for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b", data)}, {}
        for number in list(self.places):
            head = self.object(number)
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                body = self.stream(number)
                scan = _Scan(body)
                pairs = [(scan.value(), scan.value()) for _ in range(head.get("N", 0))]
                self.packed |= {n: (body, head["First"] + at) for n, at in pairs if isinstance(n, int) and isinstance(at, int)}

    def object(self, number: int):
        if number in self.places:
            return _Scan(self.data, self.places[number]).value()
        return _Scan(*self.packed[number]).value() if number in self.packed else None

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.object(value)
        return None

    def stream(self, number: int) -> bytes:
        """The decoded bytes of a stream object; none for filters other than flate."""
        scan = _Scan(self.data, self.places.get(number, len(self.data)))
        head = scan.value()
        start = re.compile(rb"\s*stream\r?\n").match(self.data, scan.at)
        if not isinstance(head, dict) or not start:
            return b""
        size = self.get(head.get("Length"))
        end = start.end() + size if isinstance(size, int) and self.data[start.end() + size :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", start.end())
        body, filters = self.data[start.end() : end], self.get(head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name != "FlateDecode":
                return b""
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                return b""
        return body

    def pages(self) -> Iterator[dict]:
        """Pages in the order of the tree, with what they inherit."""
        trailers = [_Scan(self.data, m.end()).value() for m in re.finditer(rb"trailer", self.data)]
        heads = [t for t in [*trailers, *(self.object(n) for n in self.places)] if isinstance(t, dict)]
        if any("Encrypt" in t for t in heads):
            return
        root = next((self.get(t["Root"]) for t in reversed(heads) if isinstance(self.get(t.get("Root")), dict)), None)
        waiting, seen = [(root.get("Pages"), {})] if root else [], set()
        while waiting:
            at, above = waiting.pop()
            node = self.get(at)
            if not isinstance(node, dict) or (isinstance(at, Ref) and at in seen):
                continue
            seen.add(at if isinstance(at, Ref) else id(at))
            node = above | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                below = {k: node[k] for k in ("Resources",) if k in node}
                waiting += [(kid, below) for kid in reversed(kids)]
            else:
                yield node

    def fonts(self, page: dict) -> dict:
        resources = self.get(page.get("Resources")) or {}
        found = self.get(resources.get("Font")) or {}
        return {name: _decoder(self, self.get(font)) for name, font in found.items()}

    def texts(self, page: dict) -> Iterator[tuple[float, float, float, str]]:
        """(x, y, size, text) of the strings a page shows, in the order of its content."""
        contents = page.get("Contents")
        refs = [contents] if isinstance(contents, Ref) and not isinstance(self.get(contents), list) else self.get(contents) or []
        scan, stack, fonts = _Scan(b"\n".join(self.stream(r) for r in refs if isinstance(r, Ref))), [], self.fonts(page)
        decode, size, lead, line, at = _windows, 1.0, 0.0, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

        def moved(m: tuple, x: float, y: float) -> tuple:
            return (*m[:4], m[4] + x * m[0] + y * m[2], m[5] + x * m[1] + y * m[3])

        while (v := scan.value()) is not None:
            if not isinstance(v, Word):
                stack.append(v)
                continue
            n = [x for x in stack if isinstance(x, (int, float))]
            if v == "BT":
                line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif v == "Tf" and len(stack) >= 2:
                decode, size = fonts.get(stack[-2], _windows), float(n[-1]) if n else size
            elif v == "TL" and n:
                lead = n[-1]
            elif v in ("Td", "TD") and len(n) >= 2:
                lead = -n[-1] if v == "TD" else lead
                line = at = moved(line, n[-2], n[-1])
            elif v == "Tm" and len(n) >= 6:
                line = at = tuple(map(float, n[-6:]))
            elif v in ("T*", "'", '"'):
                line = at = moved(line, 0, -lead)
            if v in ("Tj", "'", '"', "TJ") and stack:
                parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
                # a wide step back inside an array stands for a space
                text = "".join(decode(p) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -200 else "" for p in parts)
                if text:
                    yield at[4], at[5], size * abs(at[3] or at[1] or 1.0), text
                    at = moved(at, 0.5 * size * len(text), 0)
            stack.clear()


def _windows(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


def _decoder(pdf: Pdf, font: dict | None):
    """Bytes of a string to text by the font's Unicode map, else by the Windows encoding."""
    ref = (font or {}).get("ToUnicode")
    if not isinstance(ref, Ref):
        return _windows
    body = pdf.stream(ref)
    wide = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", body)
    width = len(wide[1]) // 2 if wide else 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    known: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        known |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for low, high, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            codes = range(int(low, 16), int(high, 16) + 1)
            if to:
                known |= {c: text(to)[:-1] + chr(ord(text(to)[-1]) + i) for i, c in enumerate(codes)}
            else:
                known |= {c: text(h) for c, h in zip(codes, re.findall(rb"<([0-9A-Fa-f]+)>", listed), strict=False)}
    return lambda raw: "".join(known.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def text_rows(files: DataFrame) -> DataFrame:
    """path, page (from 1), pos, x, y (from the bottom), size, text of the text layers of rows path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                pdf = Pdf(data)
                rows = [(path, k, i, *t) for k, page in enumerate(pdf.pages(), 1) for i, t in enumerate(pdf.texts(page))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEXT.split(", ")])

    return files.select("path", "content").mapInPandas(run, TEXT)


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text_rows`` of PDF files."""
    return text_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def _quoted(text: str) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252", "replace")) + b")"


def _file(pages: list[bytes], width: float, height: float) -> bytes:
    """A PDF of these page contents with one font."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))))]
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    for i, body in enumerate(pages):
        packed = zlib.compress(body)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (width, height, 5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def pdf_files(lines: DataFrame, doc: str, *, per_page: int = 50, size: float = 11.0, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """doc and content: a paginated PDF of each document's lines (pos, text). A document must fit one task."""
    kind = dict(lines.dtypes)[doc]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("pos")["text"].fillna("").tolist()
        pages = [texts[i : i + per_page] for i in range(0, len(texts), per_page)]
        bodies = [b"BT /F1 %g Tf %g TL 50 %g Td\n" % (size, size * 1.3, height - 60) + b"\n".join(_quoted(t) + b" Tj T*" for t in p) + b"\nET" for p in pages]
        return pd.DataFrame([(key[0], _file(bodies, width, height))], columns=[doc, "content"])

    return lines.select(doc, "pos", "text").groupBy(doc).applyInPandas(run, f"{doc} {kind}, content binary")


def searchable_files(words: DataFrame, doc: str, *, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """doc and content: a PDF whose pages hold words (page, pos, text, x1, y1, x2, y2 from the top) as invisible text at their places."""
    kind = dict(words.dtypes)[doc]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bodies = []
        for _, page in rows.sort_values(["page", "pos"]).groupby("page", sort=True):
            shown = [b"/F1 %g Tf 1 0 0 1 %g %g Tm %s Tj" % (max(y2 - y1, 1.0), x1, height - y2, _quoted(t or "")) for t, x1, y1, y2 in page[["text", "x1", "y1", "y2"]].itertuples(index=False)]
            bodies.append(b"BT 3 Tr\n" + b"\n".join(shown) + b"\nET")
        return pd.DataFrame([(key[0], _file(bodies, width, height))], columns=[doc, "content"])

    return words.select(doc, "page", "pos", "text", "x1", "y1", "x2", "y2").groupBy(doc).applyInPandas(run, f"{doc} {kind}, content binary")

"""Spreadsheets (OOXML): used ranges, header rows, row groups, windows, regions and sheets."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from ..functions import text as T
from ..operators.outline import Chunk
from ..options import ChunkOptions, ParseError, Unsupported
from .epub import attribute, local, resolved

WIDEST, DEEPEST = 16_384, 1_048_576
PART_SIZE = 2000
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


@dataclass(frozen=True)
class Cell:
    kind: str  # text, number, other or empty
    text: str


EMPTY = Cell("empty", "")


@dataclass
class Sheet:
    name: str
    index: int
    first_row: int
    rows: list[list[Cell]]

    @property
    def width(self) -> int:
        return max(map(len, self.rows), default=0)

    def header_row(self) -> int | None:
        """The first row that is not empty, if it is all texts (a number may stand first)."""
        for i, row in enumerate(self.rows):
            full = [c for c in row if c.kind != "empty"]
            if full:
                texts = all(c.kind == "text" for c in full)
                indexed = len(full) >= 2 and full[0].kind == "number" and all(c.kind == "text" for c in full[1:])
                return i if texts or indexed else None
        return None

    def names(self) -> list[str]:
        at = self.header_row()
        row = self.rows[at] if at is not None else []
        return [row[i].text if i < len(row) and T.strip(row[i].text) else f"Column {i + 1}" for i in range(self.width)]

    def data(self, skip_empty: bool) -> list[tuple[int, list[Cell]]]:
        """Rows below the header with their place in the sheet; the header itself if there is nothing below."""
        head = self.header_row()
        every = [(self.first_row + i, r) for i, r in enumerate(self.rows) if not (skip_empty and all(c.kind == "empty" for c in r))]
        below = [x for x in every if head is None or x[0] > self.first_row + head]
        return below or [x for x in every if head is not None and x[0] >= self.first_row + head]


def number(value: float) -> str:
    """Fifteen significant digits, never with an exponent; whole numbers without a point."""
    if value != value or value in (float("inf"), float("-inf")):
        return ""
    if value == int(value) and abs(value) < 2**63:
        return str(int(value))
    return format(Decimal(repr(float(f"{value:.14e}"))), "f")


def date(value: float, since_1904: bool) -> str:
    try:
        at = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if value >= 60 else 31)
        return (at + timedelta(milliseconds=round(value * 86_400_000))).isoformat(sep=" ", timespec="auto").removesuffix(".000000")
    except (OverflowError, ValueError):
        return number(value)


def place(ref: str | None) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})", ref or "")
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    row = int(m[2])
    return (row - 1, col - 1) if 1 <= row <= DEEPEST and col <= WIDEST else None


class Workbook:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
                raise Unsupported("binary or encrypted workbooks have no loader") from e
            raise ParseError(f"Not a valid workbook (zip) file: {e}") from e
        self.part = next((p for p in ("xl/workbook.xml",) if p in self.zip.namelist()), None)
        if self.part is None:
            raise ParseError("Not a workbook: missing xl/workbook.xml")
        book = self.xml(self.part)
        links = {attribute(e, "Id"): resolved("xl", (attribute(e, "Target") or "").removeprefix("/xl/")) for e in self.xml("xl/_rels/workbook.xml.rels").iter() if local(e.tag) == "Relationship"}
        self.since_1904 = any(local(e.tag) == "workbookPr" and attribute(e, "date1904") in ("1", "true") for e in book.iter())
        sheets = [e for e in book.iter() if local(e.tag) == "sheet"]
        self.sheets = [(attribute(e, "name") or "", links.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None), "")) for e in sheets]
        self.strings = ["".join(t.text or "" for t in self._texts(si)) for si in self.xml("xl/sharedStrings.xml") if local(si.tag) == "si"] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._dates() if "xl/styles.xml" in self.zip.namelist() else []

    def xml(self, name: str) -> ET.Element:
        try:
            return ET.fromstring(self.zip.read(name))
        except (KeyError, ET.ParseError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as e:
            raise ParseError(f"cannot read {name}: {e}") from e

    @staticmethod
    def _texts(e: ET.Element) -> Iterator[ET.Element]:
        """Text elements, without phonetic readings."""
        for c in e:
            if local(c.tag) == "t":
                yield c
            elif local(c.tag) == "r":
                yield from (x for x in c if local(x.tag) == "t")

    def _dates(self) -> list[bool]:
        """For each cell style, whether it shows dates."""
        styles = self.xml("xl/styles.xml")
        own = {}
        for e in styles.iter():
            if local(e.tag) == "numFmt":
                bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", attribute(e, "formatCode") or "", flags=re.I)
                own[attribute(e, "numFmtId")] = re.search("[ymdhs]", bare, re.I) is not None and "general" not in bare.lower()
        cells = next((e for e in styles if local(e.tag) == "cellXfs"), [])
        return [own.get(f, f.isdigit() and int(f) in DATE_FORMATS) for f in (attribute(x, "numFmtId") or "0" for x in cells)]

    def cell(self, c: ET.Element) -> Cell:
        kind = attribute(c, "t") or "n"
        v = next((x.text or "" for x in c if local(x.tag) == "v"), None)
        if kind == "inlineStr":
            inner = next((x for x in c if local(x.tag) == "is"), None)
            return Cell("text", "".join(t.text or "" for t in self._texts(inner))) if inner is not None else EMPTY
        if v is None:
            return EMPTY
        if kind == "s":
            return Cell("text", self.strings[int(v)]) if v.isdigit() and int(v) < len(self.strings) else EMPTY
        if kind == "str":
            return Cell("text", v)
        if kind == "b":
            return Cell("other", "true" if v == "1" else "false")
        if kind in ("e", "d"):
            return Cell("other", v)
        try:
            value = float(v)
        except ValueError:
            return Cell("text", v) if v else EMPTY
        style = attribute(c, "s") or "0"
        if style.isdigit() and int(style) < len(self.dates) and self.dates[int(style)]:
            return Cell("other", date(value, self.since_1904))
        return Cell("number", number(value))

    def sheet(self, index: int) -> Sheet:
        name, part = self.sheets[index]
        found: dict[tuple[int, int], Cell] = {}
        row_at = -1
        for row in self.xml(part).iter():
            if local(row.tag) != "row":
                continue
            stated = attribute(row, "r")
            row_at = int(stated) - 1 if stated and stated.isdigit() else row_at + 1
            col_at = -1
            for c in row:
                if local(c.tag) == "c":
                    row_i, col_at = place(attribute(c, "r")) or (row_at, col_at + 1)
                    if (made := self.cell(c)).kind != "empty" and row_i < DEEPEST and col_at < WIDEST:
                        found[row_i, col_at] = made
        if not found:
            return Sheet(name, index, 0, [])
        top, left = min(r for r, _ in found), min(c for _, c in found)
        bottom, right = max(r for r, _ in found), max(c for _, c in found)
        if (bottom - top + 1) * (right - left + 1) > 50_000_000:
            raise ParseError(f"sheet {name!r} is too sparse to be read as a grid")
        return Sheet(name, index, top, [[found.get((r, c), EMPTY) for c in range(left, right + 1)] for r in range(top, bottom + 1)])


def line(names: list[str], cells: list[Cell], headers: bool) -> str:
    text = [cells[i].text if i < len(cells) else "" for i in range(len(names))]
    return " | ".join(f"{n}: {t}" for n, t in zip(names, text, strict=True)) if headers else " | ".join(text)


def regions(s: Sheet) -> list[tuple[int, int, int, int]]:
    """Runs of rows that are not empty: first and last row and column, in the grid."""
    out, open_ = [], None
    for i, row in enumerate([*s.rows, []]):
        full = [k for k, c in enumerate(row) if c.kind != "empty"]
        if full:
            a, _, c, d = open_ or (i, i, full[0], full[-1])
            open_ = (a, i, min(c, full[0]), max(d, full[-1]))
        elif open_:
            out.append(open_)
            open_ = None
    return out


def chunks(data: bytes, o: ChunkOptions) -> list[Chunk]:
    book, out, skipped, read, error = Workbook(data), [], [], 0, None
    for i, (sheet_name, _) in enumerate(book.sheets):
        try:
            s = book.sheet(i)
            read += 1
        except ParseError as e:
            error = error or e
            skipped.append(sheet_name)
            continue
        names, h = s.names(), o.include_headers
        where = {"sheet_name": s.name, "sheet_index": s.index}
        if o.mode == "table":
            n = 0
            for a, b, c, d in regions(s):
                part = Sheet(s.name, i, a, [r[c : d + 1] for r in s.rows[a : b + 1]])
                rows = part.data(o.skip_empty_rows)
                for p in T.packed([line(part.names(), r, h) for _, r in rows], PART_SIZE, "\n"):
                    out.append(Chunk(p, "table_region", {**where, "start_row": s.first_row + a, "end_row": s.first_row + b, "header_row": part.names(), "col_count": part.width, "row_count": p.count("\n") + 1, "chunk_index": n}))
                    n += 1
        elif o.mode == "sheet":
            rows = s.data(o.skip_empty_rows)
            head = s.header_row()
            only = head is not None and len(rows) == 1 and rows[0][0] == s.first_row + head
            parts = T.packed([line(names, r, h and not only) for _, r in rows], PART_SIZE, "\n")
            for k, p in enumerate(parts):
                out.append(Chunk(p, "sheet", {**where, "row_count": p.count("\n") + 1, "col_count": s.width, "header_row": names, "chunk_index": len(out), "is_split": len(parts) > 1, "split_part": k if len(parts) > 1 else None}))
        else:
            rows, window = s.data(o.skip_empty_rows), o.mode == "sliding_window"
            n = o.window_size if window else o.rows_per_chunk
            step = n - o.overlap if window else n
            for k, at in enumerate(range(0, len(rows), step)):
                part = rows[at : at + n]
                text = "\n".join(line(names, r, h) for _, r in part)
                if window:
                    meta = {**where, "window_size": n, "overlap": o.overlap, "actual_row_count": len(part), "window_index": k, "start_row": part[0][0], "end_row": part[-1][0], "header_row": names, "col_count": s.width, "chunk_index": len(out)}
                else:
                    meta = {**where, "row_index": part[0][0], "header_row": names, "col_count": s.width, "rows_per_chunk": n, "actual_row_count": len(part), "chunk_index": k}
                out.append(Chunk(text, "row_window" if window else "row_document", meta))
    if error and not read:
        raise error
    for c in out:
        c.metadata["skipped_sheets"] = skipped
    return out


def markdown(data: bytes) -> str:
    book, parts = Workbook(data), []
    show = lambda cells: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in cells) + " |"
    for i in range(len(book.sheets)):
        s = book.sheet(i)
        rows = [r for r in s.rows if any(c.kind != "empty" for c in r)]
        body = [show(c.text for c in r) for r in rows]
        if body and s.header_row() is not None:
            body.insert(1, show(["---"] * s.width))
        if body:
            parts.append("\n\n".join([f"## {s.name}", "\n".join(body)]))
    return "\n\n---\n\n".join(parts)

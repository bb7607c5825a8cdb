"""OpenDocument texts and presentations as Markdown.

The content part is read once, as events. What is being written to is a stack of sinks: the running
paragraph, and above it a table cell, a note or a slide's notes while one is open. A part that is
malformed or ends early is an error, never a prefix of the document.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import text as T
from ..operators.outline import Chunk
from ..options import ParseError
from .epub import local

#: Columns of a row, and empty ones kept at its end.
MOST_COLUMNS, MOST_EMPTY = 16_384, 64
KINDS = {"odt": "opendocument.text", "odp": "opendocument.presentation"}


@dataclass
class Document:
    markdown: str
    meta: dict
    images: list[tuple[str, bytes]] = field(default_factory=list)


@dataclass
class Table:
    rows: list[list[str]] = field(default_factory=list)
    row: list[str] = field(default_factory=list)
    empty: int = 0
    repeat: int = 1

    def add(self, cell: str) -> None:
        """A cell as often as it is repeated; empty ones wait for a cell behind them."""
        if not cell:
            self.empty += self.repeat
            return
        self.row = (self.row + [""] * min(self.empty, MOST_COLUMNS))[:MOST_COLUMNS]
        self.row = (self.row + [cell] * self.repeat)[:MOST_COLUMNS]
        self.empty = 0

    def close_row(self) -> None:
        row = (self.row + [""] * min(self.empty, MOST_EMPTY))[:MOST_COLUMNS]
        if row:
            self.rows.append(row)
        self.row, self.empty = [], 0


def spaced(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Walker:
    """Target of an XML parser: blocks of Markdown from the content part."""

    def __init__(self, slides: bool, styles: dict[str, bool], image_names: dict[str, str]):
        self.slides, self.styles, self.image_names = slides, styles, image_names
        self.blocks: list[str] = []
        self.notes: list[str] = []
        self.sinks: list[list[str]] = [[]]
        self.tables: list[Table] = []
        self.lists: list[bool] = []
        self.item = False
        self.level: int | None = None
        self.link: tuple[str, int] | None = None
        self.frame = ""
        self.slide = 0
        self.slide_notes = ""

    # ------------------------------------------------------------ events

    def start(self, tag: str, attrib: dict[str, str]) -> None:
        name = local(tag)
        get: Callable[[str], str | None] = lambda key: next((v for k, v in attrib.items() if local(k) == key), None)
        if name == "h":
            level = get("outline-level") or ""
            self.level = int(level) if level.isdecimal() else 1
        elif name == "frame":
            self.frame = get("name") or ""
        elif name == "image":
            base = (get("href") or "").rpartition("/")[2]
            self.blocks.append(f"![{self.frame.strip()}]({self.image_names.get(base, base)})")
            self.frame = ""
        elif name == "list":
            # a nested list without a style of its own goes on with that of the list around it
            self.lists.append(self.styles.get(get("style-name"), bool(self.lists and self.lists[-1])))
        elif name == "list-item":
            self.item = True
        elif name == "table":
            self.tables.append(Table())
        elif name in ("table-cell", "covered-table-cell") and self.tables:
            repeat = (get("number-columns-repeated") or "").strip()
            self.tables[-1].repeat = min(max(int(repeat), 1), MOST_COLUMNS) if repeat.isdecimal() else 1
            self.sinks.append([])
        elif name in ("note-body", "notes"):
            self.sinks.append([])
        elif name == "page" and self.slides:
            self.slide += 1
            self.blocks.append(f"## Slide {self.slide}")
        elif name == "a" and len(self.sinks) == 1:
            self.link = (get("href") or "", len(self.sinks[0]))
        elif name in ("tab", "s"):
            self.data(" ")
        elif name == "line-break":
            self.data("\n")

    def data(self, text: str) -> None:
        self.sinks[-1].append(text)

    def end(self, tag: str) -> None:
        name = local(tag)
        if name in ("p", "h"):
            self.paragraph()
        elif name == "a" and self.link and len(self.sinks) == 1:
            href, at = self.link
            self.link = None
            if href and at <= len(self.sinks[0]):
                self.sinks[0][at:] = [f"[{''.join(self.sinks[0][at:])}]({href})"]
        elif name == "list" and self.lists:
            self.lists.pop()
            self.item = self.item and bool(self.lists)
        elif name == "list-item":
            self.item = bool(self.lists)
        elif name in ("table-cell", "covered-table-cell") and self.tables:
            self.tables[-1].add(spaced(self.sinks.pop()))
        elif name == "table-row" and self.tables:
            self.tables[-1].close_row()
        elif name == "table" and self.tables:
            self.table(self.tables.pop())
        elif name == "note-body":
            if note := spaced(self.sinks.pop()):
                self.notes.append(note)
        elif name == "notes":
            self.slide_notes += "".join(self.sinks.pop())
        elif name == "page" and self.slides:
            if notes := spaced([self.slide_notes]):
                self.blocks.append(f"**Notes:** {notes}")
            self.slide_notes = ""

    def close(self) -> str:
        if self.notes:
            self.blocks += ["## Notes", *(f"{i}. {n}" for i, n in enumerate(self.notes, 1))]
        return "\n\n".join(self.blocks).strip()

    # ------------------------------------------------------------ blocks

    def paragraph(self) -> None:
        if len(self.sinks) > 1:  # inside a cell or note, whose text goes on
            return
        text, level = spaced(self.sinks[0]), self.level
        self.sinks[0].clear()
        self.link, self.level = None, None
        if not text:
            return
        if level is not None:
            text = f"{'#' * min(max(level, 1), 6)} {text}"
        elif self.item and self.lists:
            text = f"{'  ' * (len(self.lists) - 1)}{'1.' if self.lists[-1] else '-'} {text}"
        self.blocks.append(text)

    def table(self, t: Table) -> None:
        t.close_row()
        if not t.rows:
            return
        if self.tables:  # a table in a cell is a line of it
            cell = self.sinks[-1]
            cell.append(" " if cell and not cell[-1].endswith(" ") else "")
            cell.append("; ".join(" | ".join(r) for r in t.rows))
            return
        width = max(map(len, t.rows))
        lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |" for r in t.rows]
        lines.insert(1, "|" + " --- |" * width)
        self.blocks.append("\n".join(lines))


def list_styles(content: str) -> dict[str, bool]:
    """For each list style, whether it is numbered."""
    found = re.finditer(r'(?s)<text:list-style\b[^>]*?style:name="([^"]*)"(.*?)(?=</text:list-style>|\Z)', content)
    return {m[1]: "<text:list-level-style-number" in m[2] for m in found}


def load(data: bytes, kind: str) -> Document:
    """``kind``: odt or odp."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise ParseError(f"Not a valid ODF (zip) file: {e}") from e

    def part(name: str) -> bytes | None:
        try:
            return archive.read(name)
        except (KeyError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
            return None

    if b"manifest:encryption-data" in (part("META-INF/manifest.xml") or b""):
        raise ParseError("ODF file is encrypted (password-protected); cannot extract")
    content = part("content.xml")
    if content is None:
        raise ParseError("ODF file has no content.xml")
    mime = (part("mimetype") or b"").decode("utf-8", "replace")
    if any(x in mime for x in KINDS.values()) and KINDS[kind] not in mime:
        raise ParseError(f"ODF mimetype mismatch: {mime.strip()}")
    images, names = {}, {}
    for name in archive.namelist():
        if name.startswith("Pictures/") and not name.endswith("/") and (raw := part(name)) is not None:
            base = name.rpartition("/")[2]
            names[base] = f"{T.content_hash(raw)}.{base.rpartition('.')[2].lower()}"
            images.setdefault(names[base], raw)
    walker = Walker(kind == "odp", list_styles(content.decode("utf-8", "replace")), names)
    parser = ET.XMLParser(target=walker)
    try:
        parser.feed(content)
        text = parser.close()
    except ET.ParseError as e:
        raise ParseError(f"ODF content.xml is malformed: {e}") from e
    meta = {"source_type": kind, "title": None, "creator": None}
    for key in ("title", "creator"):
        if m := re.search(f"(?s)<dc:{key}>(.*?)</dc:{key}>", (part("meta.xml") or b"").decode("utf-8", "replace")):
            value = m[1]
            for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                value = value.replace(name, sign)
            meta[key] = value.strip() or None
    if kind == "odp":
        meta["slide_count"] = walker.slide
    return Document(text, meta, [*images.items()])


def stamp_slides(chunks: list[Chunk]) -> list[Chunk]:
    """Each chunk with the number and title of its slide; the title is the first line under the slide's
    heading, known to all chunks of the slide once one of them has it."""
    number = lambda text: int(m[1]) if (m := re.fullmatch(r"Slide\s+\+?([0-9]+)", text or "")) else None
    now, titles = None, {}
    for c in chunks:
        here, around = number(c.content.strip()), number(c.metadata.get("section_heading"))
        if here is not None:
            now = here
        elif around is not None:
            now = around
            if now not in titles and (line := next((x.strip() for x in c.content.splitlines() if x.strip()), None)):
                titles[now] = line
        if now is not None:
            c.metadata["slide_number"] = now
    for c in chunks:
        if "slide_number" in c.metadata:
            c.metadata["slide_title"] = titles.get(c.metadata["slide_number"])
    return chunks

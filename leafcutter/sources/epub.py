"""E-books: the package's reading order, each chapter as HTML."""

from __future__ import annotations

import io
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from dataclasses import dataclass, field

from ..functions import text as T
from ..operators.outline import BUILDERS, Chunk
from ..options import ChunkOptions, ParseError
from . import html

NAVIGATION = frozenset({"toc", "tableofcontents", "contents", "nav", "navigation"})
#: Lists in the metadata by element.
LISTS = {"creator": "creators", "identifier": "identifiers", "publisher": "publishers", "contributor": "contributors", "subject": "subjects", "language": "languages"}


@dataclass
class Chapter:
    href: str
    data: bytes
    is_navigation: bool


@dataclass
class Book:
    meta: dict
    chapters: list[Chapter] = field(default_factory=list)
    images: list[tuple[str, bytes]] = field(default_factory=list)


def local(name: str) -> str:
    return re.split("[}:]", name)[-1]


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def resolved(folder: str, href: str) -> str:
    out = folder.split("/") if folder else []
    for part in urllib.parse.unquote(href.partition("#")[0], errors="replace").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def parsed(data: bytes | None, what: str) -> ET.Element:
    if data is None:
        raise ParseError(f"Not an EPUB: missing {what}")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ParseError(f"Bad {what}: {e}") from e


def contents(data: bytes) -> list[dict]:
    """Titles and targets of a table of contents, of either kind."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        if local(e.tag) == "a":
            label, target = T.strip("".join(e.itertext())), attribute(e, "href")
        elif local(e.tag) == "navPoint":
            label = T.strip("".join(x.text or "" for c in e if local(c.tag) == "navLabel" for x in c.iter() if local(x.tag) == "text"))
            target = next((attribute(c, "src") for c in e if local(c.tag) == "content"), None)
        else:
            continue
        if label and target is not None:
            out.append({"title": label, "href": target})
    return out


def load(data: bytes) -> Book:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise ParseError(f"Not a valid EPUB (zip) file: {e}") from e

    def entry(name: str) -> bytes | None:
        try:
            return archive.read(name)
        except (KeyError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
            return None

    container = parsed(entry("META-INF/container.xml"), "META-INF/container.xml")
    place = next((p for e in container.iter() if local(e.tag) == "rootfile" and (p := attribute(e, "full-path"))), None)
    if place is None:
        raise ParseError("Not an EPUB: no rootfile in container.xml")
    place = urllib.parse.unquote(place)
    package, folder = parsed(entry(place), place), place.rpartition("/")[0]
    found: dict[str, list[str]] = {}
    items: dict[str, tuple[str, str, list[str]]] = {}
    spine: list[str] = []
    for e in package.iter():
        tag = local(e.tag)
        if tag in ("title", *LISTS) and (text := T.strip(e.text or "")):
            held = found.setdefault(tag, [])
            held += [text] * (text not in held)
        elif tag == "item" and (key := attribute(e, "id")) and (href := attribute(e, "href")) is not None:
            items[key] = (href, attribute(e, "media-type") or "", (attribute(e, "properties") or "").split())
        elif tag == "itemref" and (key := attribute(e, "idref")) is not None:
            spine.append(key)
    first = lambda k: found.get(k, [None])[0]
    skipped: list[str] = []
    book = Book({"source_type": "epub", "title": first("title"), "language": first("language"), "creator": first("creator"), "identifier": first("identifier"), "epub_version": attribute(package, "version")})
    for key in spine:
        if key not in items:
            skipped.append(f"{key} (no manifest item)")
            continue
        href, _, properties = items[key]
        full = resolved(folder, href)
        stem = href.rpartition("/")[2].partition(".")[0]
        navigation = "nav" in properties or any(re.sub("[^a-z0-9]", "", T.ascii_lower(x)) in NAVIGATION for x in (key, stem))
        if (body := entry(full)) is None:
            skipped.append(full)
        else:
            book.chapters.append(Chapter(full, body, navigation))
    toc = next((h for h, _, p in items.values() if "nav" in p), None) or next((h for h, m, _ in items.values() if m == "application/x-dtbncx+xml"), None)
    listed = entry(resolved(folder, toc)) if toc else None
    book.images = [(full, raw) for h, m, _ in items.values() if m.startswith("image/") and (raw := entry(full := resolved(folder, h))) is not None]
    if not book.chapters:
        raise ParseError("EPUB has no readable spine content")
    book.meta |= {"spine_count": len(book.chapters), "skipped_spine_items": skipped, **{name: found.get(k, []) for k, name in LISTS.items()}, "toc": contents(listed) if listed else []}
    return book


def chunks(data: bytes, o: ChunkOptions) -> list[Chunk]:
    """Chapters one by one; numbering starts anew in each."""
    book, out = load(data), []
    for i, c in enumerate(book.chapters):
        for made in BUILDERS[o.mode](html.units(c.data), html.RULES, o):
            made.metadata |= {"document_metadata": book.meta, "spine_index": i, "href": c.href, "is_navigation": c.is_navigation}
            out.append(made)
    return out


def markdown(data: bytes) -> str:
    book = load(data)
    parts = [f"# {book.meta['title']}"] if book.meta["title"] else []
    parts += [x for x in (T.strip(html.markdown(c.data.decode("utf-8", "replace"))) for c in book.chapters) if x]
    return T.strip("\n\n---\n\n".join(parts))

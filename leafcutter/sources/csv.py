"""Delimited text: ragged records, header vote, row groups and windows."""

from __future__ import annotations

import csv
import io

from ..functions import text as T
from ..operators.outline import Chunk
from ..options import ChunkOptions, InvalidArg, ParseError
from .decode import decode_text

SNIFFED = 20
WIDEST = 16_384


def delimiter(line: str) -> str:
    quoted, counts = False, dict.fromkeys(",\t;|", 0)
    for c in line.replace('""', ""):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    return max(counts, key=counts.get)


def numeric(value: str) -> bool:
    v = T.strip(value).lstrip("+-$£€").replace(",", "").rstrip("%")
    try:
        float(v)
    except ValueError:
        return False
    return "_" not in v and v == v.strip()


def is_header(first: list[str], rows: list[list[str]]) -> bool:
    """Each column votes: a text over numbers, or of unusual length over texts, is a name."""
    if not rows or not first or any(not T.strip(c) for c in first) or all(map(numeric, first)):
        return False
    votes = 0
    for i, name in enumerate(first):
        values = [r[i] for r in rows[:SNIFFED] if i < len(r)]
        if not values:
            continue
        if 2 * sum(map(numeric, values)) > len(values):
            votes += -1 if numeric(name) else 1
        else:
            middle = sorted(len(T.strip(v)) for v in values)[len(values) // 2]
            votes += -1 if len(T.strip(name)) == middle else 1
    return votes > 0


def table(data: bytes | str, o: ChunkOptions) -> tuple[list[str], list[list[str]], str, bool]:
    """Header, rows, delimiter, and whether the header stood in the file."""
    text = data if isinstance(data, str) else decode(data, o.encoding)
    sep = o.delimiter
    if sep is None:
        line = next((x for x in T.lines(text) if T.strip(x) and not T.strip(x).startswith("#")), "")
        sep = delimiter(line)
    if not T.strip(text):
        return [], [], o.delimiter or ",", False
    csv.field_size_limit(1 << 30)
    try:
        records = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    except csv.Error as e:
        raise ParseError(f"Failed to read CSV row: {e}") from e
    if not records:
        return [], [], sep, False
    first, rows = records[0], [r for r in records[1:] if not o.skip_empty_rows or any(map(T.strip, r))]
    named = is_header(first, rows)
    if not named:
        first, rows = [f"Column {i + 1}" for i in range(max(len(r) for r in [first, *rows[:SNIFFED]]))], [first, *rows]
    return first, rows, sep, named


def decode(data: bytes, encoding: str) -> str:
    e = encoding.lower()
    if e == "auto":
        return decode_text(data)
    names = {"utf-8": "utf-8", "utf8": "utf-8", "utf-8-bom": "utf-8-sig", "latin-1": "latin-1", "iso-8859-1": "latin-1", "windows-1252": "cp1252", "cp1252": "cp1252"}
    if e not in names:
        raise InvalidArg(f"unknown encoding {encoding!r}")
    try:
        return data.decode(names[e]).removeprefix("﻿")
    except UnicodeDecodeError as err:
        raise ParseError(str(err)) from err


def line(header: list[str], row: list[str], names: bool) -> str:
    if not names:
        return " | ".join(row)
    label = lambda i: header[i] if i < len(header) and T.strip(header[i]) else f"Column {i + 1}"
    return " | ".join(f"{label(i)}: {row[i] if i < len(row) else ''}" for i in range(max(len(header), len(row))))


def chunks(data: bytes | str, o: ChunkOptions) -> list[Chunk]:
    header, rows, sep, named = table(data, o)
    window = o.mode == "sliding_window"
    size = o.window_size if window else o.paragraphs_per_page if o.mode == "page_aware" else o.rows_per_chunk
    step = size - o.overlap if window else size
    out = []
    for i, at in enumerate(range(0, len(rows), step)):
        part = rows[at : at + size]
        header = header + [f"Column {k + 1}" for k in range(len(header), max(map(len, part)))]
        where = {"row_start": at + 1, "row_end": at + len(part)}
        shape = {"col_count": len(header), "header_row": header, "has_header": named, "delimiter_detected": sep, "encoding": o.encoding.lower(), "chunk_index": i}
        if window:
            meta = {"window_index": i, "window_size": size, "overlap": o.overlap, **where, "actual_row_count": len(part), **shape}
        else:
            meta = {**where, "row_count": len(part), **shape}
        out.append(Chunk("\n".join(line(header, r, o.include_headers) for r in part), "row_window" if window else "row_group", meta))
    return out


def markdown(data: bytes | str, o: ChunkOptions) -> str:
    header, rows, _, _ = table(data, ChunkOptions(delimiter=o.delimiter, encoding=o.encoding))
    width = min(WIDEST, max([len(header), *map(len, rows)], default=0))
    if not width:
        return ""
    header = header + [f"Column {k + 1}" for k in range(len(header), width)]
    show = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([show(header), show(["---"] * width), *(show(r + [""] * (width - len(r))) for r in rows)])

"""Notebooks as Markdown: prose cells as they are, code fenced, outputs richest first."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass, field
from typing import Any

from ..functions import text as T
from ..options import ParseError
from .decode import decode_raw

LONGEST_OUTPUT, LARGEST_IMAGE = 4000, 64 * 1024 * 1024
_ANSI = re.compile("\x1b\\[[^@-~]*[@-~]?")


@dataclass
class Notebook:
    meta: dict
    markdown: str = ""
    images: list[tuple[str, bytes]] = field(default_factory=list)


def joined(v: Any) -> str:
    return v if isinstance(v, str) else "".join(x for x in v if isinstance(x, str)) if isinstance(v, list) else ""


def image(v: Any) -> bytes | None:
    data = joined(v)
    if not data or len(data) > LARGEST_IMAGE:
        return None
    try:
        return base64.b64decode("".join(data.split()), validate=True)
    except (ValueError, binascii.Error):
        return None


def capped(text: str) -> str:
    return text if len(text) <= LONGEST_OUTPUT else text[:LONGEST_OUTPUT] + "\n…[output truncated]"


def fenced(text: str, language: str = "") -> str:
    return f"```{language}\n{text}\n```"


def member(v: Any, *keys: str) -> Any:
    for k in keys:
        v = v.get(k) if isinstance(v, dict) else None
    return v


def output(out: dict, images: list[tuple[str, bytes]]) -> list[str]:
    kind = member(out, "output_type")
    if kind == "stream":
        text = joined(out.get("text")).rstrip(T.WHITE)
        return [fenced(capped(text))] if T.strip(text) else []
    if kind == "error":
        lines = member(out, "traceback")
        text = T.strip(_ANSI.sub("", "\n".join(x for x in lines if isinstance(x, str)) if isinstance(lines, list) else ""))
        return [fenced(capped(text))] if text else []
    if kind not in ("execute_result", "display_data"):
        return []
    data, made = member(out, "data") or {}, []
    if (png := image(member(data, "image/png"))) is not None:
        name = f"output_image_{1 + sum(n.startswith('output_image_') for n, _ in images)}.png"
        images.append((name, png))
        made.append(f"![]({name})")
    rich = [T.collapse(re.sub("<[^>]*>?", "", joined(member(data, "text/html")))), joined(member(data, "text/markdown")), joined(member(data, "text/x-rst"))]
    best = next((x for x in rich if T.strip(x)), None)
    plain = joined(member(data, "text/plain")).rstrip(T.WHITE)
    if best is not None:
        made.append(capped(T.strip(best)))
    elif T.strip(plain):
        made.append(fenced(capped(plain)))
    return made


def load(data: bytes | str) -> Notebook:
    try:
        root = json.loads((data if isinstance(data, str) else decode_raw(data)).removeprefix("﻿"))
    except ValueError as e:
        raise ParseError(f"Not a valid .ipynb (JSON) file: {e}") from e
    spec, version = member(root, "metadata", "kernelspec"), member(root, "nbformat")
    text = lambda v: v if isinstance(v, str) else None
    language = text(member(spec, "language")) or text(member(root, "metadata", "language_info", "name"))
    cells = member(root, "cells")
    if not isinstance(cells, list):
        sheets = member(root, "worksheets")
        cells = [c for w in sheets if isinstance(member(w, "cells"), list) for c in w["cells"]] if isinstance(sheets, list) else []
    nb = Notebook({"source_type": "ipynb", "language": language, "kernel": text(member(spec, "display_name")) or text(member(spec, "name")), "nbformat": None if version is None else f"{version}.{member(root, 'nbformat_minor') or 0}", "cell_count": len(cells)})
    kinds = [member(c, "cell_type") for c in cells]
    nb.meta |= {"code_cell_count": kinds.count("code"), "markdown_cell_count": kinds.count("markdown")}
    parts: list[str] = []
    for cell, kind in zip(cells, kinds, strict=True):
        source = joined(member(cell, "source") if isinstance(cell, dict) and "source" in cell else member(cell, "input"))
        body = source.rstrip(T.WHITE)
        if kind == "markdown":
            attached = member(cell, "attachments")
            for name, mimes in attached.items() if isinstance(attached, dict) else ():
                for mime, raw in mimes.items() if isinstance(mimes, dict) else ():
                    if mime.startswith("image/") and (got := image(raw)) is not None:
                        file = f"attachment_{name}.{mime.rpartition('/')[2]}"
                        nb.images.append((file, got))
                        body = body.replace(f"attachment:{name}", file)
            parts.append(body)
        elif kind == "heading":
            level = member(cell, "level")
            parts.append("#" * min(6, max(1, level if isinstance(level, int) else 1)) + " " + T.strip(source))
        else:
            if T.strip(source):
                parts.append(fenced(body, language or "") if kind == "code" else body)
            outputs = member(cell, "outputs") if kind == "code" else None
            for out in outputs if isinstance(outputs, list) else ():
                parts += output(out, nb.images)
    nb.markdown = T.strip("\n\n".join(parts))
    return nb

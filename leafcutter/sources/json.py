"""JSON documents and JSON lines as Markdown records."""

from __future__ import annotations

import json
from typing import Any

from ..functions import text as T
from ..options import ParseError
from .decode import decode_raw, decode_text

ENVELOPES = ("features", "data", "results", "items", "records", "rows")
DEEPEST, LONGEST = 6, 4000


def plain(v: Any) -> bool:
    return not isinstance(v, (dict, list))


def scalar(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def bullets(key: str, v: Any, depth: int = 0) -> list[str]:
    """``- **key:** value`` lines; members are indented; what lies too deep is compact JSON."""
    head = "  " * depth + f"- **{key}:**"
    if plain(v):
        return [f"{head} {scalar(v)}"]
    if isinstance(v, list) and all(map(plain, v)):
        return [f"{head} {', '.join(map(scalar, v))}"]
    if depth >= DEEPEST:
        s = scalar(v)
        raw = s.encode()
        return [f"{head} " + (s if len(raw) <= LONGEST else raw[:LONGEST].decode("utf-8", "ignore") + "…")]
    members = v.items() if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v))
    return [head, *(x for k, m in members for x in bullets(k, m, depth + 1))]


def record(v: Any) -> str:
    if plain(v):
        return scalar(v)
    if not v:
        return "(empty object)" if isinstance(v, dict) else "(empty array)"
    members = v.items() if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v))
    return "\n".join(x for k, m in members for x in bullets(k, m))


def document_records(data: bytes | str) -> list[str]:
    text = data if isinstance(data, str) else decode_raw(data)
    try:
        root = json.loads(text.removeprefix("﻿"))
    except ValueError as e:
        raise ParseError(f"Invalid JSON: {e}") from e
    if isinstance(root, list):
        return [record(x) for x in root]
    if isinstance(root, dict):
        key = next((k for k in ENVELOPES if isinstance(root.get(k), list) and root[k]), None)
        if key is not None:
            beside = [f"{k}: {scalar(v) if plain(v) else record(v).replace(chr(10), ' ')}" for k, v in root.items() if k != key]
            return ["\n".join(beside)] * bool(beside) + [record(x) for x in root[key]]
    return [record(root)]


def line_records(data: bytes | str) -> list[str]:
    out = []
    for raw in T.lines(data if isinstance(data, str) else decode_text(data)):
        s = T.strip(T.strip(raw).lstrip("\x1e"))
        if s:
            try:
                out.append(record(json.loads(s)))
            except ValueError:
                out.append(s)
    return out


def markdown(records: list[str]) -> str:
    return T.strip("\n\n".join(records))

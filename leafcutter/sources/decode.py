"""Bytes to text."""

from __future__ import annotations

import re


def _utf16_without_mark(data: bytes) -> str | None:
    """The byte order of UTF-16 without a mark: many zero bytes in one half of the places."""
    head = data[:4096]
    if len(head) < 4:
        return None
    even, odd = head[0::2].count(0) / len(head[0::2]), head[1::2].count(0) / max(1, len(head[1::2]))
    if odd >= 0.2 and even < 0.02:
        return "utf-16-le"
    return "utf-16-be" if even >= 0.2 and odd < 0.02 else None


def decode_raw(data: bytes) -> str:
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if (order := _utf16_without_mark(data)) is not None:
        return data.decode(order, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def decode_text(data: bytes) -> str:
    """Text with line ends as LF."""
    return re.sub("\r\n?", "\n", decode_raw(data))

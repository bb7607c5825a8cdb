"""Markdown: blocks by a walk over lines, and text without inline marks."""

from __future__ import annotations

import re

from ..functions import text as T
from ..operators.outline import CHUNK_SIZE, Rules, Unit, outline

#: Abbreviations after which no sentence ends.
ABBREVIATIONS = ("mr.", "mrs.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "approx.", "est.")


def sentences(text: str) -> list[str]:
    """Sentences end at a sign, one blank and a capital, but not after abbreviations, bare
    numbers and initials."""
    out, start = [], 0
    for m in re.finditer(r"[.?!](?= .)", text):
        end = m.end()
        if end <= start or not text[end + 1].isupper():
            continue
        before = T.ascii_lower(text[max(0, end - 40) : end])
        if m[0] == "." and (before.endswith(ABBREVIATIONS) or re.search(rf"(?:^|[{T.WHITE}])[0-9]+\.$", before) or re.search(r"[a-z]\.[a-z]\.$", before)):
            continue
        out.append(T.collapse(text[start:end]))
        start = end + 1
    return [s for s in [*out, T.collapse(text[start:])] if s]


RULES = Rules("md", preamble=None, section_flush_prose_only=True, lists_join=True, sentences=sentences)

_RULE = re.compile(r"-{3,}|\*{3,}|_{3,}")
_UNDER = re.compile("={3,}|-{3,}")
_ATX = re.compile("#{1,6} ")
_ITEM = re.compile(r"[-*+] |\[[xX ]\] |[0-9]{1,4}[.)].", re.S)
_MARK = re.compile(r"(?:[-*+] |\[[xX ]\] )|[0-9]{1,4}[.)] ")
KINDS = {"code": "code_block", "list": "bullet_list", "table": "table"}


def front_matter_off(text: str) -> str:
    m = re.match(r"---\n(?s:.*?)(?:^|\n)---[ \t]*(?:\n+|\Z)", text)
    return text[m.end() :] if m else text


def table_row(line: str) -> bool:
    cells = [c for c in map(T.strip, line.split("|")) if c]
    return "|" in line and len(cells) >= 2 and any(not c.startswith("[") or ("]" in c and "](#" not in c) for c in cells)


def real_table(rows: list[str]) -> bool:
    if len(rows) < 2:
        return False
    cells = [T.strip(c) for c in T.strip(rows[1]).strip("|").split("|")]
    ruled = all(re.fullmatch(":*-[-:]*", c) for c in cells)
    return ruled or all(r.startswith("|") and r.endswith("|") for r in map(T.strip, rows))


def line_kind(line: str, below: str | None) -> str:
    if not line:
        return "blank"
    if line.startswith("```"):
        return "fence"
    if _RULE.fullmatch(line):
        return "rule"
    if below is not None and _UNDER.fullmatch(below) and "|" not in line:
        return "underlined"
    if _ATX.match(line):
        return "atx"
    if _ITEM.match(line):
        return "list"
    return "table" if table_row(line) else "paragraph"


def raw_blocks(text: str) -> list[tuple[str, str]]:
    """``(kind, raw text)``; neighbouring lines of one kind form a block."""
    rows = T.lines(text) + ([""] if text.endswith("\n") else [])
    out: list[tuple[str, str]] = []
    held: list[str] = []
    open_: str | None = None

    def close():
        nonlocal open_
        body = T.strip("\n".join(held))
        if body:
            out.append(("paragraph" if open_ == "table" and not real_table(held) else open_, body))
        held.clear()
        open_ = None

    i = 0
    while i < len(rows):
        full = rows[i].rstrip(T.WHITE)
        line = T.strip(full)
        if open_ == "code":
            held.append(full)
            if line.startswith("```"):
                close()
            i += 1
            continue
        k = line_kind(line, T.strip(rows[i + 1]) if i + 1 < len(rows) else None)
        if k in ("list", "table", "paragraph"):
            if k != open_:
                close()
            open_ = k
            held.append(full if k == "list" else line)
        else:
            close()
            if k == "fence":
                open_ = "code"
                held.append(full)
            elif k == "underlined":
                out.append(("heading", f"{line}\n{T.strip(rows[i + 1])}"))
                i += 1
            elif k == "atx":
                out.append(("heading", line))
        i += 1
    close()
    return out


def blocks(text: str) -> list[tuple[str, str]]:
    """Raw blocks of bounded size; a cut table repeats its head."""
    out = []
    for kind, body in raw_blocks(text):
        if kind in ("table", "code"):
            parts = T.at_lines(body, CHUNK_SIZE, 2 if kind == "table" else 0)
        else:
            parts = T.bounded(body, CHUNK_SIZE)
        out += [(kind, p) for p in parts]
    return out


_PUNCT = r"[!-/:-@\[-`{-~]"
_INLINE = re.compile(
    rf"\\(?P<escape>{_PUNCT})"
    r"|<(?P<auto>[^\s<>]*[@:][^\s<>]*)>"
    r"|(?P<tag><[A-Za-z/][^>]*>)"
    r"|!\[(?P<alt>[^\]]*)\](?:\([^)]*\)?)?"
    r"|(?P<note>\[\^[^\]]*\]?)"
    r"|(?P<link>\[)"
    r"|~~(?P<strike>.*?)~~"
    r"|\*\*\*(?P<s3>.*?)\*\*\*|\*\*(?P<s2>.*?)\*\*|\*(?=[^ \t])(?P<s1>[^*]+)\*"
    r"|`(?P<code>[^`]*)`?"
    r"|(?P<word>(?<=[^\W_])_+(?=[^\W_]))"
    r"|___(?P<u3>.*?)___|__(?P<u2>.*?)__|_(?=[^ \t])(?P<u1>[^_]+)_",
    re.S,
)


def _image(alt: str) -> str:
    return f"[Image: {T.strip(alt)}]" if T.strip(alt) else "[Image]"


def plain(text: str) -> str:
    """Text without inline marks: links and emphasis by their text, raw tags dropped."""
    out, at = [], 0
    while m := _INLINE.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        kind, got = m.lastgroup, m[m.lastgroup] if m.lastgroup else ""
        if kind == "link":
            depth, end = 1, at
            while end < len(text) and depth:
                depth += {"[": 1, "]": -1}.get(text[end], 0)
                end += 1
            out.append(plain(text[at : end - 1 if depth == 0 else end]))
            at = end
            if at < len(text) and text[at] in "([":
                stop = text.find({"(": ")", "[": "]"}[text[at]], at + 1)
                at = len(text) if stop < 0 else stop + 1
        elif kind == "tag":
            img = re.match(r"(?is)<\s*img[ />]", got)
            if img:
                alt = re.search(r"""(?is)(?:alt|title)=(["'])(.*?)\1""", got)
                out.append(_image(alt[2] if alt else ""))
        elif kind == "alt":
            out.append(_image(got))
        elif kind == "code":
            out.append(T.strip(got))
        elif kind in ("escape", "auto", "word"):
            out.append(got)
        elif kind != "note":
            out.append(plain(got))
    return "".join(out) + text[at:]


def clean(body: str, bullets: bool) -> str:
    """Lines without quotes, inline marks and (for lists) bullets; a list keeps its indents."""
    out = []
    for line in T.lines(body):
        indent = min(24, sum(4 if c == "\t" else 1 for c in re.match("[ \t]*", line)[0])) if bullets else 0
        rest = re.sub(rf"^(?:>+[{T.WHITE}]*)+", "", line.lstrip(T.WHITE))
        if bullets and (m := _MARK.match(rest)):
            rest = rest[m.end() :].lstrip(T.WHITE)
        rest = T.strip(plain(rest))
        if rest:
            out.append(" " * indent + rest)
    return "\n".join(out)


def units(text: str, front_matter: bool = True) -> list[Unit]:
    found: list[tuple[str, str, int | None]] = []
    for kind, body in blocks(front_matter_off(text) if front_matter else text):
        if kind == "heading":
            first, _, below = body.partition("\n")
            level = min(6, len(first) - len(first.lstrip("#"))) if first.startswith("#") else 2 if below.startswith("-") else 1
            found.append(("heading", plain(T.strip(first.lstrip("#"))), level))
        elif kind == "code":
            found.append(("code_block", body, None))
        else:
            text_ = clean(body, kind == "list")
            if text_:
                found.append((KINDS.get(kind) or T.prose_kind(text_), text_, None))
    return outline(found)

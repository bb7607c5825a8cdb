"""Plain text: blocks and headings by their look."""

from __future__ import annotations

import re

from ..functions import text as T
from .outline import CHUNK_SIZE, Rules, Unit, outline

_UNDERLINE = re.compile("={4,}|-{4,}")
_ITEM = re.compile(r"[-*+] |\[[xX ]\]|[0-9]{1,3}[.)].|[A-Za-z][.)].", re.S)
#: Openings of shell lines.
COMMANDS = ("source ", "python ", "python3 ", "cargo ", "npm ", "yarn ", "cd ", "git ", "export ", "pip ", "pip3 ", "brew ", "apt ", "sudo ", "bash ", "sh ", "make ", "./", "docker ", "kubectl ")

#: This family knows one elaboration and one example opening less than the others.
RULES = Rules("txt", signals=tuple((r, tuple(x for x in s if x not in ("it should be noted", "as seen"))) for r, s in Rules("txt").signals))


def underline(line: str) -> bool:
    return _UNDERLINE.fullmatch(T.strip(line)) is not None


def item(line: str) -> bool:
    return _ITEM.match(T.strip(line)) is not None


def blocks(text: str) -> list[str]:
    """Stretches between blank lines, cut around underlined headings."""
    out = []
    for raw in text.split("\n\n"):
        every = T.lines(T.strip(raw))
        held: list[str] = []
        i = 0
        while i < len(every):
            two = i + 1 < len(every) and T.strip(every[i]) and underline(every[i + 1])
            if two:
                out += [x for x in [T.strip("\n".join(held))] if x]
                out.append(f"{T.strip(every[i])}\n{T.strip(every[i + 1])}")
                held = []
            else:
                held.append(every[i])
            i += 2 if two else 1
        out += [x for x in [T.strip("\n".join(held))] if x]
    return out


def capitals_heading(line: str) -> bool:
    letters = "".join(c for c in line if c.isalpha())
    if not letters or letters != letters.upper() or T.size(line) > 80 or "|" in line or len(letters) < 3:
        return False
    banner = line.startswith("***") and line.endswith("***")
    return not (banner or re.fullmatch(r"[IVXLCDM]+\.", line) or line.endswith((";", ",")))


def kind(block: str) -> str:
    rows = [x for x in map(T.strip, T.lines(block)) if x]
    if not rows:
        return "short_disconnected_paragraph"
    first, whole = rows[0], T.strip(block)
    bare = [T.strip(x.lstrip("#")) if x.startswith("#") else x for x in rows]
    if whole.startswith("```") or ((first == "{" or first.startswith('{"')) and whole.endswith("}")) or any(x.startswith(COMMANDS) for x in bare):
        return "code_block"
    if len(rows) == 2 and underline(rows[1]):
        return "heading"
    if len(rows) == 1 and (first.startswith(("# ", "## ")) or capitals_heading(first)):
        return "heading"
    if len(rows) >= 2 and 2 * sum("|" in x for x in rows) >= len(rows):
        return "table"
    if item(first) and 2 * sum(map(item, rows)) >= len(rows):
        return "bullet_list"
    n = T.size(block)
    return "long_single_paragraph" if n > 500 else "short_disconnected_paragraph" if n < 80 else "plain_paragraph"


def heading(block: str) -> tuple[str, int]:
    """Text and level of a heading block."""
    rows = T.lines(block)
    first = T.strip(rows[0])
    below = T.strip(rows[1]) if len(rows) > 1 else ""
    if re.fullmatch("={3,}|-{3,}", below):
        return (first if underline(below) else T.strip(first.lstrip("#"))), 1 if below[0] == "=" else 2
    level = next((n for n in (1, 2, 3) if first.startswith("#" * n + " ")), 2)
    return T.strip(first.lstrip("#")), level


def units(text: str) -> list[Unit]:
    found: list[tuple[str, str, int | None]] = []
    for block in blocks(text):
        whole = kind(block) in ("table", "code_block")
        for piece in [block] if whole else T.bounded(block, CHUNK_SIZE):
            k = kind(piece)
            if k == "heading":
                name, level = heading(piece)
                found.append((k, name, level))
            else:
                found.append((k, piece, None))
    return outline(found)

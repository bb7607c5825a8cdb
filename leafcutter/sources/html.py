"""HTML: blocks from a list of tags, with implied ends, loose text and raw elements.

One pass of a pattern finds all tags; blocks, lists and tables then work on that list and on
places in the source, so text is copied only when a block is made.
"""

from __future__ import annotations

import html.entities
import re
from dataclasses import dataclass

from ..functions import text as T
from ..operators.outline import CHUNK_SIZE, Rules, Unit, outline
from .decode import decode_raw

RULES = Rules("html", heading_seeds=True, least_size=20, with_path=True)

_SPACE = r"[ \t\n\r\f\v]"
_MARKUP = re.compile(
    r"(?P<skip><!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|>|\Z)|<![^>]*(?:>|\Z))"
    rf"|<{_SPACE}*(?P<close>/?)(?P<name>[A-Za-z0-9-]+)(?P<rest>[^>]*)>",
    re.S,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
IGNORED = frozenset("script style noscript head svg canvas".split())
LINE_BREAKING = frozenset("div section article main header footer form fieldset figure details dialog dl li tr td th caption br hr center body".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {
    **dict.fromkeys(HEADINGS, "heading"), "ul": "list", "ol": "list", "table": "table", "pre": "code",
    **dict.fromkeys("p blockquote figcaption summary legend label textarea option button address dd dt aside nav".split(), "paragraph"),
}
#: What ends an element whose end tag is left out.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}), "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}),
}
_ENTITY = re.compile("&([^;&]{1,12});")
_OWN = {"nbsp": " ", "bull": "*", "mdash": "-", "ndash": "-", "minus": "-"}


@dataclass(frozen=True)
class Tag:
    start: int
    end: int
    name: str
    closing: bool
    alone: bool


def tags(source: str) -> list[Tag]:
    out = []
    for m in _MARKUP.finditer(source):
        if m["skip"] is None:
            name = m["name"].lower()
            out.append(Tag(m.start(), m.end(), name, bool(m["close"]), name in VOID or m["rest"].endswith("/")))
        else:
            out.append(Tag(m.start(), m.end(), "", True, True))
    return out


def entities(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name in _OWN:
            return _OWN[name]
        if name.startswith("#"):
            try:
                return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
            except (ValueError, OverflowError):
                return m[0]
        return html.entities.html5.get(name + ";", m[0])

    return _ENTITY.sub(one, text)


def words(source: str, breaks: bool = True) -> str:
    """Text without tags; some tags are line ends."""

    def one(m: re.Match) -> str:
        if m["skip"] is not None:
            return m[0] if m[0].startswith("<!") else ""
        return "\n" if breaks and m["name"].lower() in ("br", "p", "li", "tr") else ""

    return entities(_MARKUP.sub(one, source))


def inline(source: str) -> str:
    out = []
    for line in T.lines(words(source)):
        bare = re.sub(r"<([A-Za-z0-9/_-]+)>", lambda m: m[1].strip("/"), T.collapse(line))
        if bare := T.collapse(bare):
            out.append(bare)
    return "\n".join(out)


def code(source: str) -> str:
    return T.strip("\n".join(x for x in (y.rstrip(T.WHITE) for y in T.lines(words(source, breaks=False))) if T.strip(x)))


def noise(text: str) -> bool:
    return re.fullmatch(r"[|\-_*=.]*", T.strip(text)) is not None


def end_of(every: list[Tag], k: int, size: int) -> tuple[int, int]:
    """Where the element that tag ``k`` opens ends, and the first tag after it."""
    name, depth = every[k].name, 1
    for j in range(k + 1, len(every)):
        t = every[j]
        if t.name == name:
            depth += -1 if t.closing else 0 if t.alone else 1
            if not depth:
                return t.end, j + 1
    open_: list[str] = []
    for j in range(k + 1, len(every)):
        t = every[j]
        if not t.name:
            continue
        if t.closing:
            if t.name not in open_:
                return t.start, j
            while open_.pop() != t.name:
                pass
        elif not open_ and t.name in ENDED_BY.get(name, ()):
            return t.start, j
        elif not t.alone:
            open_.append(t.name)
    return size, len(every)


def inner(source: str) -> str:
    """What lies between an element's first tag and its last end tag."""
    first = tags(source)[0]
    close = source.lower().rfind(f"</{first.name}")
    return source[first.end : close if close >= first.end else len(source)]


def elements(source: str, name: str, around: str | None = None) -> list[str]:
    """The outermost elements of a name. With ``around``, what lies in nested containers of
    that name is passed over and ends are explicit."""
    every, out, k = tags(source), [], 0

    def past(k: int, name: str) -> int:
        depth = 1
        while k < len(every):
            t = every[k]
            if name != around and t.name == around and not t.closing and not t.alone:
                k = past(k + 1, around)
                continue
            k += 1
            if t.name == name and not t.alone:
                depth += -1 if t.closing else 1
                if not depth:
                    return k
        return k

    while k < len(every):
        t = every[k]
        if around and name != around and t.name == around and not t.closing and not t.alone:
            k = past(k + 1, around)
        elif t.closing or t.name != name or (around and t.alone):
            k += 1
        elif around:
            nxt = past(k + 1, name)
            last = every[nxt - 1]
            out.append(source[t.start : last.end if nxt > k + 1 and last.closing and last.name == name else len(source)])
            k = nxt
        else:
            end, nxt = end_of(every, k, len(source))
            out.append(source[t.start : end])
            k = max(nxt, k + 1)
    return out


def table(source: str, between: str = "\n") -> str:
    rows = []
    for tr in elements(inner(source), "tr", "table"):
        cells = []
        for kind in ("th", "td"):
            for cell in elements(tr, kind, "table"):
                own = inner(cell)
                nested = elements(own, "table")
                for x in nested:
                    own = own.replace(x, " ")
                parts = [p for p in (inline(own), *(table(x, " / ") for x in nested)) if p]
                if parts:
                    cells.append(" ".join(parts))
        if cells:
            rows.append(" | ".join(cells))
    return between.join(rows)


def content(source: str, kind: str) -> str:
    if kind == "table":
        return table(source)
    if kind == "list":
        return "\n".join(x for x in (inline(inner(li)) for li in elements(source, "li")) if x)
    if kind == "code":
        return code(inner(source))
    text = inline(inner(source))
    return "" if noise(text) else text


def blocks(source: str) -> list[tuple[str, str, int | None, bool]]:
    """``(kind, text, heading level, ordered)`` in order of the source."""
    source = re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", source)
    every, out, loose = tags(source), [], []
    at = k = 0

    def line_end():
        if not loose or not loose[-1].endswith("\n"):
            loose.append("\n")

    def close():
        text = inline("".join(loose))
        loose.clear()
        if text and not noise(text):
            out.append(("paragraph", text, None, False))

    while k < len(every):
        t = every[k]
        if t.start > at:
            loose.append(source[at : t.start])
        at, k = t.end, k + 1
        if not t.name:
            continue
        if t.closing:
            if t.name in LINE_BREAKING:
                line_end()
        elif t.name in IGNORED:
            close()
            if t.name in RAW:
                m = re.compile(f"(?i)</{t.name}[^>]*>?").search(source, t.end)
                at = m.end() if m else len(source)
            else:
                at = next((e for e, n in [end_of(every, k - 1, len(source))] if every[n - 1].closing and every[n - 1].name == t.name), len(source))
            while k < len(every) and every[k].start < at:
                k += 1
        elif t.name in BLOCKS:
            close()
            end, k = end_of(every, k - 1, len(source))
            kind = BLOCKS[t.name]
            if text := content(source[t.start : end], kind):
                out.append((kind, text, HEADINGS.get(t.name), t.name == "ol"))
            at = end
        elif t.name in LINE_BREAKING:
            line_end()
    loose.append(source[at:])
    close()
    return out


def units(data: bytes | str) -> list[Unit]:
    found: list[tuple[str, str, int | None]] = []
    for kind, text, level, _ in blocks(data if isinstance(data, str) else decode(data)):
        parts = [text] if kind in ("table", "code") or len(text) <= CHUNK_SIZE else T.bounded(text, CHUNK_SIZE)
        name = {"heading": "heading", "list": "bullet_list", "table": "table", "code": "code_block"}.get(kind)
        found += [(name or T.prose_kind(p), p, level) for p in parts]
    return outline(found)


def markdown(data: bytes | str) -> str:
    out = []
    for kind, text, level, ordered in blocks(data if isinstance(data, str) else decode(data)):
        if kind == "heading":
            out.append("#" * level + " " + text.replace("\n", " "))
        elif kind == "list":
            out.append("\n".join((f"{i + 1}. " if ordered else "- ") + x for i, x in enumerate(text.split("\n"))))
        elif kind == "code":
            out.append(f"```\n{text}\n```")
        elif kind == "table":
            rows = ["| " + " | ".join(c.replace("|", "\\|") for c in r.split(" | ")) + " |" for r in text.split("\n")]
            if len(rows) > 1:
                rows.insert(1, "| " + " | ".join("---" for _ in text.split("\n")[0].split(" | ")) + " |")
            out.append("\n".join(rows))
        else:
            out.append(text)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out))


def decode(data: bytes) -> str:
    """A mark or UTF-16 first, then valid UTF-8, then the declared charset."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or data.startswith(b"\xef\xbb\xbf"):
        return decode_raw(data)
    try:
        text = data.decode("utf-8")
        return decode_raw(data) if "\0" in text[:4096] else text
    except UnicodeDecodeError:
        m = re.search(rb"(?is)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", data[:1024])
        try:
            return data.decode(m[1].decode(), "replace") if m else decode_raw(data)
        except LookupError:
            return decode_raw(data)



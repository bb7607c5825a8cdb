"""Text kernel: white space, lines, sentences, keywords and size-bounded packing.

Sizes are UTF-8 bytes where a name says ``size`` and code points where it says ``chars``.
"""

from __future__ import annotations

import re

#: Unicode White_Space (Python's own set has four control characters more).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SENTENCE_END = re.compile(f"(?<=[.!?])(?=[{WHITE}])")
_SPACES = re.compile(f"[{WHITE}]+")

#: Words that are no keywords.
STOPWORDS = frozenset(
    "the and for are was were this that with from have been will they their which about into more also when than "
    "those these each such some can all any but not its has had you your our use used using may must should would "
    "could both over after then there here only just even very well now new way get set let run see per via etc "
    "one two three four five first last next same other while where how what who".split()
)

#: Openings that decide whether a paragraph goes on from the one before it.
TRANSITION_BREAKS = ("however", "nevertheless", "in contrast", "on the other hand", "meanwhile", "conversely", "that said", "in summary", "to summarize", "to conclude", "in conclusion", "to wrap up", "overall", "in closing")
REFERENCE_STARTS = ("this ", "it ", "they ", "these ", "that ", "those ", "its ", "their ", "such ", "the above", "the following", "the latter", "the former")
ELABORATION_STARTS = ("additionally", "furthermore", "moreover", "in addition", "what is more", "on top of that", "notably", "importantly", "it is worth", "it should be noted", "equally", "similarly", "likewise")
EXAMPLE_STARTS = ("for example", "for instance", "such as", "e.g.", "i.e.", "as an example", "to illustrate", "consider ", "as shown", "as seen", "as demonstrated", "take ", "imagine ")
CAUSE_EFFECT_STARTS = ("because", "therefore", "thus", "hence", "as a result", "consequently", "this means", "this leads", "this causes", "this results", "this implies", "this suggests", "so ")
CONTRAST_CONTINUATION = ("although", "even though", "despite", "whereas", "even if", "regardless", "notwithstanding", "while it", "while this")

SEMANTIC_SIZE, SHORT_SIZE = 1500, 80


def strip(text: str) -> str:
    return text.strip(WHITE)


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def lines(text: str) -> list[str]:
    """Lines end with LF or CRLF; a final line end opens no further line."""
    out = [x.removesuffix("\r") for x in text.split("\n")]
    if out and out[-1] == "" and text.endswith("\n"):
        out.pop()
    return out if text else []


def collapse(text: str) -> str:
    return strip(_SPACES.sub(" ", text))


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def starts_with(text: str, openings: tuple[str, ...]) -> bool:
    return ascii_lower(text[:24]).startswith(openings)


def keywords(text: str) -> set[str]:
    return {w for w in re.split("[^a-z0-9]+", ascii_lower(text)) if len(w) >= 4} - STOPWORDS


def sentences(text: str) -> list[str]:
    return [s for s in map(strip, _SENTENCE_END.split(text)) if s]


def packed(parts: list[str], limit: int, glue: str, measure=size) -> list[str]:
    """Neighbouring parts joined while they stay within ``limit``; a larger part stands alone."""
    out: list[str] = []
    held = None
    for p in parts:
        joined = p if held is None or held == "" else held + glue + p
        if held is None or held == "" or measure(joined) <= limit:
            held = joined
        else:
            out.append(held)
            held = p
    return out + [held] if held is not None else out


def at_sentences(text: str, limit: int) -> list[str]:
    """Sentences packed into pieces of at most ``limit`` bytes."""
    if size(text) <= limit:
        return [strip(text)]
    return [x for x in map(strip, packed(sentences(text), limit, " ")) if x] or [strip(text)]


def at_words(text: str, chars: int) -> list[str]:
    """Pieces of at most ``chars`` code points, cut at the last white space if there is one."""
    out = []
    while len(text) > chars:
        at = max((i for i in range(chars - 1, 0, -1) if text[i] in WHITE), default=chars)
        if strip(text[:at]):
            out.append(text[:at].rstrip(WHITE))
        text = text[at:].lstrip(WHITE)
    return out + [text] if strip(text) else out


def at_lines(text: str, chars: int, repeat: int = 0) -> list[str]:
    """Lines packed into pieces of at most ``chars`` code points; the first ``repeat`` lines
    (a table's head) stand in each piece."""
    if len(text) <= chars:
        return [text]
    every = lines(text)
    head, rest = every[:repeat], every[repeat:]
    base = sum(len(x) + 1 for x in head)
    pieces: list[list[str]] = [[]]
    used = base
    for x in rest:
        if pieces[-1] and used + len(x) + 1 > chars:
            pieces.append([])
            used = base
        pieces[-1].append(x)
        used += len(x) + 1
    return ["\n".join(head + p) for p in pieces]


def bounded(text: str, chars: int) -> list[str]:
    """Lines, then sentences, then words, until pieces have at most ``chars`` code points."""
    out: list[str] = []
    for piece in at_lines(text, chars):
        if len(piece) <= chars:
            out.append(piece)
            continue
        for s in at_sentences(piece, chars):
            out += [s] if len(s) <= chars and strip(s) else at_words(s, chars)
    return out or [text]


def prose_kind(text: str) -> str:
    n = size(text)
    return "long_single_paragraph" if n > 900 else "short_disconnected_paragraph" if n < 90 else "plain_paragraph"


def content_hash(data: bytes) -> str:
    """FNV-1a, 64 bits, as 16 hex digits: the name of an extracted image."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"

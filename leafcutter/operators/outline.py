"""Grouping modes over an outline: units of text that know the headings above them.

A family (plain text, Markdown, HTML) turns a document into units; the modes here fold
the units of one document into chunks. What differs between families is data in a ``Rules``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import text as T
from ..options import ChunkOptions

PROSE = frozenset({"plain_paragraph", "long_single_paragraph", "short_disconnected_paragraph"})
CHUNK_SIZE, LEAST_SIZE, SECTION_SIZE = 1200, 350, 2000


@dataclass
class Unit:
    """A block. ``heading``, ``path``, ``depth``: the innermost heading, all headings, and the
    innermost level after this unit; ``above``: the innermost heading before it."""

    kind: str
    text: str
    level: int | None = None
    heading: str | None = None
    path: list[str] = field(default_factory=list)
    depth: int = 0
    above: str | None = None


@dataclass(frozen=True)
class Rules:
    source: str
    preamble: str | None = "Preamble"
    #: Kinds that only flush an over-full section when they are prose.
    section_flush_prose_only: bool = False
    #: Openings by reason, in order of priority.
    signals: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("reference_continuity", T.REFERENCE_STARTS), ("elaboration", T.ELABORATION_STARTS), ("example", T.EXAMPLE_STARTS),
        ("cause_effect", T.CAUSE_EFFECT_STARTS), ("contrast_continuation", T.CONTRAST_CONTINUATION),
    )
    #: Lists go on from prose instead of standing alone.
    lists_join: bool = False
    #: Semantic chunks start with their heading; others below a size are dropped before numbering.
    heading_seeds: bool = False
    least_size: int = 0
    #: Splits prose into sentences.
    sentences: Callable[[str], list[str]] = T.sentences
    #: Structural chunks carry all headings above them.
    with_path: bool = False


@dataclass
class Chunk:
    content: str
    content_type: str
    metadata: dict


def outline(blocks: list[tuple[str, str, int | None]]) -> list[Unit]:
    """Units from ``(kind, text, level)``; a heading closes all headings of its level or below."""
    stack: list[tuple[int, str]] = []
    out = []
    for kind, text, level in blocks:
        above = stack[-1][1] if stack else None
        if level is not None:
            stack = [x for x in stack if x[0] < level] + [(level, text)]
        last = stack[-1] if stack else (0, None)
        out.append(Unit(kind, text, level, last[1], [t for _, t in stack], last[0], above))
    return out


def _doc(rules: Rules, total: int) -> dict:
    return {"source_type": rules.source, "total_input_blocks": total}


def structural(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """Headings, tables, code and lists alone; prose packed, then short pieces joined to the one before."""
    made: list[Chunk] = []
    held: list[str] = []
    used = 0

    def meta(heading):
        out = {"footnotes_captions": [], "page_number": None, "section_heading": heading, "document_metadata": {"source_type": rules.source}}
        return out | {"heading_path": path, "section_level": depth} if rules.with_path else out

    def close(heading):
        nonlocal used
        content = T.strip("\n".join(held))
        held.clear()
        used = 0
        if content:
            made.append(Chunk(content, T.prose_kind(content), meta(heading)))

    heading, path, depth = None, [], 0
    for u in units:
        if u.kind not in PROSE:
            close(heading)
            if u.level is not None:
                heading, path, depth = u.text, u.path, u.level
            made.append(Chunk(u.text, u.kind, meta(None if u.level is not None else heading)))
            continue
        for part in T.at_sentences(u.text, CHUNK_SIZE) if T.size(u.text) > CHUNK_SIZE else [u.text]:
            n = T.size(part) + 1
            if held and used + n > CHUNK_SIZE:
                close(heading)
            held.append(part)
            used += n
    close(heading)
    out: list[Chunk] = []
    for c in made:
        last = out[-1] if out else None
        fits = last and c.content_type in PROSE and last.content_type in PROSE and T.size(c.content) < LEAST_SIZE
        if fits and T.size(last.content) + T.size(c.content) < CHUNK_SIZE + LEAST_SIZE:
            last.content = T.strip(f"{last.content}\n{c.content}")
            last.content_type = T.prose_kind(last.content)
        else:
            out.append(c)
    return out


SECTION_KINDS = {**dict.fromkeys(PROSE, "paragraph"), "bullet_list": "list", "code_block": "code_block", "table": "table"}


def section(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """A heading, then all that follows it up to the next one, in pieces of bounded size."""
    total, out = len(units), []
    runs: list[tuple[Unit | None, list[Unit]]] = []  # heading (None: before any) and body
    for u in units:
        if u.level is not None:
            runs.append((u, []))
        else:
            if not runs:
                runs.append((None, []))
            body = runs[-1][1]
            held = sum(T.size(x.text) for x in body) + 2 * max(0, len(body) - 1)
            counts = not rules.section_flush_prose_only or u.kind in PROSE
            if body and counts and held + T.size(u.text) + 2 > SECTION_SIZE:
                runs.append((runs[-1][0], [u]))
            else:
                body.append(u)
    shown: set[int] = set()
    for head, body in runs:
        name = head.text if head else rules.preamble
        level, path = (head.level, head.path) if head else (0, [])
        if head and id(head) not in shown:
            shown.add(id(head))
            out.append(Chunk(head.text, "heading", {"section_heading": name, "section_level": level, "heading_path": path, "paragraph_count": 0, "block_types": ["heading"], "char_count": T.size(head.text), "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
        joined = "\n\n".join(u.text for u in body)
        if not T.strip(joined):
            continue
        kinds = [SECTION_KINDS.get(u.kind, "other") for u in body]
        parts = [T.strip(joined)] if T.size(joined) <= SECTION_SIZE else [T.strip(p) for p in T.packed(joined.split("\n\n"), SECTION_SIZE, "\n\n")]
        for i, p in enumerate(parts):
            if p:
                many = len(parts) > 1
                out.append(Chunk(p, "section", {"section_heading": name, "section_level": level, "heading_path": path, "paragraph_count": sum(k in ("paragraph", "list") for k in kinds), "block_types": list(dict.fromkeys(kinds)), "char_count": T.size(p), "split_part": i + 1 if many else None, "split_total": len(parts) if many else None, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
    return out


def merge_reason(text: str, held: list[str], held_size: int, known: set[str], rules: Rules, is_list: bool = False, after_heading: bool = False) -> str | None:
    """Why a paragraph goes on from those held, or None for a break; the first rule decides."""
    if held_size + T.size(text) + 2 > T.SEMANTIC_SIZE:
        return None
    if after_heading:
        return "heading_merge"
    start = text.lstrip(T.WHITE)
    if T.starts_with(start, T.TRANSITION_BREAKS):
        return None
    for reason, openings in rules.signals:
        if T.starts_with(start, openings):
            return reason
    last = held[-1].rstrip(T.WHITE)
    if last.endswith("?"):
        return "question_answer"
    if T.size(held[-1]) <= 80 and last.endswith(":") and T.size(text) > 60:
        return "definition_expansion"
    if T.size(text) <= T.SHORT_SIZE:
        return "short_paragraph"
    if is_list:
        return "list_continuation"
    return "keyword_overlap" if known & T.keywords(text) else None


def semantic(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """Paragraphs joined while signals say that they go on; all else stands alone."""
    total = len(units)
    out: list[Chunk] = []
    held: list[tuple[str, str]] = []  # text, reason
    known: set[str] = set()
    used = 0
    at: Unit | None = None
    seeded = False

    def close():
        if not held:
            return
        content = "\n\n".join(t for t, _ in held)
        reasons = [r for _, r in held if r != "initial"]
        ranked = sorted(Counter(reasons).items(), key=lambda x: (-x[1], x[0]))
        words = max(1, len([w for w in content.translate(_TO_SPACE).split(" ") if w]))
        if rules.heading_seeds:
            bare = seeded and len(held) == 1
            first = "heading" if bare else ranked[0][0] if ranked else "initial"
            if bare or T.size(T.strip(content)) >= rules.least_size:
                out.append(Chunk(content, "heading" if bare else "semantic", {
                    "section_heading": at.above if seeded else at.heading, "heading_path": at.path, "section_level": at.depth, "paragraph_count": len(held),
                    "merge_reasons": list(dict.fromkeys(reasons)), "primary_merge_reason": first, "merge_reason": first,
                    "keyword_density": int(len(known) / words * 1000 + 0.5) / 1000, "chunk_index": len(out), "has_body_content": not bare, "document_metadata": _doc(rules, total),
                }))
            held.clear()
            return
        out.append(Chunk(content, "semantic", {
            "section_heading": at.heading, "heading_path": at.path, "section_level": at.depth, "paragraph_count": len(held),
            "merge_reasons": list(dict.fromkeys(reasons)), "primary_merge_reason": ranked[0][0] if ranked else "initial",
            "keyword_density": int(len(known) / words * 1000 + 0.5) / 1000, "avg_block_length": sum(T.size(t) for t, _ in held) // len(held),
            "chunk_index": len(out), "document_metadata": _doc(rules, total),
        }))
        held.clear()

    for u in units:
        if u.level is not None and rules.heading_seeds:
            close()
            at, used, known, seeded = u, T.size(u.text), set(), True
            held.append((u.text, "initial"))
        elif u.level is not None:
            close()
            out.append(Chunk(u.text, "heading", {"section_heading": u.path[-2] if len(u.path) > 1 else None, "heading_path": u.path, "section_level": u.level, "paragraph_count": 0, "merge_reasons": [], "primary_merge_reason": "initial", "keyword_density": 0.0, "avg_block_length": T.size(u.text), "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
        elif u.kind not in PROSE and not (rules.lists_join and u.kind == "bullet_list"):
            close()
            if not rules.heading_seeds:
                out.append(Chunk(u.text, u.kind, {"section_heading": u.heading, "heading_path": u.path, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
            elif T.size(T.strip(u.text)) >= rules.least_size:
                out.append(Chunk(u.text, u.kind, {"section_heading": u.heading, "heading_path": u.path, "section_level": u.depth, "footnotes_captions": [], "page_number": None, "document_metadata": {"source_type": rules.source}}))
        elif text := T.strip(u.text):
            reason = merge_reason(text, [t for t, _ in held], used, known, rules, u.kind == "bullet_list", seeded and len(held) == 1) if held else None
            if reason is None:
                close()
                at, used, known, seeded = u, T.size(text), set(T.keywords(text)), False
                held.append((text, "initial"))
            else:
                used += T.size(text) + 2
                known |= T.keywords(text)
                held.append((text, reason))
    close()
    return out


_TO_SPACE = {ord(c): " " for c in T.WHITE}


def sentence(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """A fixed number of sentences per chunk; a list's lines are sentences; code and tables alone."""
    total, n, out = len(units), o.sentences_per_chunk, []
    held: list[tuple[str, int, Unit]] = []
    paragraph = 0

    def close():
        for i in range(0, len(held), n):
            part = held[i : i + n]
            out.append(Chunk(" ".join(s for s, _, _ in part), "sentence", {"sentences_per_chunk": n, "actual_sentence_count": len(part), "chunk_index": len(out), "source_paragraph_index": part[0][1], "section_heading": part[0][2].heading, "heading_path": part[0][2].path, "document_metadata": _doc(rules, total)}))
        held.clear()

    for u in units:
        if u.level is not None:
            close()
            out.append(Chunk(u.text, "heading", {"section_heading": u.text, "section_level": u.level, "heading_path": u.path, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
            continue
        if u.kind in ("code_block", "table"):
            close()
            out.append(Chunk(u.text, u.kind, {"section_heading": u.heading, "heading_path": u.path, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
        else:
            found = [x for x in map(T.strip, T.lines(u.text)) if x] if u.kind == "bullet_list" else rules.sentences(u.text)
            held += [(s, paragraph, u) for s in found]
        paragraph += 1
    close()
    return out


def page_aware(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """Pages end at headings and after a fixed number of blocks."""
    total, out = len(units), []
    pages: list[tuple[str, list[Unit]]] = []  # kind of break, blocks; a heading is a page of its own
    for u in units:
        if u.level is not None:
            pages += [("heading", [u]), ("heading_boundary", [])]
        else:
            if not pages or pages[-1][0] == "heading" or len(pages[-1][1]) >= o.paragraphs_per_page:
                pages.append(("estimated", []))
            pages[-1][1].append(u)
    for kind, body in pages:
        if not body:
            continue
        u = body[0]
        if kind == "heading":
            out.append(Chunk(u.text, "heading", {"page_break_type": "heading_boundary", "paragraph_count": 0, "section_heading": u.text, "section_level": u.level, "heading_path": u.path, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
        else:
            out.append(Chunk("\n\n".join(x.text for x in body), "page_aware", {"page_break_type": kind, "paragraph_count": len(body), "section_heading": u.heading, "heading_path": u.path, "chunk_index": len(out), "document_metadata": _doc(rules, total)}))
    return out


def sliding_window(units: list[Unit], rules: Rules, o: ChunkOptions) -> list[Chunk]:
    """Windows of a fixed number of units; the last is the first that reaches the end."""
    total, w, step = len(units), o.window_size, o.window_size - o.overlap
    full = [(t, u) for u in units if (t := T.strip(u.text))]
    if not full:
        return []
    count = max(0, -(-(len(full) - w) // step)) + 1
    out = []
    for i in range(count):
        part = full[i * step : i * step + w]
        first = part[0][1]
        out.append(Chunk("\n\n".join(t for t, _ in part), "sliding_window", {"window_size": w, "overlap": o.overlap, "window_index": i, "paragraph_range": [i * step, i * step + len(part) - 1], "paragraph_count": len(part), "section_heading": first.heading, "heading_path": first.path, "chunk_index": i, "document_metadata": _doc(rules, total)}))
    return out


BUILDERS = {"default": structural, "structural": structural, "section": section, "semantic": semantic, "sentence": sentence, "page_aware": page_aware, "sliding_window": sliding_window}

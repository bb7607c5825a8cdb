"""Mail messages and mailboxes as Markdown."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from dataclasses import dataclass, field
from email.message import EmailMessage, Message

from ..functions import text as T
from ..operators.outline import Chunk
from ..options import ParseError
from . import html

#: Text that is no prose.
NO_PROSE = frozenset({"text/css", "text/javascript", "application/javascript"})
IMAGE_ENDINGS = (("png", ".png"), ("jpeg", ".jpg"), ("jpg", ".jpg"), ("gif", ".gif"), ("webp", ".webp"), ("bmp", ".bmp"))
_HEADER = re.compile(rb"[!-9;-~]{1,99}:")
_ESCAPED = re.compile(rb"(?m)^>(>*From )")


@dataclass
class Mail:
    meta: dict
    body: str
    attachments: list[tuple[str | None, str | None, str | None]] = field(default_factory=list)  # name, type, text
    images: list[tuple[str, bytes]] = field(default_factory=list)


def _header(msg: Message, name: str) -> str | None:
    try:
        value = msg[name]
        return T.strip(re.sub(r"\s*\r?\n\s*", " ", str(value))) or None if value is not None else None
    except (ValueError, IndexError, LookupError, TypeError):  # what the parser of a broken header may raise
        return None


def _addresses(msg: Message, name: str) -> list[str]:
    pairs = email.utils.getaddresses([_header(msg, name) or ""], strict=False)
    return [f"{n} <{a}>" if n and a else a or n for n, a in ((T.strip(n), T.strip(a)) for n, a in pairs) if n or a]


def _ids(msg: Message, name: str) -> list[str]:
    return [x.strip("<>") for x in (_header(msg, name) or "").split()]


def _date(msg: Message) -> str | None:
    try:
        d = email.utils.parsedate_to_datetime(_header(msg, "Date") or "")
    except (ValueError, TypeError, OverflowError):
        return None
    text = d.isoformat()
    return text.replace("+00:00", "Z") if d.utcoffset() is not None else text + "Z"


def _bytes(part: Message) -> bytes:
    got = part.get_payload(decode=True)
    return got if isinstance(got, bytes) else b""


def _text(part: Message) -> str:
    raw, charset = _bytes(part), part.get_content_charset() or "utf-8"
    try:
        text = raw.decode(charset, "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    # a wrong declaration: many replacements, and the bytes are better UTF-8
    if text and 20 * text.count("�") >= len(text):
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return text.replace("\r\n", "\n")


def _readable(text: str) -> str | None:
    t = T.strip(text)
    odd = sum(ord(c) < 32 and c not in "\n\r\t" or 127 <= ord(c) < 160 for c in t)
    return t if t and "\0" not in t and (len(t) - odd) * 20 >= len(t) * 19 else None


def load(data: bytes) -> Mail:
    try:
        msg = email.message_from_bytes(data, policy=email.policy.default.clone(raise_on_defect=False))
    except Exception as e:  # the parser promises nothing about hostile headers
        raise ParseError(f"not a parseable RFC822 message: {e}") from e
    if not msg.keys():
        raise ParseError("not a parseable RFC822 message")
    return _mail(msg)


def _mail(msg: EmailMessage | Message) -> Mail:
    attached, leaves = [], []

    def walk(part: Message):
        if part.get_content_maintype() == "multipart":
            for p in part.get_payload() if isinstance(part.get_payload(), list) else []:
                walk(p)
        elif part.get_content_type() == "message/rfc822" or part.get_content_disposition() == "attachment" or (part.get_content_maintype() not in ("text",) and part is not msg):
            attached.append(part)
        else:
            leaves.append(part)

    walk(msg)
    plain = [p for p in leaves if p.get_content_type() == "text/plain"]
    rich = [p for p in leaves if p.get_content_type() == "text/html"]
    body = T.strip(_text(plain[0])) if plain else ""
    if not body and rich:
        body = T.strip(html.markdown(_text(rich[0])))
    if not body:
        prose = [p for p in leaves if p.get_content_maintype() == "text" and p.get_content_type() not in NO_PROSE and p.get_content_type() != "text/html"]
        body = "\n\n".join(x for x in (T.strip(_text(p)) for p in prose) if x)
    used = {id(p) for p in (*plain[:1], *rich[:1])}
    sent = _addresses(msg, "From")
    mail = Mail({"subject": _header(msg, "Subject"), "from": sent[0] if sent else None, "to": _addresses(msg, "To"), "cc": _addresses(msg, "Cc"), "bcc": _addresses(msg, "Bcc"), "date": _date(msg), "message_id": (_ids(msg, "Message-ID") or [None])[0], "in_reply_to": _ids(msg, "In-Reply-To"), "references": _ids(msg, "References")}, body)
    unnamed = 0
    for p in [*attached, *(x for x in leaves if id(x) not in used and x is not msg and x.get_content_maintype() != "multipart" and x not in plain)]:
        kind, name = p.get_content_type(), p.get_filename()
        if kind == "message/rfc822":
            inner = p.get_payload()
            nested = _mail(inner[0]) if isinstance(inner, list) and inner else None
            mail.attachments.append((name, kind, markdown(nested, 3) or None if nested else None))
            mail.images += nested.images if nested else []
        elif kind.startswith("image/"):
            if not name:
                unnamed += 1
                name_ = f"image_{unnamed}" + next((end for key, end in IMAGE_ENDINGS if key in kind), ".bin")
            mail.images.append((name or name_, _bytes(p)))
            mail.attachments.append((name, kind, None))
        elif p.get_content_maintype() == "text":
            text = html.markdown(_text(p)) if kind == "text/html" else _text(p)
            mail.attachments.append((name, kind, None if kind in NO_PROSE else _readable(text)))
        else:
            mail.attachments.append((name, kind, None))
    return mail


def markdown(mail: Mail, level: int = 1) -> str:
    m = mail.meta
    head = [f"**{k}:** {v}" for k, v in (("From", m["from"]), ("To", ", ".join(m["to"])), ("Cc", ", ".join(m["cc"])), ("Date", m["date"])) if v]
    parts = ["#" * level + f" {m['subject']}"] if m["subject"] else []
    parts += ["  \n".join(head)] if head else []
    parts += [mail.body] if mail.body else []
    if mail.attachments:
        items = [f"- {name or '(unnamed)'}" + (f" ({kind})" if kind else "") + (f"\n\n{text}" if text else "") for name, kind, text in mail.attachments]
        parts.append("## Attachments\n\n" + "\n".join(items))
    return T.strip("\n\n".join(parts))


def messages(data: bytes) -> list[bytes]:
    """A mailbox's messages. ``From `` opens one on the first line, or where what follows on the
    line is a postmark and the next line is a header; escaped ones lose a ``>``."""
    lines, out = data.splitlines(keepends=True) if b"\r" not in data.replace(b"\r\n", b"") else re.findall(rb"[^\n]*\n|[^\n]+\Z", data), [[]]
    for i, line in enumerate(lines):
        tail = line[5:].strip()
        mark = not tail or tail == b"-" or (b":" in tail and re.search(rb"[0-9]", tail))
        if line.startswith(b"From ") and (i == 0 or (mark and i + 1 < len(lines) and _HEADER.match(lines[i + 1]))):
            out.append([])
        else:
            out[-1].append(line)
    return [_ESCAPED.sub(rb"\1", b"".join(x)) for x in out if x]


@dataclass
class Mailbox:
    meta: dict
    markdown: str
    infos: dict[int, dict]
    images: list[tuple[str, bytes]]


def load_mailbox(data: bytes) -> Mailbox:
    every = messages(data)
    parts, infos, skipped, images = [f"# Mailbox — {len(every)} message{'' if len(every) == 1 else 's'}"], {}, [], []
    for n, raw in enumerate(every, 1):
        try:
            mail = load(raw)
        except ParseError as e:
            skipped.append(f"message {n}: {e}")
            continue
        m = mail.meta
        infos[n] = {"message_index": n, "message_subject": m["subject"], "message_from": m["from"], "message_date": m["date"], "message_id": m["message_id"], "in_reply_to": m["in_reply_to"], "references": m["references"]}
        parts.append(f"## Message {n}\n\n{markdown(mail, 3)}")
        images += [(f"msg{n}_{name}", raw_) for name, raw_ in mail.images]
    return Mailbox({"source_type": "mbox", "message_count": len(every), "skipped_messages": skipped}, T.strip("\n\n".join(parts)), infos, images)


def stamp(chunks: list[Chunk], infos: dict[int, dict]) -> list[Chunk]:
    """Each chunk with what is known of the message that it stands in."""
    now = None
    for c in chunks:
        for text in (c.content, c.metadata.get("section_heading") or ""):
            if m := re.fullmatch(r"Message ([0-9]+)", T.strip(text)):
                now = int(m[1])
                break
        c.metadata |= infos.get(now, {})
    return chunks

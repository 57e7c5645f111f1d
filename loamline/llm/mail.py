"""Raw mails to readable text: parts, transfer encodings and markup undone (plain Python, runs in workers)."""

from __future__ import annotations

import binascii
import codecs
import html
import quopri
import re

BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"\n]+)"|([^\s;"]+))', re.I)
ENCODING = re.compile(r"^content-transfer-encoding:\s*([\w-]+)", re.I | re.M)
KIND = re.compile(r"^content-type:\s*([\w./+-]+)", re.I | re.M)
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
NEEDS_WORK = re.compile(r"content-transfer-encoding:\s*(?:quoted|base64)|<[a-z/!]", re.I)
HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
CHARSET = re.compile(r"charset\s*=\s*\"?'?([\w.:-]+)", re.I)
#: Byte order marks and their charsets, the longer ones first.
MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]


def charset_of(head: str) -> str | None:
    """The charset that a header names, if Python knows it."""
    m = CHARSET.search(head)
    try:
        found = codecs.lookup(m[1]) if m else None
    except LookupError:
        return None
    return found.name if found and found._is_text_encoding else None


def from_base64(body: str) -> bytes:
    """Bytes of a base64 body, as far as it goes: a cut or damaged end is left out."""
    clean = re.sub(r"[^A-Za-z0-9+/]", "", body)
    clean = clean[: len(clean) - (len(clean) % 4 == 1)]
    return binascii.a2b_base64(clean + "=" * (-len(clean) % 4))


def from_bytes(raw: bytes, charset: str | None, text: bool) -> str:
    """Text of a body's bytes: by their mark or the named charset, else as UTF-8, and as Latin-1 if they are ``text`` but no
    UTF-8.  A last character that was cut is left out; bytes that are no text give none."""
    charset = next((name for mark, name in MARKS if raw.startswith(mark)), charset)
    for name in dict.fromkeys((charset or "utf-8", "utf-8", *(["latin-1"] if text or charset else []))):
        try:
            found = codecs.getincrementaldecoder(name)().decode(raw)
        except (UnicodeError, LookupError):
            continue
        return "" if "\0" in found else found
    return ""


def from_quoted(body: str, charset: str | None = None) -> str:
    """Text of a quoted-printable body."""
    try:
        raw = quopri.decodestring(body.encode(charset or "utf-8", "replace"))
        return raw.decode(charset or "utf-8", "replace")
    except (UnicodeError, LookupError):
        return quopri.decodestring(body.encode("utf-8", "replace")).decode("utf-8", "replace")


def from_markup(body: str) -> str:
    """Text of an HTML body: tags separate words, entities are read."""
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", body)))


def split_head(text: str) -> tuple[str, str]:
    """Header and body of a part; without a header line at its start, everything is body."""
    if not HEADER_LINE.match(text):
        return "", text
    head, _, body = text.partition("\n\n")
    return head, body


def readable(text: str) -> list[str]:
    """The texts of a mail: its header and each part's body, decoded, parts and attached mails at any depth.  Attached text
    counts, binary content does not."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not NEEDS_WORK.search(text):
        return [text]
    out, todo = [], [text]
    while todo:
        head, body = split_head(todo.pop())
        kind = (m := KIND.search(head)) and m[1].lower()
        if m := BOUNDARY.search(head):
            pieces = re.split(r"^--" + re.escape(m[1] or m[2]) + r"(?:--)?[ \t]*$\n?", body, flags=re.M)
            out += [head, pieces[0]]
            todo += [piece.lstrip("\n") if not piece.startswith("\n") else "\n" + piece.lstrip("\n") for piece in reversed(pieces[1:])]
            continue
        encoding = (m := ENCODING.search(head)) and m[1].lower()
        if encoding == "base64":
            body = from_bytes(from_base64(body), charset_of(head), (kind or "").startswith(("text/", "message/")))
        elif encoding == "quoted-printable":
            body = from_quoted(body, charset_of(head))
        if kind == "message/rfc822":
            out.append(head)
            todo.append(body.replace("\r\n", "\n").lstrip("\n"))
            continue
        if kind == "text/html" or "<html" in body[:500].lower() or (TAG.search(body) and re.search(r"<(?:br|p|div|b|i|a)\b", body, re.I)):
            body = from_markup(body)
        out += [head, body]
    return out

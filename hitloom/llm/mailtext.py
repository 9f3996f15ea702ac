"""Readable text of mail messages: parts decoded, markup and quote marks removed."""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator

_HEADER = re.compile(r"[A-Za-z][\w-]*:")
_ENVELOPE = re.compile(r"(?:>?From [^\n]*\n)+(?=[A-Za-z][\w-]*:)")  # the line before each message of a mailbox file
_BOUNDARY = re.compile(r'boundary="?([^"\n;]+)"?', re.I)
_ENCODING = re.compile(r"^content-transfer-encoding:\s*([\w-]+)", re.I | re.M)
_TYPE = re.compile(r"^content-type:\s*([\w.+-]+/[\w.+-]+)", re.I | re.M)
_CHARSET = re.compile(r'charset="?([\w.:-]+)', re.I)
_QUOTE = re.compile(r"^[ \t>|]*(?:[^\W\d_]{1,4}>[ \t>|]*)+|^[ \t]*[>|][ \t>|]*", re.M)
_HIDDEN = re.compile(r"<!--.*?-->|<(style|script)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_ENCODED_WORD = re.compile(r"=\?([\w.-]+)\?([bq])\?([^?\s]*)\?=(?:[ \t\n]+(?==\?))?", re.I)
_QP = re.compile(r"=[ \t]*\n|((?:=[0-9A-Fa-f]{2})+)")
_BASE64_LINES = re.compile(r"\s*((?:[A-Za-z0-9+/=]+[ \t]*(?:\n|\Z))+)")
_WORD = re.compile(r"[^\W_]+")
# A header within a text, of a message or part that was pasted in or forwarded, which tells how what follows is packed.
_INNER = re.compile(r"^(?:[A-Za-z][\w-]*:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)+", re.M)
_PACKED = re.compile(r"^content-transfer-encoding:\s*(?:base64|quoted-printable)|^content-type:\s*multipart/|boundary=", re.I | re.M)
_PACKED_HINT = re.compile(r"content-t(?:ransfer-encoding|ype):", re.I)
# Elements by which HTML shows in a text that isn't declared as such.
_KNOWN_TAG = re.compile(r"</?(?:a|b|blockquote|body|br|center|div|em|font|h[1-6]|head|hr|html|i|img|li|ol|p|pre|s|small|span|strong|sub|sup|table|tbody|td|th|tr|tt|u|ul)\b[^<>]*>", re.I)


def _decoded(raw: bytes, charset: str) -> str:
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def unquote(text: str, charset: str) -> str:
    """Quoted-printable text; bytes are read in ``charset``."""
    return _QP.sub(lambda m: _decoded(bytes.fromhex(m[1].replace("=", "")), charset) if m[1] else "", text)


def unbase64(text: str, charset: str) -> str:
    """Base64 text up to the first line that is none, followed by the rest as it is; cut-off ends decode as far as they go."""
    if not (m := _BASE64_LINES.match(text)):
        return text
    packed = re.sub(r"[^A-Za-z0-9+/]", "", m[1])
    packed = packed[: len(packed) - (len(packed) % 4 == 1)]
    try:
        raw = base64.b64decode(packed + "=" * (-len(packed) % 4))
    except binascii.Error:
        return text
    return _decoded(raw, charset) + "\n" + text[m.end() :]


def encoded_words(head: str) -> str:
    def one(m: re.Match) -> str:
        try:
            if m[2] in "bB":
                return _decoded(base64.b64decode(m[3] + "=" * (-len(m[3]) % 4)), m[1])
            return unquote(m[3].replace("_", " "), m[1])
        except (binascii.Error, ValueError):
            return m[0]

    return _ENCODED_WORD.sub(one, head) if "=?" in head else head


def without_markup(text: str) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", text)))


def _split_head(text: str) -> tuple[str, str]:
    if m := _ENVELOPE.match(text):
        text = text[m.end() :]
    if _HEADER.match(text):
        head, _, body = text.partition("\n\n")
        return head, body
    return "", text.removeprefix("\n")


def _inner_message(text: str) -> int:
    """Where in a text the first header begins that says how what follows is packed; -1: nowhere."""
    if _PACKED_HINT.search(text):
        for m in _INNER.finditer(text):
            if _PACKED.search(m[0]):
                return m.start()
    return -1


def _parts(text: str) -> Iterator[str]:
    """The headers and readable bodies of a message in order. Messages within messages wait on a stack, however deep."""
    todo = [text]
    while todo:
        head, body = _split_head(todo.pop())
        if head:
            yield encoded_words(head)
        kind = _TYPE.search(head)
        kind = kind[1].lower() if kind else "text/plain"
        if m := _BOUNDARY.search(head):
            todo += re.split(rf"^--{re.escape(m[1].strip())}(?:--)?[ \t]*$\n?", body, flags=re.M)[::-1]
            continue
        encoding = _ENCODING.search(head)
        encoding = encoding[1].lower() if encoding else ""
        if encoding in ("base64", "quoted-printable"):
            if not kind.startswith(("text/", "message/")):
                continue  # an attachment
            charset = _CHARSET.search(head)
            body = (unbase64 if encoding == "base64" else unquote)(body, charset[1] if charset else "utf-8")
            body = body.replace("\r\n", "\n")
        if kind == "message/rfc822":
            todo.append(body.lstrip("\n"))
            continue
        body = _QUOTE.sub("", body)
        at = _inner_message(body)
        if at >= 0:
            todo.append(body[at:])
            body = body[:at]
        if kind == "text/html" or "<html" in body:
            body = without_markup(body)
        elif "<" in body and _KNOWN_TAG.search(body):
            body = html.unescape(_KNOWN_TAG.sub(" ", body))
        yield _QUOTE.sub("", body)


def readable(text: str) -> str:
    """All header and text parts of a message, without quote marks at line starts and, in HTML, without markup.

    Encoded text parts are decoded, closed or not, at any depth, also within forwarded messages and below quote marks;
    encoded attachments are left out. The line that separates messages in a mailbox file belongs to none. Text without
    headers is one part.
    """
    return "\n".join(_parts(text.replace("\r\n", "\n")))


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits of ``readable(text)``."""
    return _WORD.findall(readable(text).lower())

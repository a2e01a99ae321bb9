"""The body of a mail as text: parts found, transfer encodings undone, HTML reduced to its text.

Mails are often broken, so nothing here raises: a missing end boundary ends the part at the end of the mail, a cut-off
encoding gives what is left of it, an unknown one is taken as it stands, and bytes that aren't of the stated character
set are replaced. Attachments aren't part of the body. Written for speed: one pass of compiled patterns over whole
texts, no object per header.
"""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple

_HEADER_LINE = re.compile(r"[!-9;-~]+:|From ")
# A line of blanks alone still folds the header; it ends one only where no empty line does.
_BLANK, _ALMOST = re.compile(r"\r?\n\r?\n|\r\r"), re.compile(r"\r?\n[ \t]*\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*([^\r\n]*)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]*)\"|([^;\s]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:-]+)", re.I)
#: Whatever of HTML isn't text at all.
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>", re.I | re.S)
#: Tags that don't interrupt a word.
_INLINE = re.compile(r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<\?[^<>]*>")
#: Characters that no reader sees: soft hyphen, zero-width ones, word joiner, byte order mark.
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_UNSEEN = str.maketrans("", "", _HIDDEN)
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>]+))[^<>]*>", re.I)


def _seen(text: str) -> str:
    return text.translate(_UNSEEN) if any(c in text for c in _HIDDEN) else text


def _delimited(body: str, boundary: str) -> list[tuple[int, int, bool]]:
    """Where the boundary lines of a multipart start and end, and whether they are end marks."""
    mark, out, n = "--" + boundary, [], len(body)
    i = body.find(mark)
    while i >= 0:
        j = i + len(mark)
        last = body.startswith("--", j)
        k = j + 2 * last
        while k < n and body[k] in " \t":
            k += 1
        if (i == 0 or body[i - 1] == "\n") and (k == n or body[k] == "\n" or body.startswith("\r\n", k)):
            out.append((i, k, last))
        i = body.find(mark, j)
    return out


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "quoted-printable":
        if "=" not in body:
            return body
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    elif encoding == "base64":
        kept = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = binascii.a2b_base64(kept[: len(kept) // 4 * 4] + ("" if len(kept) % 4 < 2 else kept[len(kept) // 4 * 4 :] + "=" * (4 - len(kept) % 4)))
        except binascii.Error:
            return ""
    else:
        return body
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return raw.decode("utf-8" if charset in ("", "utf-8", "us-ascii") else charset, "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")


class Part(NamedTuple):
    """A node of a mail's tree: a text (`text` not None) or a container, of which all `inside` count or, of alternatives, one."""

    is_html: bool = False
    text: str | None = None
    alternatives: bool = False
    inside: list[Part] = []  # noqa: RUF012  every container is given its own


def tree(mail: str | None) -> list[Part]:
    """The parts of a mail, decoded, each before what is inside it; the first is the whole. A null or empty mail is a
    container of nothing. A text that doesn't start like a header is all body. Parts may be nested as deeply as they like.
    """
    nodes = [Part(inside=[])]
    waiting = [(mail, False, nodes[0].inside)] if mail else []
    while waiting:
        entity, nested, into = waiting.pop()
        node, pieces = _entity(entity, nested)
        if node is not None:
            into.append(node)
            nodes.append(node)
            waiting += [(piece, True, node.inside) for piece in reversed(pieces)]
    return nodes


def parts(mail: str | None) -> list[tuple[bool, str]]:
    """The text parts of a mail in order, decoded: (whether it is HTML, text)."""
    return [(node.is_html, node.text) for node in tree(mail) if node.text is not None]


def _entity(entity: str, nested: bool) -> tuple[Part | None, list[str]]:
    """A mail or a part of one: its node (None for an attachment), and the entities inside it."""
    head, body = "", entity
    if _HEADER_LINE.match(entity):
        gap = _BLANK.search(entity) or _ALMOST.search(entity)
        head, body = (entity[: gap.start()], entity[gap.end() :]) if gap else (entity, "")
    elif nested and entity[:1] in "\r\n":
        body = entity.lstrip("\r\n")
    kind, encoding, charset, boundary = "text/plain", "", "", ""
    if "ontent-" in head or "ONTENT-" in head or "content-" in head.lower():
        for name, value in _FIELD.findall(_FOLD.sub(" ", head)):
            name = name.lower()
            if name == "content-type":
                kind = value.split(";", 1)[0].strip().lower()
                if m := _CHARSET.search(value):
                    charset = m[1].lower()
                if m := _BOUNDARY.search(value):
                    boundary = m[1] or m[2] or ""
            elif name == "content-transfer-encoding":
                encoding = value.split(";", 1)[0].strip().lower()
            elif value.lstrip().lower().startswith("attachment"):
                return None, []
    if kind.startswith("multipart/"):
        marks = _delimited(body, boundary) if boundary else []
        if marks:
            pieces = []
            for k, (_, start, last) in enumerate(marks):
                if last:  # what follows is the epilogue
                    break
                stop = marks[k + 1][0] if k + 1 < len(marks) else len(body)
                piece = body[start:stop]
                # The line break before a boundary belongs to it.
                piece = piece.removesuffix("\n").removesuffix("\r") if k + 1 < len(marks) else piece
                pieces.append(piece[2:] if piece[:2] == "\r\n" else piece[1:])
            return Part(alternatives=kind == "multipart/alternative", inside=[]), pieces
        kind = "text/plain"
    if kind == "message/rfc822":
        return Part(inside=[]), [body]
    if kind.startswith("text/") or "/" not in kind:
        return Part(kind == "text/html", _decoded(body, encoding, charset), inside=[]), []
    return None, []


def html_text(page: str, links: bool = False) -> str:
    """The text of HTML, hidden elements included; block tags are line breaks. With `links` a link's target is put
    before its label."""
    page = _SILENT.sub(" ", page)
    # Line breaks of the source are blanks: only tags break lines.
    page = page.replace("\r", " ").replace("\n", " ")
    if links:
        page = _HREF.sub(lambda m: f" {m[1] or m[2] or m[3] or ''} ", page)
    return _seen(html.unescape(_TAG.sub("\n", _INLINE.sub("", page))))


def visible(mail: str | None) -> str:
    """The whole body as a reader sees it: all text parts, one after the other."""
    return "\n".join(html_text(t) if is_html else _seen(t) for is_html, t in parts(mail))

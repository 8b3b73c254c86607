"""The readable text of a raw message: headers, bodies, quoted and attached texts, with their encodings undone.

Nothing is parsed strictly, since headers and boundaries may be broken: each encoding is undone wherever it occurs, and a
text without one passes through unchanged, at the cost of a few searches. Null gives an empty text.
"""

from __future__ import annotations

import base64
import binascii
import html
import re

_WORD = re.compile(r"=\?([\w-]+)\?([bBqQ])\?([^?\s]*)\?=")
_WORD_GAP = re.compile(r"\?=\s+=\?")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
#: Lines of base64 characters are taken for base64 from this length on, or at any length after a header that says so.
_LONG = 24
_TEXT_TYPE = re.compile(r"^content-type:\s*text/", re.I | re.M)
_CHARSET = re.compile(r"^content-type:[^:]*?charset\s*=\s*[\"']?([\w.-]+)", re.I | re.M)
_CONTROL = re.compile("[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+")
_SOFT = re.compile(r"=[ \t]*\r?\n(?:[>|] ?)*")
_QUOTED = re.compile(r"(?:=[0-9A-Fa-f]{2})+")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BLOCK = re.compile(r"</?(?:p|br|div|tr|td|th|li|ul|ol|h\d|table|blockquote|body|html|head|title|style|script|hr|pre)\b[^>]*>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTE_MARK = re.compile(r"^[ \t]*[>|][>| \t]*", re.M)
_MOJIBAKE = re.compile("[Â-ô](?:[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])+")
#: Controls and marks that are not seen: soft hyphen, zero-width and direction marks, strokes laid over letters.
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿̲-̸]")


def _text(data: bytes, charset: str = "") -> str:
    for kind in (charset, "utf-8", "cp1252") if charset.startswith(("utf-16", "utf-32")) else ("utf-8", charset, "cp1252"):
        try:
            return data.decode(kind)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("latin-1")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _from_base64(block: str, declared: str = "") -> tuple[str, bool] | None:
    """The text of a part and whether it's surely text; ``declared`` is its header.

    No part is left out: of one that may be a picture or an archive, what lies between its control characters is text,
    each stretch by itself.
    """
    body = re.sub(r"[^A-Za-z0-9+/]", "", block)
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    charset = _CHARSET.search(declared)
    s = _MOJIBAKE.sub(_repair, _text(data, charset[1].lower() if charset else "")).replace("\0", "")
    sure = _is_utf8(data) or _TEXT_TYPE.search(declared) is not None
    return s if sure else _CONTROL.sub("\n\n", s), sure


def _without_base64(s: str) -> str:
    """Runs of base64 lines replaced by the text in them, in one pass over the lines."""
    out: list[str] = []
    run: list[str] = []
    header: list[str] = []
    announced = False

    def close() -> None:
        nonlocal announced
        joined = "".join(x.strip(" \t\r>|") for x in run)
        long = len(run[0].strip(" \t\r>|")) >= _LONG
        found = _from_base64(joined, "\n".join(header) if announced else "") if announced or long else None
        # Lines that only look like base64 may be words.
        if found is None or not (found[1] or announced and long):
            out.extend(run)
        if found is not None:
            out.extend(["", readable(found[0]), ""])
        announced = False
        run.clear()

    for line in s.split("\n"):
        core = line.strip(" \t\r>|")
        if core and _BASE64_LINE.fullmatch(core) and (announced or run or len(core) >= _LONG):
            run.append(line)
            continue
        if run:
            close()
        if "base64" in line.lower() and "transfer-encoding" in line.lower():
            announced = True
        elif core.startswith("--"):
            announced = False
        if core.startswith("--") or not core and not announced:
            header.clear()
        elif core:
            header.append(core)
        out.append(line)
    if run:
        close()
    return "\n".join(out)


def _word(m: re.Match) -> str:
    try:
        if m[2] in "bB":
            data = base64.b64decode(m[3] + "=" * (-len(m[3]) % 4))
        else:
            data = _QUOTED.sub(lambda q: bytes.fromhex(q[0].replace("=", "")).decode("latin-1"), m[3].replace("_", " ")).encode("latin-1", "replace")
        return data.decode(m[1], "replace") if m[1].lower() not in ("utf-8", "utf8") else _text(data)
    except (binascii.Error, ValueError, LookupError):
        return m[0]


def _repair(m: re.Match) -> str:
    """UTF-8 that was read as Windows-1252."""
    try:
        return b"".join(c.encode("latin-1") if c <= "\xff" else c.encode("cp1252") for c in m[0]).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m[0]


def readable(raw: str | None) -> str:
    """See the module."""
    if not raw:
        return ""
    s = raw
    if "=?" in s and "?=" in s:
        s = _WORD.sub(_word, _WORD_GAP.sub("?==?", s))
    low = s.lower()
    if "base64" in low:
        s = _without_base64(s)
    if "quoted-printable" in low:
        s = _QUOTED.sub(lambda q: _text(bytes.fromhex(q[0].replace("=", ""))), _SOFT.sub("", s))
    if "</" in s or "<br" in s or "<p" in s or "<html" in low:
        s = _INLINE.sub("", _BLOCK.sub("\n\n", _COMMENT.sub("", s)))
    if "&" in s and ";" in s:
        s = html.unescape(s)
    if not s.isascii():
        s = _MOJIBAKE.sub(_repair, s)
        s = _UNSEEN.sub("", s)
    if "\n>" in s or "\n|" in s:
        s = _QUOTE_MARK.sub("", s)
    return s

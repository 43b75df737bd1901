"""A small reader of the text of PDF files: no fonts are drawn and no layout is kept, only what the pages show, in its order.

It reads plain and compressed objects and object streams, follows the page tree, inflates contents, and maps character
codes by a font's ToUnicode table, or as Latin-1 where it has none. Encrypted files and other stream filters are errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_REFERENCE = re.compile(rb"(\d{1,10})\s+\d{1,5}\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/%{}]*|[+-]?\d*\.?\d+|[A-Za-z'\"*]+\d?|<<|>>", re.S)
# Escapes of literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


def _stream(body: bytes) -> bytes:
    """The decoded stream of an object."""
    at = body.find(b"stream")
    if at < 0:
        return b""
    head, data = body[:at], body[at + 6 :]
    data = data[2:] if data[:2] == b"\r\n" else data[1:] if data[:1] == b"\n" else data
    end = data.rfind(b"endstream")
    data = data[:end] if end >= 0 else data
    filters = re.findall(rb"/(\w+Decode)\b", head)
    for f in filters:
        if f != b"FlateDecode":
            raise PdfError(f"the filter {f.decode()} isn't read")
        inflate = zlib.decompressobj()
        data = inflate.decompress(data) + inflate.flush()
    if filters and re.search(rb"/Predictor\s+(?!1\b)\d+", head):
        raise PdfError("predictors aren't read")
    return data


def _objects(raw: bytes) -> dict[int, bytes]:
    """Every object by its number, the last one in the file counting."""
    out: dict[int, bytes] = {}
    for m in _OBJECT.finditer(raw):
        end = raw.find(b"endobj", m.end())
        out[int(m[1])] = raw[m.end() : end if end >= 0 else len(raw)]
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body[:400]):
            data, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = [int(n) for n in data[:first].split()]
            starts = numbers[1::2]
            for number, a, b in zip(numbers[::2], starts, [*starts[1:], len(data) - first]):
                out.setdefault(number, data[first + a : first + b])
    return out


def _entry(body: bytes, name: bytes) -> bytes:
    """What follows a name in a dictionary: up to the next name at the same depth."""
    m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", body)
    if not m:
        return b""
    depth, at = 0, m.end()
    while at < len(body):
        two = body[at : at + 2]
        if two == b"<<" or body[at : at + 1] == b"[":
            depth += 1
        elif two == b">>" or body[at : at + 1] == b"]":
            depth -= 1
            if depth < 0:
                break
        elif depth == 0 and body[at : at + 1] == b"/" and at > m.end():
            break
        at += 2 if two in (b"<<", b">>") else 1
    return body[m.end() : at + (1 if depth == 0 and body[at : at + 1] == b"]" else 0)]


def _pages(objects: dict[int, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(page, its resources) in the order of the tree."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    top = _REFERENCE.search(_entry(root, b"Pages"))
    seen: set[int] = set()

    def below(number: int, resources: bytes) -> Iterator[tuple[bytes, bytes]]:
        if number in seen or number not in objects:
            return
        seen.add(number)
        body = objects[number]
        own = _entry(body, b"Resources")
        resources = own or resources
        kids = _entry(body, b"Kids")
        if not kids:
            yield body, resources
        for k in _REFERENCE.findall(kids):
            yield from below(int(k), resources)

    if not top:
        raise PdfError("there is no page tree")
    yield from below(int(top[1]), b"")


def _resolved(value: bytes, objects: dict[int, bytes]) -> bytes:
    m = _REFERENCE.match(value.strip())
    return objects.get(int(m[1]), b"") if m else value


def _unicode_table(cmap: bytes) -> tuple[dict[int, str], int]:
    """(code -> text, bytes a code) of a ToUnicode table."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    wide = 1
    for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S):
        wide = max([wide, *(len(h) // 2 for h in re.findall(rb"<([0-9A-Fa-f]+)>", block))])
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = text(to)
            for k in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                out[int(low, 16) + k] = start[:-1] + chr(ord(start[-1]) + k)
        for low, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>\s*\[(.*?)\]", block, re.S):
            for k, to in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)):
                out[int(low, 16) + k] = text(to)
    return out, wide


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escaped(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, token[1:-1], flags=re.S)


def _shown(content: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    """The text that a page's content shows; a move to another line is a line break, a wide gap in a line a space."""
    out: list[str] = []
    stack: list[bytes] = []
    table, wide = {}, 1
    array: list[bytes] | None = None

    def text(token: bytes) -> str:
        data = _literal(token)
        if not table:
            return data.decode("latin-1")
        return "".join(table.get(int.from_bytes(data[k : k + wide], "big"), "") for k in range(0, len(data), wide))

    for m in _TOKEN.finditer(content):
        t = m.group()
        if t == b"[":
            array = []
        elif t == b"]":
            stack.append(b"]")
        elif t[:1] in b"(<" and t not in (b"<<",) or t[:1] in b"+-.0123456789" or t[:1] == b"/":
            (array if array is not None and b"]" not in stack else stack).append(t)
        else:
            if t == b"Tf" and len(stack) >= 2:
                table, wide = fonts.get(stack[-2][1:], ({}, 1))
            elif t == b"Tj" and stack:
                out.append(text(stack[-1]))
            elif t == b"TJ" and array is not None:
                out += [text(x) if x[:1] in b"(<" else " " if float(x) < -200 else "" for x in array]
            elif t in (b"'", b'"') and stack:
                out.append("\n" + text(stack[-1]))
            elif t == b"T*" or (t in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) != 0) or t == b"Tm" or t == b"ET":
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
            stack, array = [], None
    return "".join(out)


def pages(raw: bytes) -> Iterator[str]:
    """The text of each page. An error names its page."""
    if not raw.startswith(b"%PDF-"):
        raise PdfError("this is no PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
        raise PdfError("the file is encrypted")
    objects = _objects(raw)
    for n, (page, resources) in enumerate(_pages(objects), 1):
        try:
            fonts = {}
            for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", _resolved(_entry(_resolved(resources, objects), b"Font"), objects)):
                table = _REFERENCE.search(_entry(objects.get(int(number), b""), b"ToUnicode"))
                if table:
                    fonts[name] = _unicode_table(_stream(objects[int(table[1])]))
            contents = _entry(page, b"Contents")
            streams = [_stream(objects[int(k)]) for k in _REFERENCE.findall(_resolved(contents, objects) if contents.strip()[:1] != b"[" and b"stream" not in _resolved(contents, objects) else contents)]
            text = _shown(b"\n".join(streams), fonts)
        except Exception as e:
            raise PdfError(f"page {n}: {e}") from e
        yield text

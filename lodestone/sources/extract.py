"""Text out of files: raw text, DOCX and PDF, by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from .pdf import pages

_VALID = re.compile(
    rb"[\x00-\x7f]+|(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


def decode_utf8(raw: bytes) -> str:
    """UTF-8 where each invalid byte becomes one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            m = _VALID.match(raw, at)
            if m:
                out.append(m.group().decode("utf-8"))
                at = m.end()
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


def clean_text(text: str) -> str:
    """Spaces and tabs off each line's end, runs of empty lines to one."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip(" \t")
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out)


def docx_text(raw: bytes) -> str:
    """Text of word/document.xml: runs of text, tabs, breaks, and a line break after each paragraph."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("the archive has no word/document.xml")
        body = z.read("word/document.xml")
    out: list[str] = []
    inside = [0]
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}

    def start(name: str, _attrs: dict) -> None:
        local = name.rpartition(":")[2]
        inside[0] += local == "t"
        out.append(marks.get(local, ""))

    def end(name: str) -> None:
        local = name.rpartition(":")[2]
        inside[0] -= local == "t"
        if local == "p":
            out.append("\n")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: out.append(data) if inside[0] else None
    parser.Parse(body, True)
    return clean_text("".join(out))


def pdf_text(raw: bytes) -> str:
    """'--- page N ---' and the cleaned text of each page, by pypdf where it is installed, else by the reader of this package.
    A page that can't be read fails the file."""
    try:
        import pypdf
    except ImportError:
        found = pages(raw)
    else:
        found = (page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages)
    return "".join(f"--- page {n} ---\n{clean_text(text)}\n" for n, text in enumerate(found, 1))


def extract_text(path: str, raw: bytes) -> str:
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    return docx_text(raw) if ext == "docx" else pdf_text(raw) if ext == "pdf" else decode_utf8(raw)


def read_texts(listing: DataFrame) -> DataFrame:
    """Adds text, file_hash and error to a listing with a path column. Each task opens the files of its
    rows, so hidden files and explicit paths are read as they are; an unreadable file has its error."""
    import hashlib

    schema = listing.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", text string, file_hash binary, error string"
    at = listing.columns.index("path")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            text, digest, error = [], [], []
            for path in b.column(at).to_pylist():
                raw = None
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                    text.append(extract_text(path, raw))
                    error.append(None)
                except Exception as e:  # noqa: BLE001 - any failure belongs to its file alone
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
                digest.append(hashlib.sha256(raw).digest() if raw is not None else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string()), pa.array(digest, pa.binary()), pa.array(error, pa.string())], names=[*b.schema.names, "text", "file_hash", "error"])

    return listing.mapInArrow(run, schema)

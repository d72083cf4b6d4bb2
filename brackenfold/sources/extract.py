"""Text of documents: office files, PDF, and plain text in any encoding."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd

from brackenfold.functions.text import INDEXABLE

OFFICE = {"docx", "xlsx", "pptx"}
#: Encodings tried, in this order, where bytes aren't UTF-8 and no detector is installed.
ENCODINGS = ("utf-8", "utf-16", "shift_jis", "gb18030", "euc_kr", "cp1251", "cp1252")


class UnsupportedFormat(ValueError):
    pass


def decode(content: bytes) -> str:
    """Strict UTF-8, else the statistically best encoding, else the first that decodes."""
    if not content:
        return ""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(content, cp_exclusion=["iso2022_jp"]).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    for e in ENCODINGS[2:]:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    raise ValueError("unknown text encoding")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(xml: bytes, paragraph: str, run: str) -> str:
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) == paragraph:
            parts = []
            for x in p.iter():
                if _local(x.tag) == run:
                    parts.append(x.text or "")
                elif _local(x.tag) in ("tab",):
                    parts.append("\t")
                elif _local(x.tag) in ("br", "cr"):
                    parts.append("\n")
            out.append("".join(parts))
    return "\n".join(out)


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def office(content: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if kind == "docx":
            return _paragraphs(z.read("word/document.xml"), "p", "t")
        if kind == "pptx":
            return "\n\n".join(_paragraphs(z.read(n), "p", "t") for n in _numbered(names, r"ppt/slides/slide(\d+)\.xml"))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheets = []
        for n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for row in ElementTree.fromstring(z.read(n)).iter():
                if _local(row.tag) != "row":
                    continue
                cells = []
                for c in row:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(x.text or "" for x in c.iter() if _local(x.tag) == "t")
                    cells.append(value)
                rows.append("\t".join(cells))
            sheets.append("\n".join(rows))
        return "\n\n".join(sheets)


_STREAM = re.compile(rb"<<(?P<head>.*?)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?P<s>(?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:[^\]\\]|\\.)*)\]\s*TJ|(?P<nl>\bT\*|\bT[dDm]\b|\bET\b)", re.S)
_PART = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(s: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, s, flags=re.S).decode("latin-1")


def pdf(content: bytes) -> str:
    """Text shown by the content streams, for files with simple fonts; an installed PDF library is preferred."""
    try:
        from pypdf import PdfReader

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    except ImportError:
        pass
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    out = []
    for m in _STREAM.finditer(content):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for x in _SHOW.finditer(body):
            if x["s"] is not None:
                out.append(_literal(x["s"]))
            elif x["a"] is not None:
                out.append("".join(_literal(p) for p in _PART.findall(x["a"])))
            elif out and out[-1] != "\n":
                out.append("\n")
    return "".join(out).strip()


def text_of(path: str, content: bytes) -> str:
    """Plain text first if the bytes are UTF-8 and the type isn't a document's; errors for unknown types."""
    kind = path.rpartition("/")[2].rpartition(".")[2].lower()
    if kind == "pdf":
        return pdf(content)
    if kind in OFFICE:
        return office(content, kind)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        if kind not in INDEXABLE:
            raise UnsupportedFormat(f"Unsupported file format: {kind}") from None
        return decode(content)


def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for source, content, digest in zip(b["source"], b["content"], b["content_hash"]):
            try:
                rows.append((source, digest, text_of(source, bytes(content)), None))
            except Exception as e:  # noqa: BLE001
                rows.append((source, digest, None, f"{type(e).__name__}: {e}"[:500]))
        yield pd.DataFrame(rows, columns=["source", "content_hash", "text", "error"])

"""Sections of docx, pptx and pdf files, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCX_SECTION = 1600
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SECTIONS = "array<struct<seq:int,kind:string,text:string>>"


def grouped(parts: list[str], most: int) -> list[str]:
    """Paragraphs joined by line ends into sections of at most `most` characters; a longer paragraph stands alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def docx_sections(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = [" ".join(t.text.strip() for t in p.iter(f"{_W}t") if t.text and t.text.strip()) for p in body.findall(f"{_W}p")] if body is not None else []
    return grouped([s for s in said if s], DOCX_SECTION)


def pptx_sections(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        texts = [" ".join(t.text.strip() for t in ElementTree.fromstring(z.read(n)).iter(f"{_A}t") if t.text and t.text.strip()) for _, n in slides]
    return texts


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return plain.decode("latin-1")


def pdf_sections(data: bytes) -> list[str]:
    """Literal strings of each content stream, inflated where it is deflated."""
    out = []
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        said = ["".join(map(_literal, _LITERAL.findall(many))) if many else _literal(one) for one, many in _SHOWN.findall(body)]
        if text := " ".join(" ".join(said).split()):
            out.append(text)
    return out


READERS = {".docx": ("section", docx_sections), ".pptx": ("slide", pptx_sections), ".pdf": ("page", pdf_sections)}


def sections_of(path: str, data: bytes) -> list[dict]:
    """Numbered sections; a broken file has none."""
    kind, reader = READERS.get(path.lower()[path.rfind(".") :], (None, None))
    if reader is None:
        return []
    try:
        return [{"seq": i, "kind": kind, "text": t} for i, t in enumerate(reader(bytes(data)), 1) if t]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


def office_sections(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with one row per section: seq, kind, text."""

    @F.pandas_udf(SECTIONS)
    def read(paths: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([sections_of(p, d) for p, d in zip(paths, data, strict=True)])

    rows = files.withColumn("_s", F.explode(read("path", "content")))
    return rows.select(*[c for c in files.columns if c != "content"], "_s.*")

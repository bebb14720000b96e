"""Text of word-processor files (DOCX: zipped XML), read as a stream inside workers.

Cases: a file that is no archive, lacks its main part or is not well formed gives an empty text and the status ``broken``; one
whose main part is larger than a bound gives a failure mark and the status ``too large``; other suffixes give the mark of unsupported
files; null contents are broken; empty tables give no rows. Paragraphs without a visible sign are left out.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is put in place of a text that cannot be read (fixed values).
UNSUPPORTED, FAILED = "Unsupported file type for OCR.", "[Extraction Failed. Error: {}]"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN_PART = "word/document.xml"


def paragraphs(main, tables: bool = False):
    """Texts of the paragraphs of a main part, in order; what stands in tables only on request. Elements are dropped as soon as they are read."""
    from xml.etree import ElementTree

    depth, inside, held = 0, 0, []
    for event, e in ElementTree.iterparse(main, events=("start", "end")):
        name = e.tag.removeprefix(WORD)
        if event == "start":
            depth += name == "tbl"
            if name == "p":
                inside += 1
                if inside == 1:
                    held = []
            continue
        if name == "tbl":
            depth -= 1
        elif inside and name == "t":
            held.append(e.text or "")
        elif inside and name == "tab":
            held.append("\t")
        elif inside and name in ("br", "cr"):
            held.append("\n")
        elif name == "p":
            inside -= 1
            if inside == 0 and (tables or not depth):
                yield "".join(held)
        if name in ("p", "tbl", "sectPr"):
            e.clear()


def docx_text(content: bytes | None, tables: bool = False, most_bytes: int = 256 << 20) -> tuple[str, str]:
    """(text, status) of one file: paragraphs that are not blank, one a line."""
    from xml.etree import ElementTree

    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            if archive.getinfo(MAIN_PART).file_size > most_bytes:
                return FAILED.format("too large"), "too large"
            with archive.open(MAIN_PART) as main:
                lines = [x for x in paragraphs(main, tables) if x.strip()]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, OSError, NotImplementedError, RuntimeError):
        return "", "broken"
    return "\n".join(lines).strip(), "read"


def _read(tables: bool, most_bytes: int):
    def run(batches):
        import pyarrow as pa

        for rows in batches:
            out = []
            for path, content in zip(rows["path"].to_pylist(), rows["content"], strict=True):
                if (path or "").lower().endswith(".docx"):
                    out.append(docx_text(content.as_py(), tables, most_bytes))
                else:
                    out.append((UNSUPPORTED, "unsupported"))
            yield pa.RecordBatch.from_arrays([rows["path"], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["path", "text", "status"])

    return run


def read_texts(files: DataFrame, tables: bool = False, most_bytes: int = 256 << 20) -> DataFrame:
    """(path, text, status) of files (path, content), as ``formats.read_binary`` gives them."""
    return files.select("path", "content").mapInArrow(_read(tables, most_bytes), "path string, text string, status string")


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX with one paragraph a line, tabs as tabs: what ``docx_text`` reads back."""
    from xml.sax.saxutils import escape

    clean = "".join(c for c in text if c in "\t\n" or c >= " " and c not in "￾￿" and not "\ud800" <= c <= "\udfff")
    body = "".join(f"<w:p><w:r>{'<w:tab/>'.join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split(chr(9)))}</w:r></w:p>" for line in clean.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(MAIN_PART, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, content): every text as a DOCX, named by the column ``path``."""

    def run(batches):
        import pyarrow as pa

        for some in batches:
            yield pa.RecordBatch.from_arrays([some["path"], pa.array([docx_bytes(t or "") for t in some["text"].to_pylist()], pa.binary())], ["path", "content"])

    return rows.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, content binary")

"""Word-processor files and folding over all of Unicode."""

from __future__ import annotations

import io
import re
import sys
import unicodedata
import zipfile

import pyarrow as pa

from docloom.functions import batches, folding
from docloom.sources import formats, office


def archive(xml, part=office.MAIN_PART):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, xml)
    return out.getvalue()


W = f'xmlns:w="{office.WORD[1:-1]}"'
RUN = "<w:r><w:t>{}</w:t></w:r>"
PAGE = (
    f"<w:document {W}><w:body><w:p>{RUN.format('One ')}{RUN.format('two')}<w:r><w:tab/><w:t>three</w:t><w:br/><w:t>four</w:t></w:r></w:p><w:p/><w:p>{RUN.format('  ')}</w:p>"
    f"<w:tbl><w:tr><w:tc><w:p>{RUN.format('cell')}</w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink>{RUN.format('link &amp; more')}</w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:sectPr/></w:body></w:document>"
)


def test_paragraphs_and_tables():
    assert office.docx_text(archive(PAGE)) == ("One two\tthree\nfour\nlink & more", "read")
    assert office.docx_text(archive(PAGE), tables=True) == ("One two\tthree\nfour\ncell\nlink & more", "read")


def test_broken_files():
    whole = archive(PAGE)
    for content in (None, b"", b"no archive", whole[:50], archive(PAGE, "other.xml"), archive(PAGE[:-30]), archive("")):
        assert office.docx_text(content) == ("", "broken")
    assert office.docx_text(whole, most_bytes=10)[1] == "too large"


def test_files_of_a_folder(spark, tmp_path):
    text = "first line\n\n \t \n  tab\there <&> é中\U0001f600\nlast  "
    (tmp_path / "a.docx").write_bytes(office.docx_bytes(text))
    (tmp_path / "b.DOCX").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in office.read_texts(formats.read_binary(spark, str(tmp_path))).collect()}
    assert rows == {"a.docx": ("first line\n  tab\there <&> é中\U0001f600\nlast", "read"), "b.DOCX": ("", "broken"), "c.pdf": (office.UNSUPPORTED, "unsupported")}


def test_fold_over_all_code_points(spark):
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 4096]) for i in range(0, len(every), 4096)] + [None, "", "Ram  Mohan"]
    plain = lambda t: None if t is None else re.sub("[^a-z0-9]+", "", "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128).lower())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", folding.fold(df.t).alias("f")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_folding_takes_bounded_parts():
    """The workers' strings come from parts of bounded bytes, not from a whole batch; a long text is a part of its own."""
    texts = pa.array(["ﬁé" * 1000, None, "", "x" * (3 << 20), "Ａ"] * 300)
    parts = list(batches.cuts(texts))
    sizes = [sum(len(t.encode()) for t in texts[a:b].to_pylist() if t) for a, b in parts]
    assert parts[0][0] == 0 and parts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(n <= batches.BATCH_BYTES or b - a == 1 for n, (a, b) in zip(sizes, parts))
    assert folding._folded(texts).to_pylist() == [folding.fold_text(t) for t in texts.to_pylist()]
    assert folding._folded(texts[:0]).to_pylist() == []

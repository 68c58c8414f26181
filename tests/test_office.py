"""Word and slide files made by hand."""

import io
import zipfile
from xml.sax.saxutils import escape

from lodestone.sources import office

W, A, P = (f"http://schemas.openxmlformats.org/{x}/main" for x in ("wordprocessingml/2006", "drawingml/2006", "presentationml/2006"))
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def wp(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + "".join(f"<w:r><w:t>{escape(t)}</w:t></w:r>" for t in text.split("~")) + "</w:p>"


def wtbl(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{wp(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body):
    return zipped(word__document_xml=f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def slide(shapes):
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}">{shapes}</p:sld>'


def sp(text):
    return "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split("\n")) + "</p:txBody></p:sp>"


def atbl(rows):
    return "<a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:tc>" for c in r) + "</a:tr>" for r in rows) + "</a:tbl>"


DOCX = docx(wp("Trees & graphs", "Heading1") + wtbl([["a", "b"], ["", ""], ["c", "é"]]) + wp("  ") + wp("A tree ~has nodes."))
ORDERED = zipped(
    **{"ppt__slides__slide1_xml": slide(sp("second")), "ppt__slides__slide2_xml": slide(sp("first\nline") + atbl([["x", ""], ["y", "z"]]) + sp(" ")), "ppt__presentation_xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="r9"/><p:sldId r:id="r8"/></p:sldIdLst></p:presentation>'},
    **{"ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r8" Target="slides/slide1.xml"/><Relationship Id="r9" Target="/ppt/slides/slide2.xml"/></Relationships>'},
)
PLAIN = zipped(**{f"ppt__slides__slide{k}_xml": slide(sp(f"s{k}")) for k in (10, 2)})


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    long = docx("".join(wp(f"word{i} and more") for i in range(80)))
    for name, data in {"a.docx": DOCX, "deep/b.PPTX": ORDERED, "c.pptx": PLAIN, "bad.docx": b"no zip", "empty.docx": b"", "half.docx": zipped(other="x"), "torn.docx": docx("<w:p>"), "d.txt": b"text", "long.docx": long}.items():
        (tmp_path / name).write_bytes(data)
    made = office.read_blocks(spark, str(tmp_path))
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.path, r.seq)):
        got.setdefault(r.path.rpartition("/")[2], []).append((r.page, r.kind, r.text))
    assert got["a.docx"] == [(0, "heading", "Trees & graphs"), (0, "text", "A tree has nodes."), (0, "table", "a | b\nc | é")]
    assert got["b.PPTX"] == [(1, "text", "first\nline"), (1, "table", "x\ny | z"), (2, "text", "second")]
    assert got["c.pptx"] == [(1, "text", "s2"), (2, "text", "s10")]
    assert all(len(got[n]) == 1 and got[n][0][1] == "error" for n in ("bad.docx", "half.docx", "torn.docx")) and not {"d.txt", "empty.docx"} & set(got)
    docs = {r.path.rpartition("/")[2]: (r.n_words, r.tables, r.confidence, r.reason) for r in office.documents(made).collect()}
    assert docs["a.docx"] == (13, 2, 0.6, "too few words") and docs["long.docx"] == (240, 0, 0.85, None) and docs["b.PPTX"] == (7, 0, 0.75, None)
    assert docs["bad.docx"][3].startswith("BadZipFile") and docs["half.docx"][3].startswith("KeyError")


def test_null_contents_and_no_files(spark):
    rows = spark.createDataFrame([("x.docx", None)], "path string, content binary")
    assert [r.kind for r in office.blocks(rows).collect()] == ["error"] and office.blocks(rows.limit(0)).count() == 0

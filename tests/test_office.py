"""Word-processing archives on small documents."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from paperloom.sources import office

M = {"e": lambda x: f"<m:e>{x}</m:e>", "t": lambda x: f"<m:r><w:rPr><w:b/></w:rPr><m:t xml:space=\"preserve\">{x}</m:t></m:r>"}


def packed(document, relations="", more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if document is not None:
            z.writestr("word/document.xml", document)
        z.writestr("word/_rels/document.xml.rels", relations)
        for name in more:
            z.writestr(name, b"x")
    return out.getvalue()


def entries(spark, *contents, **bounds):
    return office.archive_entries(spark.createDataFrame([(str(i), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "file_id string, content binary"), **bounds)


def test_bounds(spark):
    good = packed("<w:p><w:t>a</w:t></w:p>", "r", ["word/media/a.png"])
    got = entries(spark, good, b"not an archive", None, packed("x" * 5000), max_entry_bytes=4000).collect()
    assert sorted((r["file_id"], r["entry"] or "", r["error"]) for r in got if r["error"]) == [("1", "", "archive-invalid"), ("2", "", "archive-invalid"), ("3", "word/document.xml", "entry-too-large")]
    assert {r["entry"]: (r["bytes"], r["text"]) for r in got if r["file_id"] == "0"} == {"word/document.xml": (23, "<w:p><w:t>a</w:t></w:p>"), "word/_rels/document.xml.rels": (1, "r"), "word/media/a.png": (1, None)}
    assert [r["error"] for r in entries(spark, packed("x" * 100_000), max_ratio=20).collect()][0] == "ratio-exceeded"
    broken = bytearray(packed("<w:p>" + "".join(chr(33 + i * i % 90) for i in range(500))))
    broken[60:90] = b"\0" * 30
    assert entries(spark, bytes(broken)).where("error = 'entry-damaged'").count() == 1


def test_small_archives_share_frames(spark, monkeypatch):
    """Many archives leave the worker in few frames, and none is lost where a frame is full."""
    files = pd.DataFrame({"file_id": [str(i) for i in range(30)], "content": [packed("<w:p><w:t>a</w:t></w:p>")] * 30})
    for rows, chars, frames in ((10_000, 8_000_000, 1), (7, 8_000_000, 8), (10_000, 50, 10)):
        monkeypatch.setattr(office, "FRAME_ROWS", rows)
        monkeypatch.setattr(office, "FRAME_CHARS", chars)
        got = list(office.opener()(iter([files[:10], files[10:]])))
        assert len(got) == frames and sum(map(len, got)) == 60 and pd.concat(got)["file_id"].nunique() == 30


def test_relationships(spark):
    rels = """<Relationship Id="r1" Target="media/a.PNG" Type="t"/><Relationship Id='r2' Target='../media/b.wmf'/><Relationship Id="r3" Target="/word/media/c.jpeg"/><Relationship Id="r4" Target="word\\media\\d"/><Relationship Id="r1" Target="media/z.gif"/><Relationship Target="none"/>"""
    got = {r["id"]: tuple(r)[2:] for r in office.relationships(entries(spark, packed("", rels, ["word/media/b.wmf", "word/media/z.gif"]))).collect()}
    assert got == {"r1": ("word/media/z.gif", "", "gif", "image/gif", True, True), "r2": ("word/media/b.wmf", "", "wmf", "image/wmf", False, True), "r3": ("word/media/c.jpeg", "", "jpeg", "image/jpeg", True, False), "r4": ("word/media/d", "", "", "application/octet-stream", False, False)}


def test_formulas(spark):
    t, e = M["t"], M["e"]
    frac = f"<m:f><m:fPr><m:type m:val=\"bar\"/></m:fPr><m:num>{t('1')}</m:num><m:den>{t('x')}</m:den></m:f>"
    cases = {
        frac: "$\\frac{1}{x}$",
        f"<m:sSup>{e(frac)}<m:sup>{t('2')}</m:sup></m:sSup>": "$\\frac{1}{x}^{2}$",
        f"<m:rad><m:radPr/><m:deg/>{e(t('a &lt; b'))}</m:rad>": "$\\sqrt{a < b}$",
        f"<m:rad><m:deg>{t('3')}</m:deg>{e(t('y'))}</m:rad>": "$\\sqrt[3]{y}$",
        f"<m:nary><m:naryPr><m:chr m:val=\"∫\"/></m:naryPr><m:sub>{t('0')}</m:sub><m:sup/>{e(frac)}</m:nary>": "$∫_{0}\\frac{1}{x}$",
        f"<m:nary><m:naryPr/><m:sub>{t('i')}</m:sub><m:sup>{t('n')}</m:sup>{e(t('i'))}</m:nary>": "$\\sum_{i}^{n}i$",
        f"<m:d>{e('<m:sSubSup>' + e(t('a')) + '<m:sub>' + t('i') + '</m:sub><m:sup>' + t('j') + '</m:sup></m:sSubSup>')}</m:d>": "$\\left(a_{i}^{j}\\right)$",
        f"<m:bar>{e(t('AB'))}</m:bar>": "$\\overline{AB}$",
        "<m:oMath> </m:oMath>": "",
    }
    df = spark.createDataFrame([(i, f"<m:oMath>{x}</m:oMath>") for i, x in enumerate(cases)], "i int, x string")
    assert [r["y"] for r in sorted(df.select("i", office.formula(F.col("x")).alias("y")).collect())] == list(cases.values())


def test_paragraphs(spark):
    picture = lambda *rids: "<w:drawing>" + "".join(f'<a:blip r:embed="{r}"/>' for r in rids) + "</w:drawing>"
    document = (
        f"<w:body><w:p><w:pPr/><w:r><w:t>Ａ &amp; b</w:t><w:tab/><w:t xml:space=\"preserve\"> c</w:t><w:br/><w:t>d</w:t></w:r></w:p><w:p></w:p><w:p>{picture('no', 'r2', 'r1')}</w:p>"
        f"<w:p><w:t>q</w:t>{picture('r2')}<m:oMath>{M['t']('z')}</m:oMath><w:object><v:imagedata r:id=\"r9\"/></w:object></w:p><w:p>{picture('lost')}</w:p></w:body>"
    )
    rels = '<Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="media/b.wmf"/><Relationship Id="r9" Target="embeddings/o"/>'
    read = entries(spark, packed(document, rels, ["word/media/a.png", "word/media/b.wmf"]), packed(None))
    got = sorted(tuple(r)[1:] for r in office.paragraphs(read, office.relationships(read)).collect())
    assert got == [(0, "A & b c \n d", False), (1, "[[IMAGE:r1]]", True), (2, "q [公式图片待转换:wmf] $z$ [公式图片待转换:unknown]", True), (3, "", True)]


def test_tables(spark):
    cell = lambda *texts: "<w:tc><w:tcPr/>" + "".join(f"<w:t>{t}</w:t>" for t in texts) + "</w:tc>"
    row = lambda *cells: "<w:tr><w:trPr/>" + "".join(cells) + "</w:tr>"
    document = "<w:tbl>" + row(cell("A. one"), cell("Ｂ、two"), cell("c) three"), cell("D:")) + row(cell("a", "b"), cell("B. x")) + row(cell(""), cell(" ")) + "</w:tbl><w:tbl>" + row(cell("A."), cell("B."), cell("C."), cell("d")) + row(cell("p"), cell("q"), cell("r")) + "</w:tbl>"
    got = sorted(tuple(r)[1:] for r in office.table_rows(entries(spark, packed(document))).collect())
    assert got == [(0, 0, 4, "A. one B. two C. three D. "), (0, 1, 2, "a b    x"), (1, 0, 4, "A. B. C. d"), (1, 1, 3, "p q r")]

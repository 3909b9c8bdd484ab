"""Folder scan, extraction, HTML, sinks."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from veilmark.fixed_values import LOG_COLUMNS, STATUSES
from veilmark.functions import html
from veilmark.functions import reporting as rp
from veilmark.plans import classify as run
from veilmark.plans.inputs import formula_layers
from veilmark.operators import scoring
from veilmark.sources import files, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p(" First ") + f"<w:tbl><w:tr><w:tc>{p('cell 1')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>" + p("") + p("Last")
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>42</v></c></row><row><c t="inlineStr"><is><t> in </t></is></c><c/></row></sheetData></worksheet>'
    return packed({
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{OFFICE}"><sheets><sheet name="Budget" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{OFFICE}/worksheet" Target="worksheets/s1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>shared</t></si></sst>",
        "xl/worksheets/s1.xml": sheet,
    })


def pptx():
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    wrap = lambda tag, inner: f"<p:{tag} {A}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{tag}>"
    return packed({
        "ppt/presentation.xml": f'<p:presentation {A} xmlns:r="{OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{OFFICE}/slide" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": wrap("sld", sp("Title") + sp(" ")),
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{OFFICE}/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
        "ppt/notesSlides/n1.xml": wrap("notes", sp("ignored", '<p:ph type="sldNum"/>') + sp("Speak slowly", '<p:ph type="body"/>')),
    })


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("drop")
    (base / "sub").mkdir()
    contents = {
        "a.txt": "plain é\r\ntext".encode(), "b.MD": "caf\xe9".encode("latin-1"),
        "c.html": b"<title>T &amp; U</title><script>x<b></script><p> one <b>two</b>",
        "d.docx": docx(), "e.xlsx": xlsx(), "f.pptx": pptx(), "g.docx": b"broken", "h.pdf": b"%PDF",
        "i.zip": b"x", "big.txt": b"y" * 3000, "noext": b"z", "sub/j.txt": b"deep",
    }
    for name, data in contents.items():
        (base / name).write_bytes(data)
    return str(base)


def extracted(spark, folder, **options):
    rows = files.extract(files.scan_folder(spark, folder, recursive=True), **options).collect()
    return {r["filename"]: r for r in rows}


def test_extraction_of_every_kind(spark, folder):
    got = extracted(spark, folder, limit=2500)
    text = {n: r["text"] for n, r in got.items()}
    status = {n: r["extraction_status"] for n, r in got.items()}
    assert text["a.txt"] == "plain é\ntext" and text["b.MD"] == "café"
    assert text["c.html"] == "T & U\none\ntwo"
    assert text["d.docx"] == "First\nLast\ncell 1"
    assert text["e.xlsx"] == "Budget\nshared\n42\nin"
    assert text["f.pptx"] == "Title\nSpeak slowly"
    assert status["g.docx"] == "extraction_failed" and "BadZipFile" in got["g.docx"]["extraction_detail"]
    assert status["big.txt"] == "oversized" and status["i.zip"] == status["h.pdf"] == "unsupported_format"
    assert got["i.zip"]["extraction_detail"] == "'.zip' not supported"
    assert set(status.values()) <= set(STATUSES) and text["j.txt"] == "deep"


def test_suffixes(spark):
    names = ["a.TXT", ".hidden", "a.b.Md", "noext", ".a.html", "end."]
    df = spark.createDataFrame([(f"x/y/{n}",) for n in names], "path string")
    got = [r["extension"] for r in files.with_metadata(df).collect()]
    assert got == [".txt", "", ".md", "", ".html", ""]


def test_flat_scan_and_registered_reader(spark, folder):
    flat = files.scan_folder(spark, folder).select("path").collect()
    assert not any(r["path"].endswith("j.txt") for r in flat)
    got = extracted(spark, folder, readers={".pdf": lambda data: "short"})
    assert got["h.pdf"]["extraction_status"] == "no_text_layer" and got["h.pdf"]["text"] is None
    got = extracted(spark, folder, readers={".pdf": lambda data: "a text of sufficient length"})
    assert got["h.pdf"]["extraction_status"] == "ok"


def test_content_of_refused_files_is_not_read(spark, folder):
    plan = files.extract(files.scan_folder(spark, folder))._jdf.queryExecution().executedPlan().toString()
    refused = [line for line in plan.splitlines() if "FileScan binaryFile" in line and "content" not in line]
    assert len(refused) == 1


def test_run_log_and_sinks(spark, folder, tmp_path):
    model = scoring.Model("m", ["deep", "plain", "text"], __import__("numpy").ones(3), formula_layers(3))
    got = files.extract(files.scan_folder(spark, folder, recursive=True), limit=2500)
    log = run.run_log(got, model, "2024-01-31T00:00:00Z").persist()
    assert log.columns == LOG_COLUMNS and log.count() == 12
    row = run.run_summary(log).first()
    assert (row["total"], row["classified"], row["errors"]) == (12, 7, 5)
    assert {r[0]: r[1] for r in run.errors_by_status(log).collect()} == {"oversized": 1, "unsupported_format": 3, "extraction_failed": 1}
    assert run.selected(log, min_confidence=0.999999).count() == 5
    assert run.selected(log, review_only=True).count() == 5 + row["flagged"]
    sinks.write_log(log, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / "log"))
    assert back.columns == LOG_COLUMNS and back.count() == 12
    sinks.write_export(log, str(tmp_path / "export"))
    part = sorted(f for f in os.listdir(tmp_path / "export") if f.startswith("part"))[0]
    first = (tmp_path / "export" / part).read_bytes().split(b"\r\n")[0]
    assert first == b"timestamp,filename,classification,confidence,review_flag,reasoning,policy_version,status,detail"


def test_csv_quoting(spark):
    df = spark.createDataFrame([("a,b", 'q"q', None, "line\nbreak", "plain")], "a string, b string, c string, d string, e string")
    line = df.select(rp.csv_line(*[F.col(c) for c in "abcde"])).first()[0]
    assert line == '"a,b","q""q",,"line\nbreak",plain'


PAGES = [
    "<p>a</p>b<!-- c --><i>d</i>", "<script>if (a<b) {}</script>t", "<style>p{}</style><title> x </title>",
    "1 < 2 &lt;b&gt; &amp;lt; &copy; 3", "<a title='x > y'>link</a>", "&eacute;t&#233; &nbsp; &hellip;", "<script>open",
    "<div\n class=x>multi\nline</div>", "", "<p>unclosed <b>bold", "text <!-- never closed", "<textarea><b>x</b></textarea>",
    "<?php echo 1 ?>after", "a<br/>b", "<!DOCTYPE html><p>  pad  </p>", "x &notanentity; y & z", "<SCRIPT>s</SCRIPT >k",
    "cut off&amp", "<p>a&ampb &amp;amp; &copy 2</p>",
    "<!-- <script> --> text <script>x</script> end", "<!-- <script>y</script> -->z", "<style>a</style>b<style>",
    "<script><!-- x //--></script>shown", "<!---->a<!-->b-->c",
]


def test_html_equals_a_parser(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    for r in html.with_html_text(df, "html").collect():
        assert r["text"] == html.parsed_text(r["html"]), r["html"]


def test_fallback_chain(spark):
    long = "x" * 20
    df = spark.createDataFrame([("short", long), (long, None), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(files.first_long_enough(F.col("a"), F.col("b"))).collect()] == [long, long, None]

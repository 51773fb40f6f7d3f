"""Files to documents: readers by type, candidates, verification, roll-up, export; the states of jobs."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import document, verify
from folioscope.sources import detect, documents, office
from folioscope.streaming import jobs


def archive(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return data.getvalue()


W = "xmlns:w='w'"
DOCX = {"word__document_dot_xml": f"<w:document {W}><w:p><w:r><w:t> one </w:t><w:br w:type='page'/><w:t>two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p><w:sectPr><w:pgSz w:w='10000' w:h='20000'/></w:sectPr></w:document>", "word__media__a_dot_png": "x"}
RELS = "<R><r Id='rId1' Target='worksheets/sheet1.xml'/><r Id='rId2' Target='worksheets/gone.xml'/><r Id='rId3' Target='worksheets/sheet3.xml'/></R>"
BOOK = "<workbook xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='s' r:id='rId1'/><sheet name='gone' r:id='rId2'/><sheet name='t' r:id='rId3'/></sheets></workbook>"
XLSX = {
    "xl__workbook_dot_xml": BOOK, "xl___rels__workbook_dot_xml_dot_rels": RELS, "xl__sharedStrings_dot_xml": "<sst><si><t>na</t><t>me</t></si></sst>", "xl__media__p_dot_png": "x",
    "xl__worksheets__sheet1_dot_xml": "<worksheet><c r='A1' t='s'><v>0</v></c><c r='B3'><v>7</v></c><c r='bad'><v>1</v></c><c r='C1' t='s'><v>9</v></c></worksheet>", "xl__worksheets__sheet3_dot_xml": "<worksheet/>",
}
PPTX = {
    "ppt__presentation_dot_xml": "<p><sldSz cx='1270000' cy='635000'/></p>",
    "ppt__slides__slide1_dot_xml": "<s><pic><off x='0' y='0'/><ext cx='12700' cy='12700'/></pic><sp><off x='12700' y='25400'/><ext cx='12700000' cy='12700'/><p><t>Big </t><t> </t></p><p><t>title</t></p></sp><sp><p><t>free</t></p></sp></s>",
}


def test_word_pages(spark):
    df = spark.createDataFrame([("d", archive(**DOCX), detect.CONTAINERS["word/document.xml"])], "path string, content binary, content_type string")
    rows = office.read_parts(df).collect()
    assert [(r.page_number, r.width, r.height, r.reason) for r in rows if r.text is None] == [(1, 500.0, 1000.0, "embedded_docx_text"), (2, 500.0, 1000.0, "embedded_docx_text")]
    assert [(r.page_number, r.x1, r.y1) for r in rows if r.picture] == [(1, 500.0, 1000.0), (2, 500.0, 1000.0)]
    assert [(r.page_number, r.block_index, r.line_index, r.text, r.x0, r.y0, r.x1, r.y1) for r in rows if r.picture is False] == [(1, 0, 0, " one two", 36.0, 36.0, 464.0, 50.0), (2, 1, 0, "three", 36.0, 36.0, 464.0, 50.0)]


def test_sheets_and_slides(spark):
    rows = [("x", archive(**XLSX), detect.CONTAINERS["xl/workbook.xml"]), ("p", archive(**PPTX), detect.CONTAINERS["ppt/presentation.xml"])]
    got = office.read_parts(spark.createDataFrame(rows, "path string, content binary, content_type string")).collect()
    x, p = [r for r in got if r.key == "x"], [r for r in got if r.key == "p"]
    assert [(r.page_number, r.reason, r.height) for r in x if r.text is None] == [(1, "native_xlsx_sheet:s", 792.0), (2, "native_xlsx_sheet:t", 792.0)]
    assert [(r.text, r.block_index, r.x0, r.y0, r.x1, r.y1) for r in x if r.picture is False] == [("name", 0, 36.0, 36.0, 108.0, 54.0), ("7", 2, 116.0, 80.0, 188.0, 98.0)]
    assert [r.page_number for r in x if r.picture] == [1, 2]
    assert [(r.text, r.line_index, r.x0, r.y0, r.x1, r.y1) for r in p if r.picture is False] == [("Big title", 0, 1.0, 2.0, 100.0, 3.0), ("free", 1, 0.0, 0.0, 100.0, 50.0)]
    assert [(r.x1, r.y1) for r in p if r.picture] == [(1.0, 1.0)] and all(r.error is None for r in got)


FILES = [
    ("a.txt", b"one line\nand two"), ("b.html", b"<p>para <b>bold</b></p><div>x</div>"), ("c.json", b"{broken"), ("d.docx", archive(**DOCX)), ("e.pdf", b"%PDF-1.7"),
    ("f.bin", b""), ("g.bin", b"\xff\xfe\x00"), ("h.docx", b"PK\x03\x04broken"), ("i.txt", b"\x01\x02\x03\x04\x05\x06\x07\nx"),
]


def test_each_file_goes_to_its_reader(spark):
    files = detect.detect(spark.createDataFrame(FILES, "path string, content binary"), path="path")
    found = documents.read(files)
    lines = {}
    for r in found.lines.orderBy("path", "page_number", "line_index").collect():
        lines.setdefault(r.path, []).append((r.page_number, r.text))
    assert lines["a.txt"] == [(1, "one line"), (1, "and two")] and [t for _, t in lines["b.html"]] == ["parabold", "x"] and lines["d.docx"] == [(1, " one two"), (2, "three")]
    assert {(r.path, r.page_number): (r.page_type, r.n_lines, r.pictures) for r in found.pages.collect() if r.path in ("a.txt", "d.docx")} == {("a.txt", 1): ("native_text", 2, 0), ("d.docx", 1): ("mixed", 1, 1), ("d.docx", 2): ("mixed", 1, 1)}
    assert {(r.path, r.code) for r in found.problems.collect()} == {("c.json", "invalid_document"), ("e.pdf", "adapter_required"), ("f.bin", "empty_source"), ("g.bin", "unsupported"), ("h.docx", "malformed_office")}
    assert {(r.path, r.message) for r in documents.warnings(found).collect()} == {("i.txt", "native_text_suspicious")}


def test_documents_from_lines_to_texts(spark):
    lines = spark.createDataFrame([("d", 1, 0, "First line of text"), ("d", 1, 1, "Second line"), ("d", 2, 0, "On page two"), ("e", 1, 0, "\x01\x02\x03\x04\x05\x06")], "document_id string, page_number int, line_index int, text string")
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1), ("f", 1)], "document_id string, page_number int")
    cell = lambda row, column, text, sure: ("d", 2, "t1", row, column, row, 0, text, sure, "table", "unit", "en", "Latin")
    cells = spark.createDataFrame([cell(0, 0, "name", 0.99), cell(0, 1, "age", 0.99), cell(1, 0, "Ann", 0.4)], "document_id string, page_number int, line_id string, cell_row int, cell_column int, position int, attempt_idx int, raw_text string, confidence double, backend string, confidence_scale string, language string, script string")
    policy = verify.Policy(require_consensus=False, require_independent=False)
    out = document.process(document.native_candidates(lines), pages, cells, policy)
    status = {(r.document_id, r.line_id, r.cell_row, r.cell_column): r.status for r in out.items.collect()}
    assert status["d", "line-0", None, None] == "verified" and status["e", "line-0", None, None] == "human_review_required"
    assert (status["d", "t1", 0, 0], status["d", "t1", 1, 0]) == ("verified", "human_review_required")
    rolled = {(r.document_id, r.page_number): (r.status, r.needs_review) for r in out.pages.collect()}
    assert rolled == {("d", 1): ("verified", False), ("d", 2): ("human_review_required", True), ("e", 1): ("human_review_required", True), ("f", 1): ("accepted", False)}
    assert {r.document_id: r.quality_status for r in out.documents.collect()} == {"d": "human_review_required", "e": "human_review_required", "f": "accepted"}
    assert {r.document_id: r.text for r in out.texts.collect()} == {"d": "First line of text\nSecond line\f\nOn page two\nname | age\n", "e": "\n", "f": "\n"}


def test_routes_meet_their_recognisers(spark):
    # Inside the test, so that it travels to the workers by value.
    class Echo:
        name, schema = "echo", "region_id string, line_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, backend string, model string, model_version string, flags array<string>, error string"

        def __call__(self, batch):
            empty = [[] for _ in batch.region_id]
            return pd.DataFrame({c.split()[0]: None for c in self.schema.split(", ")}, index=range(len(batch)), dtype=object).assign(region_id=batch.region_id.tolist(), text="seen", flags=empty)

    regions = spark.createDataFrame([("r1", "printed"), ("r2", "handwriting"), ("r3", None)], "region_id string, route string")
    out = {r.region_id: (r.text, r.error, r.route) for r in document.recognize(regions, {"printed": Echo()}).collect()}
    assert out == {"r1": ("seen", None, "printed"), "r2": (None, "capability_unavailable", None), "r3": (None, "capability_unavailable", None)}
    assert {r.error for r in document.recognize(regions, {}).collect()} == {"capability_unavailable"}


def test_states_of_jobs(spark):
    order = ["queued", "running", "running", "completed", "running"]
    rows = [("a", k, s) for k, s in enumerate(order)] + [("b", 0, "running"), ("c", 0, "queued"), ("c", 1, "failed"), ("d", 0, "queued"), ("d", 1, "completed"), ("e", 0, "odd")]
    out = jobs.transitions(spark.createDataFrame(rows, "job_id string, seq int, state string"), "job_id", ["seq"]).collect()
    assert {(r.job_id, r.seq): r.valid for r in out} == {("a", 0): True, ("a", 1): True, ("a", 2): True, ("a", 3): True, ("a", 4): False, ("b", 0): False, ("c", 0): True, ("c", 1): True, ("d", 0): True, ("d", 1): False, ("e", 0): False}
    latest = spark.createDataFrame([("j2", "k", "running", "2024-01-01 00:00:00"), ("j1", "k", "running", "2024-01-01 00:00:50"), ("j3", "x", "completed", "2024-01-01 00:00:00"), ("j4", None, "queued", None)], "job_id string, idempotency_key string, state string, started_at string")
    assert [r.job_id for r in jobs.overdue(latest, F.lit("2024-01-01 00:01:00"), 30).collect()] == ["j2"]
    assert [r.job_id for r in jobs.find(latest, idempotency_key="k").collect()] == ["j1"] and jobs.find(latest, idempotency_key="none").collect() == []


def test_a_key_of_no_column_is_an_error(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        jobs.find(spark.createDataFrame([("j",)], "job_id string"), nothing="x").collect()


def test_settling_normalizes_twice_at_most(spark):
    """Verification and one aggregation read the candidates (three branches before), and the share of others is as before."""
    rows = [("d", 1, "line-0", 0, i, t, 0.9) for i, t in enumerate(["a", "b", "a", "a"])] + [("d", 1, "line-1", 1, 0, "x", 0.9)]
    c = spark.createDataFrame(rows, "document_id string, page_number int, line_id string, position int, attempt_idx int, raw_text string, confidence double")
    out = document.settled(c, document.LINE_KEYS)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
    assert {r.line_id: (r.position, r.disagreement) for r in out.collect()} == {"line-0": (0, pytest.approx(1 / 3)), "line-1": (1, None)}


def test_few_texts_of_a_batch_are_strings(spark):
    """A batch stays Arrow; texts are taken ``HELD`` at a time, nulls and an empty partition too."""
    from folioscope.functions import text as tx

    seen = lambda col: tx.each_text(col, lambda x: x + "!")
    df = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("t"))
    got = {r.id: r.x for r in df.select("id", seen(F.col("t")).alias("x")).collect()}
    assert got == {i: None if i % 5 == 0 else f"{i}!" for i in range(300)}

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.functions import geometry as g
from folioscope.operators import groups, layout, matching, routing, tables
from folioscope.sources import detect, evaluation, office, text_pages

BOXED = "page string, id string, idx int, reading_order int, x0 double, y0 double, x1 double, y1 double"


def test_boxes(spark):
    a, b = g.box(*(F.lit(float(v)) for v in (0, 0, 10, 10))), g.box(*(F.lit(float(v)) for v in (5, 5, 15, 10)))
    r = spark.range(1).select(
        g.iou(a, b).alias("iou"), g.overlap_of_smaller(a, b).alias("o"), g.clip(b, F.lit(12.0), F.lit(9.0)).alias("c"), g.clip(b, F.lit(3.0), F.lit(3.0)).alias("n"),
        g.signed_area(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 3D))")).alias("area"), g.render_size(F.lit(90.0), F.lit(10.0)).alias("px"),
        g.map_box(g.multiply(F.lit(g.shift_mapping(1, 2)), F.lit(g.scale_mapping(2, 3))), a).alias("m"),
    ).head()
    assert (r.iou, r.o, r.area, r.px) == (25 / 125, 0.5, 6.0, 12)
    assert tuple(r.c.box) == (5, 5, 12, 9) and r.n.problem == "not_visible" and tuple(r.m) == (1, 2, 21, 32)


def test_homography_and_rotation(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    src, dst = ((0, 0), (4, 0), (4, 4), (0, 4)), ((1, 1), (9, 2), (8, 9), (0, 8))
    m = spark.range(1).select(g.homography(pts(*src), pts(*dst)).alias("m"))
    for (x, y), (u, v) in zip(src, dst):
        r = m.select(g.apply_mapping(F.col("m"), F.lit(float(x)), F.lit(float(y))).alias("p")).head().p
        assert (r.x, r.y) == (pytest.approx(u), pytest.approx(v))
    mapping, w, h = g.rotation_mapping(4, 2, 90)
    assert (w, h) == (pytest.approx(2), pytest.approx(4)) and mapping[2] == pytest.approx(4)


@pytest.mark.parametrize(("direction", "expected"), [("rtl", [1, 3, 0, 2]), ("ltr", [2, 0, 3, 1]), ("mixed", [2, 0, 3, 1])])
def test_reading_order_of_columns(spark, direction, expected):
    boxes = [(480, 100, 730, 150), (70, 100, 320, 150), (480, 180, 730, 230), (70, 180, 320, 230)]
    want = {"rtl": {0: 0, 2: 1, 1: 2, 3: 3}, "ltr": {1: 0, 3: 1, 0: 2, 2: 3}, "mixed": {1: 0, 3: 1, 0: 2, 2: 3}}[direction]
    rows = [("p", i, "paragraph", *map(float, b), 800.0, direction) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "page string, i int, block_type string, x0 double, y0 double, x1 double, y1 double, page_width double, direction string")
    assert {r.i: r.reading_order for r in layout.reading_order(df, ["page"]).collect()} == want
    assert layout.column_count(df, ["page"]).head().columns == 2


def test_bands_come_in_order(spark):
    kinds = ["footer", "paragraph", "header", "table", "paragraph"]
    tops = [700.0, 300.0, 10.0, 200.0, 100.0]
    df = spark.createDataFrame([("p", i, k, 10.0, y, 500.0, y + 20, 600.0, "ltr") for i, (k, y) in enumerate(zip(kinds, tops))], "page string, i int, block_type string, x0 double, y0 double, x1 double, y1 double, page_width double, direction string")
    got = [r.block_type for r in layout.reading_order(df, ["page"]).orderBy("reading_order").collect()]
    assert got == ["header", "paragraph", "table", "paragraph", "footer"]


def test_rows_with_a_running_centre(spark):
    rows = [("p", i, 0.0 + 10 * (5 - i), y, 5.0 + 10 * (5 - i), y + 10, "ltr") for i, y in enumerate([0.0, 6.0, 12.0, 40.0])]
    df = spark.createDataFrame(rows, "page string, i int, x0 double, y0 double, x1 double, y1 double, direction string")
    got = {r.i: r.row_order for r in layout.reading_rows(df, "page").collect()}
    # 0 and 6 share a row (centre 3 after both), 12 is 9 away from it and opens one.
    assert got == {1: 0, 0: 1, 2: 2, 3: 3}


def test_active_runs_and_paragraphs(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate([5, 5, 0, 5, 0, 0, 5])], "k string, i int, v int")
    assert sorted((r.run_start, r.run_end) for r in layout.active_runs(df, ["k"], "i", "v", 3, 1).collect()) == [(0, 4), (6, 7)]
    lines = spark.createDataFrame([("p", 0, 0.0, 10.0), ("p", 1, 12.0, 22.0), ("p", 2, 60.0, 70.0)], "k string, i int, y0 double, y1 double")
    assert [r.paragraph for r in layout.paragraphs(lines, ["k"], ["i"], "y0", "y1").orderBy("i").collect()] == [0, 0, 1]


def cells(spark, rows):
    return spark.createDataFrame(
        [("t", 100.0, 60.0, i, r, c, text, None, tuple(map(float, b)), None, conf) for i, (r, c, text, b, conf) in enumerate(rows)],
        "region_id string, region_width double, region_height double, cell_idx int, row int, column int, text string, raw_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, polygon array<struct<x:double,y:double>>, confidence double",
    )


def test_table_validation(spark):
    grid = [(r, c, f"{r}{c}", (30 * c, 20 * r, 30 * c + 30, 20 * r + 20), 0.9) for r in (1, 0) for c in (2, 0, 1)]
    r = tables.validate(cells(spark, grid)).head()
    assert [(c.row, c.column) for c in r.cells] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)] and r.usable and r.warnings == []
    bad = [(0, 0, "a", (0, 0, 30, 20), 0.9), (-1, 0, "b", (0, 20, 30, 40), 0.9), (1, 1, "c", (90, 0, 130, 20), 0.9), (2, 2, "d", (0, 0, 30, 20), 0.9), (0, 0, "e", (40, 0, 60, 20), 0.9), (3, 3, "f", (70, 30, 90, 50), 1.2)]
    r = tables.validate(cells(spark, bad)).head()
    assert len(r.cells) == 1 and r.warnings == ["invalid_address", "invalid_geometry", "overlapping_duplicate", "duplicate_address", "invalid_confidence"]
    r = tables.validate(cells(spark, [(0, c, "x" if not c else " ", (10 * c, 0, 10 * c + 10, 20), None) for c in range(5)])).head()
    assert "excessive_empty_cells" in r.warnings and not r.usable
    assert not tables.validate(cells(spark, [(0, 0, "", (0, 0, 10, 10), None)])).head().usable


def test_addresses_and_confidences(spark):
    df = spark.createDataFrame([("t", 0.0, 0.0, 10.0, 10.0), ("t", 20.0, 1.0, 30.0, 11.0), ("t", 1.0, 20.0, 11.0, 30.0)], "region_id string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.row, r.column) for r in tables.infer_addresses(df).collect()) == [(0, 0), (0, 1), (1, 0)]
    r = spark.range(1).select(tables.provider_confidence(F.lit(1.2)).alias("a"), tables.table_confidence(F.lit(1.2)).alias("b"), tables.table_confidence(F.lit(85.0)).alias("c")).head()
    assert (r.a, r.b, r.c) == (None, pytest.approx(0.012), 0.85)


def test_matching(spark):
    ref = spark.createDataFrame([("p", "r1", 0, 1, 0.0, 0.0, 10.0, 10.0), ("p", "same", 1, 0, 50.0, 50.0, 60.0, 60.0), ("q", "r2", 0, 0, 0.0, 0.0, 1.0, 1.0)], BOXED)
    pred = spark.createDataFrame([("p", "x", 0, 0, 0.0, 0.0, 10.0, 10.0), ("p", "same", 1, 1, 90.0, 90.0, 95.0, 95.0), ("p", "y", 2, 2, 40.0, 40.0, 50.0, 50.0)], BOXED)
    got = {(r.page, r.reference_id): r.prediction_id for r in matching.match_lines(ref, pred).collect()}
    assert got == {("p", "r1"): "x", ("p", "same"): "same", ("q", "r2"): None}
    one = spark.createDataFrame([("p", "a", 0, 0, 0.0, 0.0, 10.0, 10.0)], BOXED)
    two = spark.createDataFrame([("p", "a", 0, 0, 0.0, 0.0, 10.0, 10.0), ("p", "b", 1, 1, 40.0, 40.0, 50.0, 50.0)], BOXED)
    r = matching.detection(one, two).head()
    assert (r.precision, r.recall) == (0.5, 1.0)
    assert {(r.document, r.side) for r in matching.same_ids(spark.createDataFrame([("a",), ("b",)], "document string"), spark.createDataFrame([("b",), ("c",)], "document string"), "document").collect()} == {("a", "left"), ("c", "right")}


def test_routes_and_native_evidence(spark):
    routes = lambda *a: spark.range(1).select(routing.region_routes(*(F.lit(x) for x in a))).head()[0]
    assert routes("table", "mixed", None) == ["table"] and routes("form", "printed", "") == ["printed", "handwriting"]
    assert routes("paragraph", "handwritten", None) == ["handwriting"] and routes("paragraph", "printed", " Key-Value ") == ["printed", "handwriting"]
    df = spark.createDataFrame([("a", "good text here", 600.0), ("b", "ab", 600.0), ("c", "\x00\x01\x02\x03\x04\x05", 600.0), ("d", "-------", 600.0)], "page string, text string, width double")
    df = df.withColumn("height", F.lit(800.0)).withColumn("box", g.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(10.0)))
    got = {r.page: r.reason for r in routing.native_evidence(df, ["page"]).collect()}
    assert got == {"a": "reliable_native_text", "b": "native_text_too_sparse", "c": "native_text_suspicious", "d": "native_text_implausible"}


def test_content_types(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:r><w:t>سلام OCR</w:t></w:r></w:p><w:p><w:r><w:br w:type='page'/><w:t>two</w:t></w:r></w:p></w:document>")
    rows = [
        ("a.pdf", b"%PDF-1.7 x"), ("b.png", b"\x89PNG\r\n\x1a\n...."), ("c.webp", b"RIFF....WEBP"), ("d.json", b' {"a": 1}'), ("e.bin", b"a,b\n1,2\n"), ("f.bin", b"<html><body>x"), ("g.bin", b"one line"), ("g.txt", b"one line"),
        ("h.bin", b"two\nlines"), ("i.bin", b""), ("j.docx", docx.getvalue()), ("k.zip", b"PK\x03\x04broken"), ("l.bin", b"\xff\xfe\x00"), ("m.xls", bytes.fromhex("D0CF11E0A1B11AE1")),
    ]
    df = detect.detect(spark.createDataFrame(rows, "path string, content binary"), path="path")
    got = {r.path: (r.content_type, r.type_error) for r in df.collect()}
    kinds = {k: v[0] for k, v in got.items()}
    assert kinds["a.pdf"] == "application/pdf" and kinds["b.png"] == "image/png" and kinds["c.webp"] == "image/webp" and kinds["d.json"] == "application/json"
    assert kinds["e.bin"] == "text/csv" and kinds["f.bin"] == "text/html" and kinds["g.bin"] is None and kinds["g.txt"] == "text/plain" and kinds["h.bin"] == "text/plain"
    assert got["i.bin"][1] == "empty_source" and "wordprocessingml" in kinds["j.docx"] and got["k.zip"][1] == "malformed_office" and got["l.bin"][1] == "unsupported"
    lines = office.read_office(df).collect()
    # A paragraph stays whole on the page where it begins; its page break ends that page.
    assert [(r.page_number, r.text) for r in lines] == [(1, "سلام OCR"), (1, "two")]


def test_xlsx_and_pptx(spark):
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets><sheet name='s' r:id='rId1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R><r Id='rId1' Target='worksheets/sheet1.xml'/></R>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>نام</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>Alice</t></is></c><c r='AB2'><v> </v></c></worksheet>")
    p = io.BytesIO()
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("ppt/presentation.xml", "<p/>")
        z.writestr("ppt/slides/slide1.xml", "<s><sp><off x='12700' y='25400'/><ext cx='127000' cy='12700'/><p><t>Title</t></p></sp><pic><off x='0' y='0'/><ext cx='12700' cy='12700'/></pic></s>")
    kind = detect.CONTAINERS
    rows = [("x", x.getvalue(), kind["xl/workbook.xml"]), ("p", p.getvalue(), kind["ppt/presentation.xml"]), ("bad", b"PK", kind["xl/workbook.xml"])]
    got = office.read_office(spark.createDataFrame(rows, "path string, content binary, content_type string")).collect()
    assert [(r.text, r.x0) for r in got if r.key == "x"] == [("نام", 36.0), ("Alice", 116.0)]
    assert [(r.text, r.picture, r.x0, r.y0) for r in got if r.key == "p"] == [("Title", False, 1.0, 2.0), ("", True, 0.0, 0.0)]
    assert [r.error for r in got if r.key == "bad"] == ["malformed_office: BadZipFile"]
    assert spark.range(1).select(office.column_number(F.lit("AB"))).head()[0] == 27


def test_lines_and_pages(spark):
    rows = [(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\x1cy\n\n \nz")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {}
    for r in text_pages.lines(df, "k", "t").orderBy("k", "line_index").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {1: ["a", "b"], 2: [""], 3: [""], 4: "x\x1cy\n\n \nz".splitlines()}
    p = {r.k: r for r in text_pages.pages(spark.createDataFrame([(1, "l\n" * 60)], "k int, t string"), "k", "t", 50).collect()}
    assert p[1].page_number in (1, 2)
    assert text_pages.pages(df, "k", "t").where("k = 4").head().native_lines == 3
    r = spark.createDataFrame([("<p>Hi <b>you</b></p><script>x()</script>",)], "h string").select(text_pages.visible_text(F.col("h")), text_pages.visible_text(F.col("h"), True)).head()
    assert r[0] == "\nHiyou\nx()" and r[1] == "\nHiyou\n"


def test_evaluation_reader_finds_problems(spark, tmp_path):
    import json

    line = lambda i, b: {"id": i, "raw_text": "x", "bbox": b, "reading_order": 0}
    docs = [{"document_id": "d", "category": "c", "pages": [{"page_number": 1, "width": 10, "height": 10, "page_text": "x", "lines": [line("a", [0, 0, 5, 5]), line("a", [0, 0, 50, 5])]}, {"page_number": 3, "width": 10, "height": 10, "page_text": "", "lines": []}]}]
    (tmp_path / "g.json").write_text(json.dumps({"documents": docs}))
    t = evaluation.read(spark, str(tmp_path / "g.json"))
    assert {r.problem for r in evaluation.problems(t).collect()} == {"page_numbers", "repeated_line", "box_outside_page"}


def _boxes_at_random(spark, kind):
    """Small whole numbers, so with many ties and equal boxes; one page is too large to be taken together."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x, y = float(rng.randrange(12)), float(rng.randrange(12))
        page = "p999" if i < 60 else f"p{rng.randrange(600)}"
        rows.append((page, rng.randrange(2), rng.choice([None, "a", "b", "c", "d"]), rng.randrange(4), rng.randrange(4), x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9), "rtl" if page.endswith("3") else "ltr"))
    return spark.createDataFrame(rows, f"page string, side int, id string, idx int, {kind} int, x0 double, y0 double, x1 double, y1 double, direction string")


def _both_ways(monkeypatch, module, run):
    """Rows of a step for groups of one size together, and for each group alone."""
    with monkeypatch.context() as m:
        taken = []
        m.setattr(module, "sequential", lambda *a: taken.append(a) or a[0].withColumns({c: F.lit(None) for c in ("accepted", "warning", "filled") if c not in a[0].columns}))
        run()
    df, keys, order, step, schema, same_size, *finite = taken[0]
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = df.sort(*keys, *order).toArrow().combine_chunks()
    out = []
    for few in (groups.FEW, 0):
        monkeypatch.setattr(groups, "FEW", few)
        batches = groups._together(rows, groups._starts(rows, keys), keys, step, same_size, *(finite or [()]), schema.fieldNames(), to_arrow_schema(schema))
        out.append(sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=str))
    assert len(out[0]) > 1000
    return out


def test_reading_rows_of_groups_together(spark, monkeypatch):
    df = _boxes_at_random(spark, "n")
    together, alone = _both_ways(monkeypatch, layout, lambda: layout.reading_rows(df.select("page", "id", "idx", "x0", "y0", "x1", "y1", "direction"), "page"))
    assert together == alone


def test_matches_of_groups_together(spark, monkeypatch):
    df = _boxes_at_random(spark, "reading_order")
    together, alone = _both_ways(monkeypatch, matching, lambda: matching.match_lines(df.where("side = 0"), df.where("side = 1"), "page", 0.1))
    assert together == alone


def test_cells_of_groups_together(spark, monkeypatch):
    df = _boxes_at_random(spark, "row").select(
        F.col("page").alias("region_id"), F.lit(14.0).alias("region_width"), F.lit(18.0).alias("region_height"), F.col("idx").alias("cell_idx"), "row", F.length("page").alias("column"), F.col("id").alias("text"),
        F.lit(None).cast("string").alias("raw_text"), g.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("bbox"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("polygon"), F.lit(0.5).alias("confidence"),
    )
    together, alone = _both_ways(monkeypatch, tables, lambda: tables.check_cells(df))
    assert together == alone and {r[5] for r in alone} >= {None, "duplicate_address", "overlapping_duplicate", "invalid_text", "invalid_geometry"}


def test_groups_go_on_over_batches(spark, monkeypatch):
    """Whole groups, however the rows are cut into batches."""
    df = spark.range(1000).select((F.col("id") / 7).cast("long").cast("string").alias("page"), F.col("id").alias("i"), F.lit(0.0).alias("x0"), (F.col("id") * 20.0).alias("y0"), (F.col("id") * 20.0 + 5).alias("y1"), F.lit("ltr").alias("direction"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.i: r.row_order for r in layout.reading_rows(df, "page").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i % 7 for i in range(1000)}


def test_cells_of_one_index_count_once(spark):
    """Two cells with one index are two cells; their table was joined by the index, which made four."""
    df = cells(spark, [(0, 0, "a", (0, 0, 30, 20), 0.9), (0, 1, "b", (30, 0, 60, 20), 0.9)]).withColumn("cell_idx", F.lit(0))
    r = tables.validate(df).head()
    assert (r.n_cells, r.n_filled, r.warnings) == (2, 2, []) and len(r.cells) == 2


def test_items_of_an_order_are_cells_once(spark, sf_dir):
    """An order's cells and warnings are no more than its items, though line numbers repeat."""
    from folioscope.plans import queries

    out = queries.QUERIES["table_validate"](spark, sf_dir).withColumn("n", F.col("n_cells") + F.size(F.filter(F.split("warnings", ";"), lambda w: ~w.isin("", "empty_result", "excessive_empty_cells"))))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("string").alias("region_id")).agg(F.count(F.lit(1)).alias("items"))
    assert out.join(items, "region_id", "full").where("n is null or n <> items").count() == 0

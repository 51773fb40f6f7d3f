import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry as g
from folioscope.operators import imaging, layout, routing


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_quality_flags(spark):
    names = "contrast sharpness skew perspective background_variation text_scale compression".split()
    df = spark.createDataFrame([(5.0, 1.0, -2.0, 0.3, 0.2, 8.0, 0.9), (50.0, 9.0, 0.2, None, None, None, None)], ", ".join(f"{n} double" for n in names))
    got = [r[0] for r in df.select(imaging.quality_flags()).collect()]
    assert got == [["low_contrast", "low_sharpness", "skew_detected", "perspective_suspected", "uneven_background", "tiny_text_suspected", "compression_artifacts_suspected"], []]


def test_tiny_text_and_retries(spark):
    no, none = F.lit(False), F.lit(None).cast("double")
    t = one(spark, imaging.tiny_text(F.lit(8.0), none, no, no, F.lit(300)).alias("t"), imaging.tiny_text(none, F.lit(20.0), F.lit(True), no, F.lit(300)).alias("u"))
    assert (t.t.is_tiny, t.t.reasons, t.t.recommended_dpi, t.t.region_scales) == (True, ["estimated_line_height_below_threshold"], 600, [2, 3, 4])
    assert (t.u.is_tiny, t.u.recommended_dpi, t.u.region_scales) == (False, 300, [])
    plan = imaging.retry_plan(True, 2)
    assert [a.stage for a in plan] == ["first_pass", "alternate_preprocessing", "alternate_preprocessing", "higher_resolution", "alternate_scale", "alternate_backend"] and plan[3].dpi == 600
    assert imaging.retry_plan(False, 0) == [] and len(imaging.retry_plan(False, 9, max_attempts=3)) == 3
    with pytest.raises(ValueError):
        imaging.retry_plan(False, 1, scales=(1,))
    r = one(spark, imaging.retry_variants(F.lit(True), 2).alias("a"), imaging.retry_variants(F.lit(False), 0).alias("b"))
    assert r.a == ["source-render", "region-scale-2", "region-scale-3"] and r.b == ["source-render"]


def test_crops_renders_stages(spark):
    b = g.box(*(F.lit(v) for v in (-1.0, 2.2, 3.001, 2.3)))
    r = one(spark, imaging.crop_box(b, F.lit(10), F.lit(3)).alias("c"), imaging.render_dimensions(F.lit(612.0), F.lit(792.0), F.lit(300), 10**6).alias("d"), imaging.stage_of(F.lit(600), F.lit(2.0)).alias("s"), imaging.stage_of(F.lit(600), F.lit(1.0), F.lit("first_pass")).alias("t"))
    assert tuple(r.c) == (0, 2, 4, 3) and (r.d.width, r.d.height, r.d.problem) == (2550, 3300, "too_many_pixels") and (r.s, r.t) == ("crop_upscaled", "first_pass")


def test_labels_and_types(spark):
    df = spark.createDataFrame([(" Body Text ", 0.9), ("key/value", 0.9), ("Handwritten", 0.3), ("blob", 0.9), (None, None)], "label string, confidence double")
    got = [(r.block_type, r.route_hint, r.text_type, r.needs_review, r.uncertainty_flags) for r in routing.classify_labels(df).collect()]
    assert got == [("paragraph", "printed_text", "printed", False, []), ("form", "form", "unknown", False, []), ("handwriting", "handwriting", "handwritten", True, ["low_layout_confidence"]), ("unknown", "unknown", "unknown", True, ["unknown_provider_class"]), ("unknown", "unknown", "unknown", False, [])]
    kind = lambda *v: one(spark, layout.block_type_of_pixels(*(F.lit(float(x)) for x in v)))[0]
    assert kind(10, 40, 200, 500, 1, 800, 1000, 12) == "title" and kind(10, 20, 0, 800, 1, 800, 1000, 12) == "header" and kind(900, 910, 390, 410, 1, 800, 1000, 12) == "page_number" and kind(400, 500, 0, 800, 3, 800, 1000, 12) == "paragraph"


def test_regions_words_merge(spark):
    schema = "id int, bbox struct<x0:double,y0:double,x1:double,y1:double>, polygon array<struct<x:double,y:double>>, page_width double, page_height double, confidence double"
    rows = [(1, (0.0, 0.0, 50.0, 200.0), None, 100.0, 100.0, 0.5), (2, (0.0, 0.0, 9.0, 9.0), [(1.0, 1.0), (500.0, 1.0), (1.0, 50.0)], 100.0, 100.0, None), (3, (200.0, 0.0, 300.0, 9.0), None, 100.0, 100.0, None), (4, (0.0, 0.0, 9.0, 9.0), [(1.0, 1.0), (2.0, 2.0)], 100.0, 100.0, None), (5, (0.0, 0.0, 9.0, 9.0), None, 100.0, 100.0, 1.5)]
    got = {r.id: (tuple(r.bbox) if r.bbox else None, r.problem) for r in layout.normalize_regions(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ((0, 0, 50, 100), None) and got[2] == ((1, 1, 100, 50), None) and got[3][1] == "not_visible" and got[4][1] == "polygon" and got[5][1] == "confidence"
    words = spark.createDataFrame([("p", "b", 0.5, 20.0, 1.0, 30.0, 11.0), ("p", "a", None, 0.0, 0.0, 10.0, 10.0), ("p", "c", 1.0, 0.0, 30.0, 9.0, 40.0)], "page string, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.text, r.confidence) for r in layout.words_in_rows(words, "page").orderBy("line_index").collect()] == [("a b", 0.5), ("c", 1.0)]
    native = spark.createDataFrame([("p", 0, "n0"), ("p", 1, "n1")], "page string, block_order int, block string")
    found = spark.createDataFrame([("p", 0, "r0"), ("q", 0, "r1")], "page string, block_order int, block string")
    assert sorted((r.page, r.block_order, r.block) for r in imaging.merge_mixed(native, found, ["page"]).collect()) == [("p", 0, "n0"), ("p", 1, "n1"), ("p", 2, "r0"), ("q", 0, "r1")]
    assert imaging.redact(native.withColumnRenamed("block", "text")).head().text == "[REDACTED]"

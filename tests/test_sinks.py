import json

import pytest

from folioscope import config
from folioscope.operators import evaluate, export
from folioscope.sinks import artifacts, reports
from folioscope.sources import evaluation


def test_artifacts(tmp_path):
    store = artifacts.ArtifactStore(str(tmp_path))
    made = store.put("doc-1", "pages/page_0001/a.png", b"x")
    assert store.read_uri(made.uri) == b"x" == store.read_uri(f"{tmp_path}/doc-1/pages/page_0001/a.png") and made.byte_size == 1
    with pytest.raises(artifacts.ArtifactError):
        store.put("doc-1", "pages/page_0001/a.png", b"y")
    assert store.put("doc-1", "pages/page_0001/a.png", b"y", overwrite=True).sha256 != made.sha256
    for name in ("../x", "/x", "a//b", "a/../b", "c:/x", "", "."):
        with pytest.raises(artifacts.ArtifactError):
            store.put("doc-1", name, b"")
    with pytest.raises(artifacts.ArtifactError):
        artifacts.parse_uri("s3://b/x")
    assert artifacts.parse_uri("artifact://d/a\\b") == ("d", "a/b") and artifacts.crop_name(2, "c1") == "pages/page_0002/crops/c1.png"
    assert store.delete_document("doc-1") == 1 and not store.exists("doc-1", "pages/page_0001/a.png") and store.delete_document("doc-1") == 0


def test_settings(monkeypatch):
    s = config.Settings()
    assert s.hash() == config.Settings().hash() != s.for_mode("fast").hash() and s.for_mode("accurate").max_retries == 3
    monkeypatch.setenv("FOLIOSCOPE_MAX_PAGES", "7")
    monkeypatch.setenv("FOLIOSCOPE_HIGH_QUALITY_RETRY", "no")
    assert (config.from_environment().max_pages, config.from_environment().high_quality_retry) == (7, False)
    with pytest.raises(ValueError):
        config.Settings(default_dpi=900)


def test_tree_and_manifests(spark):
    documents = spark.createDataFrame([("d", "completed"), ("e", "failed")], "document_id string, status string")
    pages = spark.createDataFrame([("d", 2, 10.0), ("d", 1, 10.0)], "document_id string, page_number int, width double")
    blocks = spark.createDataFrame([("d", 1, 1, "b1"), ("d", 1, 0, "b0")], "document_id string, page_number int, block_order int, block_id string")
    lines = spark.createDataFrame([("d", 1, 0, 1, "second", "verified", False, [], []), ("d", 1, 0, 0, "first", "uncertain", False, [], [])], "document_id string, page_number int, block_order int, position int, raw_text string, status string, needs_review boolean, flags array<string>, reason_codes array<string>")
    cells = spark.createDataFrame([("d", 1, 1, 0, 1, "B"), ("d", 1, 1, 0, 0, "A")], "document_id string, page_number int, block_order int, row int, column int, raw_text string")
    trees = {r.document_id: json.loads(r.json) for r in export.document_json(documents, pages, blocks, lines, cells).collect()}
    d = trees["d"]
    assert [p["page_number"] for p in d["pages"]] == [1, 2] and [b["block_id"] for b in d["pages"][0]["blocks"]] == ["b0", "b1"]
    assert [x["raw_text"] for x in d["pages"][0]["blocks"][0]["lines"]] == ["first", "second"] and [c["raw_text"] for c in d["pages"][0]["blocks"][1]["table_cells"]] == ["A", "B"]
    assert trees["e"]["pages"] == []
    m = {r.page_number: json.loads(r.manifest) for r in export.page_manifests(pages, lines, "strict_verified_only").collect()}
    assert [x["raw_text"] for x in m[1]["lines"]] == ["second"] and m[2]["lines"] == []


def test_predictions_feed_the_evaluation_and_its_report(spark):
    line = "document_id string, page_number int, block_order int, position int, line_id string, raw_text string, normalized_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, tiny_text boolean, status string, attempts array<struct<backend:string,raw_text:string,normalized_text:string,dpi:double,region_scale:double>>"
    tries = [("a", "heXlo", None, 300.0, 1.0), ("b", "hello", None, 600.0, 2.0)]
    done = spark.createDataFrame([("d", 1, 0, 0, "l1", "hello", None, (0.0, 0.0, 9.0, 9.0), True, "verified", tries)], line)
    none = spark.createDataFrame([], "document_id string, page_number int, cell_id string, row int, column int, raw_text string, normalized_text string")
    p = evaluation.predictions(spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, page_number int"), done, none)
    assert {r.page_number: r.page_text for r in p["pages"].collect()} == {1: "hello", 2: ""}
    truth_pages = spark.createDataFrame([("d", 1, "c", "hello")], "document_id string, page_number int, category string, page_text string")
    m = evaluate.evaluate(truth_pages, p["lines"], none.withColumnRenamed("cell_id", "id"), p["pages"], p["lines"], p["cells"])
    r = {x.category: x for x in m.collect()}["overall"]
    assert r.cer == 0 and r.first_pass_cer == pytest.approx(0.2) and r.crop_upscaled_cer == 0 and r.tiny_text_recovery_improvement == pytest.approx(0.2) and r.verification_rate == 1.0
    gates = evaluate.gates(evaluate.long_metrics(m), spark.createDataFrame([("g", "cer", "overall", None, 0.1)], "name string, metric string, category string, minimum double, maximum double"))
    body = json.loads(reports.as_json(m, gates, about={"set": "s"}))
    assert body["gates"]["passed"] and [c["category"] for c in body["categories"]] == ["c", "overall"]
    text = reports.as_markdown(m, gates, about={"set": "s"})
    assert "- set: s\n" in text and "- passed: overall, g" in text
    assert text.index("## c\n") < text.index("## overall\n") and "- cer: 0.0000" in text.split("## overall")[1] and "FAILED" not in text

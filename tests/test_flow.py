"""Evaluation, fields, corrections, export, jobs, adapters, and the registered queries."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.adapters import contracts
from folioscope.operators import evaluate, export, fields, governance, metrics
from folioscope.plans import queries as plans
from folioscope.streaming import jobs

LINE = "document_id string, page_number int, idx int, id string, reading_order int, raw_text string, normalized_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, tiny_text boolean, verification_status string, sent_to_verification boolean, candidates array<struct<backend:string,raw_text:string,normalized_text:string>>, tiny_text_stages array<struct<stage:string,raw_text:string,normalized_text:string>>"


def line(doc, idx, i, text, box, tiny=False, status="accepted", candidates=(), stages=()):
    return (doc, 1, idx, i, idx, text, None, tuple(map(float, box)), tiny, status, False, list(candidates), list(stages))


def test_evaluation(spark):
    pages = spark.createDataFrame([("d", 1, "a", "hello world"), ("e", 1, "b", "x")], "document_id string, page_number int, category string, page_text string")
    pred_pages = spark.createDataFrame([("d", 1, "hello word"), ("e", 1, "x")], "document_id string, page_number int, page_text string")
    ref = [line("d", 0, "l1", "hello", (0, 0, 10, 10)), line("d", 1, "l2", "world", (0, 20, 10, 30), tiny=True), line("e", 0, "l3", "x", (0, 0, 10, 10))]
    stage = ("first_pass", "wxrld", None)
    pred = [line("d", 0, "l1", "hello", (0, 0, 10, 10)), line("d", 1, "l2", "word", (0, 20, 10, 30), status="human_review_required", candidates=[("a", "word", None), ("b", "world", None)], stages=[stage]), line("e", 0, "other", "x", (0, 0, 9, 10))]
    cells = spark.createDataFrame([("d", 1, 0, "c", 0, 0, "v", None)], "document_id string, page_number int, idx int, id string, row int, column int, raw_text string, normalized_text string")
    frame = lambda rows: spark.createDataFrame(rows, LINE)
    out = {r.category: r for r in evaluate.evaluate(pages, frame(ref), cells, pred_pages, frame(pred), cells).collect()}
    a, b, all_ = out["a"], out["b"], out["overall"]
    assert a.cer == pytest.approx(0.1) and a.page_cer == pytest.approx(1 / 11) and a.page_wer == pytest.approx(0.5) and a.exact_line_accuracy == 0.5
    assert (a.line_detection_precision, a.line_detection_recall, a.table_cell_accuracy, a.reading_order_accuracy) == (1, 1, 1, 1)
    assert a.human_review_rate == 0.5 and a.backend_disagreement_rate == 1.0 and a.first_pass_cer == pytest.approx(0.2) and a.tiny_text_recovery_improvement == pytest.approx(0.0)
    assert b.cer == 0 and b.matched_line_count == 1 and b.reading_order_accuracy == 0 and b.table_cell_accuracy == 1.0 and b.tiny_text_recovery_improvement is None
    assert all_.reference_line_count == 3 and all_.document_count == 2

    long = evaluate.long_metrics(evaluate.evaluate(pages, frame(ref), cells, pred_pages, frame(pred), cells))
    rules = spark.createDataFrame([("g1", "cer", "overall", None, 0.5), ("g2", "cer", "zzz", None, 1.0), ("g3", "tiny_text_recovery_improvement", "b", 0.0, None)], "name string, metric string, category string, minimum double, maximum double")
    gate = {r.name: (r.passed, r.reason) for r in evaluate.gates(long, rules).collect()}
    assert gate["g1"][0] and gate["g2"] == (False, "category metrics are missing") and gate["g3"] == (False, "metric is unavailable for this category")


def test_comparison_has_directions(spark):
    m = lambda *v: spark.createDataFrame([("c", k, x) for k, x in v], "category string, metric string, value double")
    now, before = m(("cer", 0.2), ("exact_line_accuracy", 0.5), ("human_review_rate", 0.1)), m(("cer", 0.1), ("exact_line_accuracy", 0.4), ("human_review_rate", 0.3))
    got = {r.metric: (r.direction, r.regression) for r in evaluate.compare(now, before).collect()}
    assert got == {"cer": ("lower", True), "exact_line_accuracy": ("higher", False), "human_review_rate": ("neutral", False)}
    with pytest.raises(ValueError):
        evaluate.compare(now, before, -1)


def test_field_rule(spark):
    rows = [("d", 1, 0, "i1", "paragraph", "nothing", False), ("d", 1, 1, "i2", "paragraph", "شماره قرارداد ١٢٣٤٥", True), ("d", 1, 2, "i3", "paragraph", "شماره قرارداد 9", False)]
    items = spark.createDataFrame(rows, "doc string, page int, pos int, item_id string, block_type string, raw_text string, needs_review boolean")
    rules = [fields.Rule("contract_number", pattern=r"شماره قرارداد\s+([۰-۹١-٩0-9]+)"), fields.Rule("total", required=True), fields.Rule("in_table", pattern="nothing", block_types=("table",))]
    got = {r.name: r for r in fields.extract(items, rules, "doc", ["page", "pos"]).collect()}
    c = got["contract_number"]
    assert (c.raw_value, c.evidence, c.needs_review, c.missing) == ("١٢٣٤٥", "i2", True, False)
    assert got["total"].missing and got["in_table"].raw_value is None


def test_corrections_and_retention(spark):
    items = spark.createDataFrame([(1, "raw", "uncertain", True, ["low_confidence"], []), (2, "raw2", "accepted", False, [], [])], "id int, raw_text string, status string, needs_review boolean, flags array<string>, reason_codes array<string>")
    made = spark.createDataFrame([(1, 1, "old", "r", 1), (1, 2, "new", "r", 2)], "id int, revision int, corrected_text string, reviewer string, created_at int")
    got = {r.id: r for r in governance.apply_corrections(items, made, ["id"]).collect()}
    assert (got[1].corrected_text, got[1].status, got[1].flags, got[1].raw_text, got[1].revision) == ("new", "verified", [], "raw", 2) and got[2].status == "accepted"
    t = F.lit(datetime.datetime(2024, 1, 1))
    r = spark.range(1).select(governance.expired(t, F.lit(30), F.lit(datetime.datetime(2024, 1, 31))).alias("a"), governance.expired(t, F.lit(31), F.lit(datetime.datetime(2024, 1, 31))).alias("b"), governance.expired(t, F.lit(None), F.lit(datetime.datetime(2034, 1, 1))).alias("c")).head()
    assert (r.a, r.b, r.c) == (True, False, False)


def test_export(spark, tmp_path):
    schema = "document_id string, page_number int, block_order int, block_id string, block_type string, position int, cell_row int, cell_column int, raw_text string, normalized_text string, corrected_text string, status string, needs_review boolean, flags array<string>, reason_codes array<string>"
    rows = [
        ("d", 1, 0, "b0", "paragraph", 1, None, None, "second", None, None, "verified", False, [], []),
        ("d", 1, 0, "b0", "paragraph", 0, None, None, "fi|rst", None, "", "verified", False, [], []),
        ("d", 1, 0, "b0", "paragraph", 2, None, None, "hidden", None, None, "uncertain", False, [], []),
        ("d", 1, 1, "b1", "table", 0, 0, 1, "B", None, None, "accepted", False, [], []),
        ("d", 1, 1, "b1", "table", 0, 0, 0, "A", None, None, "accepted", False, [], []),
        ("d", 2, 0, "b2", "paragraph", 0, None, None, "x", None, "y", "verified", False, [], []),
    ]
    items = spark.createDataFrame(rows, schema)
    pages = items.select("document_id", "page_number").distinct()
    text = export.document_text(export.pages_text(items, pages))
    assert text.head().text == "fi|rst\nsecond\nA | B\f\ny\n"
    assert "[uncertain] hidden" in export.document_text(export.pages_text(items, pages, "all_with_status")).head().text
    md = export.markdown(items, spark.createDataFrame([("d", "completed")], "document_id string, document_status string")).head().markdown
    assert md.startswith("# Document d\n\n- Status: completed\n\n## Page 1\n") and "- 0 [verified] fi\\|rst\n- 1 [verified] second" in md and "| 0 | 0 | A |" in md and md.endswith("\n")
    counts = export.manifest_counts(items, ["document_id"], "accepted_verified").head()
    assert (counts.pages, counts.lines, counts.table_cells, counts.exported_lines, counts.exported_table_cells, counts.review_required) == (2, 4, 2, 3, 2, 1)
    key = lambda rev, formats: spark.range(1).select(export.export_key(F.lit("c" * 64), "p", formats, F.lit(rev))).head()[0]
    assert len({key(0, ["json"]), key(1, ["json"]), key(0, ["json", "txt"])}) == 3
    export.write(text, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        export.write(text, str(tmp_path / "out"))


def test_metrics_and_jobs(spark):
    rows = [(1, "increment", "a", "x=1", 1.0), (2, "observe", "b", "", 3.0), (3, "increment", "a", "x=1", 2.0), (4, "observe", "b", "", 1.0), (5, "increment", "late", "", 1.0)]
    df = spark.createDataFrame(rows, "seq long, kind string, name string, labels string, value double")
    got = {r.name: r for r in metrics.snapshot(df, max_series=2).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["value"] == 3.0 and (got["b"]["count"], got["b"]["sum"], got["b"]["min"], got["b"]["max"]) == (2, 4.0, 1.0, 3.0)
    r = spark.createDataFrame([(1, "k", "f1"), (2, "k", "f2"), (3, "k", "f1"), (4, None, "f1"), (5, None, "f3")], "seq long, idempotency_key string, fingerprint string")
    assert [x.outcome for x in jobs.submissions(r).orderBy("seq").collect()] == ["accepted", "conflict", "replay", "replay", "accepted"]
    p = spark.range(1).select(jobs.progress(F.lit(0), F.lit(0)).alias("a"), jobs.progress(F.lit(5), F.lit(10)).alias("b"), jobs.progress(F.lit(20), F.lit(10)).alias("c")).head()
    assert (p.a, p.b, p.c) == (5.0, 50.0, 99.0)


def test_streams(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")

    def drain(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    latest = drain(jobs.stream_latest(events(), "user_id", "ts", ["event_type"]), "update", "latest")
    assert latest.count() == batch.select("user_id").distinct().count()
    once = drain(jobs.stream_submissions(events().withColumn("fingerprint", F.col("event_type"))), "append", "once")
    assert once.count() == batch.select("event_type").distinct().count()
    windows = drain(jobs.stream_counts(events(), "1 hour"), "append", "windows")
    assert windows.where("count <= 0").count() == 0


def test_adapters_fail_closed(spark):
    rows = spark.createDataFrame([("r1",), ("r2",)], "region_id string")
    got = contracts.run(rows, contracts.Unavailable("none")).collect()
    assert [(r.text, r.flags, r.error) for r in got] == [(None, ["missing_backend", "capability_unavailable"], "capability_unavailable")] * 2

    class Broken(contracts.Unavailable):
        def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
            raise RuntimeError("no model")

    broken = Broken("b")
    run_twice = contracts.PerWorker("m", lambda: object())
    assert run_twice.get() is run_twice.get()
    assert broken.name == "b"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    import duckdb
    import numpy as np

    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name not in plans.SQL:
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations pages benchmark".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(plans.SQL[name]).fetchdf()

    def plain(df):
        none = lambda v: v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v))
        number = lambda v: isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_))
        df = df[sorted(df.columns)].map(lambda v: "-" if none(v) else f"{float(v):.9g}" if number(v) else str(v))
        return df.sort_values(list(df.columns), ignore_index=True)

    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)

"""Evaluation against ground truth: error rates, detection, order, cells, gates, regressions.

Each grain (pages, lines, cells, statuses) is one aggregate with grouping sets
for categories and the whole; the small results are joined by category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .matching import detection, match_lines

#: Metrics whose fall is an improvement, and those that neither rise nor fall judges.
LOWER_IS_BETTER = ("page_cer", "page_wer", "cer", "wer")
NEUTRAL = ("verification_rate", "human_review_rate", "backend_disagreement_rate")
METRICS = (
    "page_cer page_wer cer wer exact_line_accuracy line_detection_precision line_detection_recall reading_order_accuracy table_cell_accuracy accepted_automatically_rate verification_rate human_review_rate backend_disagreement_rate tiny_text_recovery_improvement"
).split()
OVERALL = "overall"


def by_category(df: DataFrame, category: str, *aggregates: Column) -> DataFrame:
    """The aggregates for each category and, as ``overall``, for all rows."""
    sets = df.groupingSets([(F.col(category),), ()], F.col(category)).agg(*aggregates, F.grouping(category).alias("_all"))
    return sets.withColumn(category, F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(category))).drop("_all")


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def review_rate(reviewed: Column, total: Column) -> Column:
    return ratio(reviewed, total)


def positional_accuracy(predicted: Column, reference: Column, longer: bool) -> Column:
    """Share of reference entries that stand at the same place; of the longer of both, or of the reference."""
    hits = F.size(F.filter(F.zip_with(predicted, reference, lambda p, r: p.isNotNull() & r.isNotNull() & (p == r)), lambda x: x))
    n = F.greatest(F.size(predicted), F.size(reference)) if longer else F.size(reference)
    return F.when((F.size(predicted) == 0) & (F.size(reference) == 0), 1.0).when(F.size(reference) == 0, 0.0).otherwise(hits / n)


def text(raw: str = "raw_text", normalized: str = "normalized_text") -> Column:
    return F.coalesce(F.col(normalized), F.col(raw), F.lit(""))


def evaluate(gt_pages: DataFrame, gt_lines: DataFrame, gt_cells: DataFrame, pred_pages: DataFrame, pred_lines: DataFrame, pred_cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of metrics per category and overall.

    Keys are document_id and page_number; categories come with gt_pages.  Error
    rates are means over lines or pages.  Exact lines are compared by matched
    line, so that stored order does not matter.
    """
    keys = ["document_id", "page_number"]
    page = F.concat_ws("/", *keys)
    cat = gt_pages.select(*keys, "category")
    pages = gt_pages.select(*keys, "category", F.coalesce("page_text", F.lit("")).alias("r")).join(pred_pages.select(*keys, F.col("page_text").alias("p")), keys, "left").withColumn("p", F.coalesce("p", F.lit("")))
    m_pages = by_category(pages, "category", F.countDistinct("document_id").alias("document_count"), F.count(F.lit(1)).alias("page_count"), F.avg(tx.cer(F.col("p"), F.col("r"))).alias("page_cer"), F.avg(tx.wer(F.col("p"), F.col("r"))).alias("page_wer"))

    ref = gt_lines.select(*keys, page.alias("page"), "id", "reading_order", text().alias("r"), "bbox.*")
    pred = pred_lines.select(*keys, page.alias("page"), "id", "idx", "reading_order", text().alias("p"), "bbox.*")
    pairs = match_lines(ref.drop("r", *keys), pred.drop("p", "reading_order", *keys), "page", threshold)
    lines = ref.join(pairs.select("page", F.col("reference_id").alias("id"), "prediction_id"), ["page", "id"], "left").join(pred.select("page", F.col("id").alias("prediction_id"), "p"), ["page", "prediction_id"], "left").withColumn("_p", F.coalesce("p", F.lit(""))).join(cat, keys)
    m_lines = by_category(
        lines, "category", F.count(F.lit(1)).alias("reference_line_count"), F.count("prediction_id").alias("matched_line_count"),
        F.avg(tx.cer(F.col("_p"), F.col("r"))).alias("cer"), F.avg(tx.wer(F.col("_p"), F.col("r"))).alias("wer"), F.avg((F.col("_p") == F.col("r")).cast("double")).alias("exact_line_accuracy"),
    )

    found = detection(ref.drop("r").withColumn("idx", F.col("reading_order")), pred.drop("p"), "page", threshold).join(cat.withColumn("page", page), "page")
    p_n, r_n = F.sum("n_predicted"), F.sum("n_reference")
    m_found = by_category(
        found, "category",
        F.when(p_n > 0, F.sum(F.col("precision") * F.col("n_predicted")) / p_n).otherwise(F.when(r_n > 0, 0.0).otherwise(1.0)).alias("line_detection_precision"),
        F.when(r_n > 0, F.sum(F.col("recall") * F.col("n_reference")) / r_n).otherwise(F.when(p_n > 0, 0.0).otherwise(1.0)).alias("line_detection_recall"),
    )

    ids = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "id"))), lambda x: x.id).alias(name))
    none = F.array().cast("array<string>")
    order = cat.join(ids(ref, "_r"), keys, "left").join(ids(pred, "_p"), keys, "left").withColumns({"_r": F.coalesce("_r", none), "_p": F.coalesce("_p", none)})
    m_order = by_category(order, "category", F.avg(positional_accuracy(F.col("_p"), F.col("_r"), True)).alias("reading_order_accuracy"))

    state = pred_lines.join(cat, keys)
    texts = F.array_distinct(F.transform("candidates", lambda c: F.coalesce(c.normalized_text, c.raw_text)))
    several = F.size("candidates") >= 2
    n = F.count(F.lit(1))
    m_state = by_category(
        state, "category", n.alias("predicted_line_count"), ratio(F.count_if(F.col("verification_status") == "accepted"), n).alias("accepted_automatically_rate"),
        ratio(F.count_if("sent_to_verification"), n).alias("verification_rate"), ratio(F.count_if(F.col("verification_status") == "human_review_required"), n).alias("human_review_rate"),
        ratio(F.count_if(several & (F.size(texts) > 1)), F.count_if(several)).alias("backend_disagreement_rate"),
    )

    address = [*keys, "row", "column"]
    last = pred_cells.groupBy(*address).agg(F.max_by(text(), "idx").alias("_p"))
    cells = gt_cells.select(*address, text().alias("_r")).join(last, address, "left").join(cat, keys)
    m_cells = by_category(cells, "category", n.alias("reference_table_cell_count"), ratio(F.count_if(F.col("_p") == F.col("_r")), n).alias("table_cell_accuracy"))
    m_tiny = tiny_text(gt_lines.join(cat, keys), pred_lines)

    out = m_pages
    for m in (m_lines, m_found, m_order, m_state, m_cells, m_tiny):
        out = out.join(m, "category", "left")
    ones = {c: F.coalesce(c, F.lit(1.0)) for c in ("exact_line_accuracy", "table_cell_accuracy", "line_detection_precision", "line_detection_recall")}
    rates = ("cer", "wer", "accepted_automatically_rate", "verification_rate", "human_review_rate", "backend_disagreement_rate")
    counts = ("reference_line_count", "matched_line_count", "predicted_line_count", "reference_table_cell_count", "tiny_text_count")
    return out.withColumns(ones | {c: F.coalesce(c, F.lit(0.0)) for c in rates} | {c: F.coalesce(c, F.lit(0)) for c in counts})


def tiny_text(reference: DataFrame, prediction: DataFrame) -> DataFrame:
    """(category, tiny_text_count, error rate by stage, recovery improvement): means of documents' means.

    ``reference`` are lines with category, ``prediction`` lines with tiny_text_stages and their final text.
    """
    keys = ["document_id", "page_number", "id"]
    tiny = reference.where("tiny_text").select(*keys, "category", text().alias("r"))
    stages = prediction.select(*keys, F.explode(F.concat(F.transform("tiny_text_stages", lambda s: F.struct(s.stage.alias("stage"), F.coalesce(s.normalized_text, s.raw_text).alias("p"))), F.array(F.struct(F.lit("verified_final").alias("stage"), text().alias("p"))))).alias("s")).select(*keys, "s.*")
    names = ("first_pass", "high_dpi", "crop_upscaled", "verified_final")
    error = tx.cer(F.col("p"), F.col("r"))
    per_doc = tiny.join(stages, keys, "left").groupBy("category", "document_id").agg(F.countDistinct("id").alias("n"), *(F.avg(F.when(F.col("stage") == s, error)).alias(f"{s}_cer") for s in names))
    per_doc = per_doc.withColumn("tiny_text_recovery_improvement", F.col("first_pass_cer") - F.col("verified_final_cer"))
    return by_category(per_doc, "category", F.sum("n").alias("tiny_text_count"), *(F.avg(f"{s}_cer").alias(f"{s}_cer") for s in names), F.avg("tiny_text_recovery_improvement").alias("tiny_text_recovery_improvement"))


def long_metrics(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(category, metric, value) of a wide table of metrics."""
    wanted = [m for m in (names or METRICS) if m in metrics.columns]
    return metrics.select("category", *(F.col(m).cast("double") for m in wanted)).unpivot("category", wanted, "metric", "value")


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, category, metric, actual, passed, reason) of each gate; a missing category or metric fails.

    ``metrics`` is long; ``rules`` (name, metric, category, minimum, maximum) have exactly one bound.
    """
    have = metrics.select("category").distinct().withColumn("_known", F.lit(True))
    out = rules.join(metrics.withColumnRenamed("value", "actual"), ["category", "metric"], "left").join(have, "category", "left")
    bound_ok = F.col("minimum").isNull() != F.col("maximum").isNull()
    passed = F.coalesce(bound_ok & F.coalesce(F.col("actual") >= F.col("minimum"), F.col("minimum").isNull()) & F.coalesce(F.col("actual") <= F.col("maximum"), F.col("maximum").isNull()) & F.col("actual").isNotNull(), F.lit(False))
    reason = F.when(F.col("_known").isNull(), "category metrics are missing").when(F.col("actual").isNull(), "metric is unavailable for this category").when(~bound_ok, "a gate has exactly one bound").when(F.col("minimum").isNotNull(), F.when(passed, "at least the minimum").otherwise("below the minimum")).otherwise(F.when(passed, "at most the maximum").otherwise("above the maximum"))
    return out.select("name", "category", "metric", "minimum", "maximum", "actual", passed.alias("passed"), reason.alias("reason"))


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0, lower: tuple[str, ...] = LOWER_IS_BETTER, neutral: tuple[str, ...] = NEUTRAL) -> DataFrame:
    """(category, metric, current, baseline, delta, direction, regression) of the pairs that both have."""
    if tolerance < 0:
        raise ValueError("tolerance cannot be negative")
    both = current.select("category", "metric", F.col("value").alias("current")).join(baseline.select("category", "metric", F.col("value").alias("baseline")), ["category", "metric"]).where("current is not null and baseline is not null")
    direction = F.when(F.col("metric").isin(*lower), "lower").when(F.col("metric").isin(*neutral) if neutral else F.lit(False), "neutral").otherwise("higher")
    delta = F.col("current") - F.col("baseline")
    worse = F.when(F.col("direction") == "lower", F.col("delta") > tolerance).when(F.col("direction") == "higher", F.col("delta") < -tolerance).otherwise(F.lit(False))
    return both.withColumn("delta", delta).withColumn("direction", direction).withColumn("regression", worse)

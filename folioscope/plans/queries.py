"""Queries that apply the operators to whole driver tables.

None of these tables is a recognised document, so each query says what stands
for what.  Where SQL can express the operator, ``SQL`` holds DuckDB SQL with
the same columns; the rest is tested against small golden tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import hashing
from ..functions import text as tx
from ..operators import document, evaluate, export, fields, governance, imaging, layout, matching, metrics, rollup, routing, tables, verify
from ..sources import detect, text_pages
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input of less than this for each core is dealt out before work on texts: such a file is often one row group, so one task.
SMALL_BYTES = 16 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt out to all cores if it is small; a large one keeps the splits of its files."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents.text: (doc_id, page_number, line_index, text)."""
    return text_pages.lines(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


#: SQL for the lines of documents: CR LF, LF and CR end a line; no line after a final end.
_LINES = r"""lines AS (
  SELECT doc_id, CAST(i AS INTEGER) AS line_index, parts[i + 1] AS text FROM (
    SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (
      SELECT doc_id, CASE WHEN parts[-1] = '' AND len(parts) > 1 THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM (
        SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents))))"""
#: White space as Python sees it, for SQL patterns.
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Category C without unassigned characters, and the replacement character.
_ODD = r"[\x00-\x1F\x7F-\x9F\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{E000}-\x{F8FF}\x{FEFF}\x{FFF9}-\x{FFFB}\x{FFFD}]"


# --- text -------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_index // 2773 + 1 AS INTEGER) AS page_number, CAST(line_index % 2773 AS INTEGER) AS line_index, text FROM lines")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical lines and pages of every document."""
    return lines_of(spark, sf_dir)


@query(
    f"""WITH {_LINES}, p AS (SELECT doc_id, line_index // 2773 + 1 AS page_number, count(*) AS n, count(*) FILTER (regexp_replace(text, '{_WS}', '', 'g') <> '') AS native,
      sum(length(regexp_replace(regexp_replace(text, '^{_WS}+', ''), '{_WS}+$', ''))) AS characters FROM lines GROUP BY 1, 2)
    SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, n AS n_lines, native AS native_lines, CAST(characters AS BIGINT) AS characters,
      greatest(792.0, 72.0 + n * 18.0)::DOUBLE AS height, least(1.0, native * 14.0 * 540.0 / (612.0 * greatest(792.0, 72.0 + n * 18.0)))::DOUBLE AS coverage FROM p"""
)
def logical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every document with their synthetic geometry."""
    out = text_pages.pages(texts(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "page_number", F.col("n_lines").cast("long").alias("n_lines"), F.col("native_lines").cast("long").alias("native_lines"), F.col("characters").cast("long").alias("characters"), "height", F.round("coverage", 12).alias("coverage"))


SQL["logical_pages"] = SQL["logical_pages"].replace("least(1.0, native", "round(least(1.0, native").replace("n * 18.0)))::DOUBLE AS coverage", "n * 18.0))), 12)::DOUBLE AS coverage")


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(
        regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x{{61C}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '{_WS}+', ' ', 'g'),
        chr(1610) || chr(1609) || chr(1603) || chr(1577) || '0123456789٠١٢٣٤٥٦٧٨٩', chr(1740) || chr(1740) || chr(1705) || chr(1607) || '۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹'), '^{_WS}+', ''), '{_WS}+$', '') AS normalized FROM documents"""
)
def normalize_builtin_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks, zero-width characters, variants, all digits, collapsed white space, edges."""
    t = F.coalesce(F.col("text"), F.lit(""))
    policy = tx.Normalization(unicode_form=None, digits="preserve", whitespace="collapse", zero_width="remove")
    return texts(spark, sf_dir, "documents").select("doc_id", tx.map_digits(tx.normalize(t, policy), "persian").alias("normalized"))


@query()
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default policy with NFC and protected tokens (SQL engines here lack look-around)."""
    return texts(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.coalesce(F.col("text"), F.lit("")), tx.DEFAULT).alias("normalized"))


@query(
    f"""WITH {_LINES}, f AS (SELECT *, regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}]') AS r, regexp_matches(text, '[A-Za-z]') AS l FROM lines)
    SELECT doc_id, line_index, CASE WHEN r AND l THEN 'fa+en' WHEN r THEN 'fa' WHEN l THEN 'en' ELSE 'und' END AS language,
      CASE WHEN r AND l THEN 'Arabic+Latin' WHEN r THEN 'Arabic' WHEN l THEN 'Latin' ELSE 'Unknown' END AS script FROM f"""
)
def language_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and script of each line by its letters."""
    t = F.col("text")
    return lines_of(spark, sf_dir).select("doc_id", "line_index", tx.infer_language(t).alias("language"), tx.infer_script(t).alias("script"))


_SCORED = rf"""scored AS (SELECT doc_id, line_index, text, visible, round(odd / greatest(visible, 1), 12) AS suspicious_rate, latin FROM (
      SELECT *, length(bare) AS visible, length(bare) - length(regexp_replace(bare, '{_ODD}', '', 'g')) AS odd, regexp_matches(text, '[A-Za-z]') AS latin FROM (
        SELECT doc_id, line_index, text, regexp_replace(text, '{_WS}', '', 'g') AS bare FROM lines)))"""


@query(f"WITH {_LINES}, {_SCORED} SELECT doc_id, line_index, suspicious_rate FROM scored")
def suspicious_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of suspicious characters in each line."""
    return lines_of(spark, sf_dir).select("doc_id", "line_index", F.round(tx.suspicious_rate(F.col("text")), 12).alias("suspicious_rate"))


def _line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line stands for a candidate that claims to be English; its visible length is the confidence."""
    out = lines_of(spark, sf_dir)
    visible = F.length(F.regexp_replace("text", tx.SPACE, ""))
    return out.select("doc_id", "line_index", F.col("text").alias("raw_text"), (F.least(visible, F.lit(100)) / 100).alias("confidence"), F.lit("en").alias("language"))


@query(
    f"""WITH {_LINES}, {_SCORED} SELECT doc_id, line_index, suspicious_rate,
      array_to_string(list_filter([CASE WHEN least(visible, 100) / 100 < 0.85 THEN 'low_primary_confidence' END, CASE WHEN visible = 0 THEN 'empty_text' END,
        CASE WHEN suspicious_rate > 0.1 THEN 'suspicious_characters' END, CASE WHEN NOT latin THEN 'language_script_mismatch' END], lambda x: x IS NOT NULL), ';') AS reasons,
      round(least(visible, 100) / 100 * (1 - suspicious_rate), 9) AS quality, visible > 0 AND suspicious_rate <= 0.1 AND latin AS usable FROM scored"""
)
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line scored as a candidate that claims to be English."""
    out = verify.score(_line_candidates(spark, sf_dir))
    return out.select("doc_id", "line_index", F.round("suspicious_rate", 12).alias("suspicious_rate"), F.array_join("score_reasons", ";").alias("reasons"), F.round("quality", 9).alias("quality"), "usable")


@query(
    f"""WITH {_LINES}, {_SCORED}, s AS (SELECT doc_id, least(visible, 100) / 100 AS confidence, visible = 0 OR suspicious_rate > 0.1 OR NOT latin OR least(visible, 100) / 100 < 0.85 AS review FROM scored)
    SELECT doc_id, CASE WHEN count(*) FILTER (review) > 0 THEN 'human_review_required' ELSE 'accepted' END AS quality_status, round(avg(confidence), 9) AS confidence_mean,
      min(confidence) AS confidence_min, count(*) FILTER (review) AS review_count, count(*) AS line_count FROM s GROUP BY doc_id"""
)
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to documents: every line scored, its status settled, and rolled up to the document's quality."""
    scored = verify.score(_line_candidates(spark, sf_dir))
    review = F.size(F.filter("score_reasons", lambda r: r != "tiny_text")) > 0
    items = scored.select("doc_id", F.lit("line").alias("kind"), F.lit("accepted").alias("status"), review.alias("needs_review"), "confidence", F.lit(None).cast("double").alias("disagreement"))
    rolled = rollup.document_quality(items, ["doc_id"])
    return rolled.select("doc_id", "quality_status", F.round("confidence_mean", 9).alias("confidence_mean"), "confidence_min", "review_count", "line_count")


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 4096), '(?i)<\s*(?:!doctype\s+html|html|body|head|title|meta|p|div|span|table|script|main|article)\b') THEN 'text/html'
      WHEN regexp_matches(html, '[\r\n]') AND trim(html) <> '' THEN 'text/plain' END AS content_type, CAST(octet_length(encode(html)) AS BIGINT) AS byte_size, sha256(html) AS sha256 FROM pages"""
)
def content_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, size and hash of every page's text."""
    t = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", detect.text_type(t).alias("content_type"), F.octet_length(t).cast("long").alias("byte_size"), F.sha2(t, 256).alias("sha256"))


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page by the standard parser."""
    return texts(spark, sf_dir, "pages").select("page_id", text_pages.visible_text(F.col("html")).alias("text"))


#: Accents folded to ASCII on both sides: DuckDB's levenshtein counts bytes.
_FOLD = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜàáâãäåçèéêëìíîïñòóôõöùúûüß¿¡", "AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuus??")


def _ascii(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_FOLD), r"[^\x00-\x7F]", "?")


_TURNS = f"""turns AS (SELECT conv_id, turn, regexp_replace(translate(text, '{_FOLD[0]}', '{_FOLD[1]}'), '[^\\x00-\\x7F]', '?', 'g') AS t FROM conversations),
  pairs AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn, t) AS p FROM turns)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns stand for prediction and reference: whole turns, in ASCII."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", _ascii(F.col("text")).alias("t"))
    return t.withColumn("p", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn", "t"))).where("p is not null")


@query(f"WITH {_TURNS} SELECT conv_id, turn, round(CASE WHEN length(p) = 0 THEN CASE WHEN length(t) = 0 THEN 0 ELSE 1 END ELSE levenshtein(t, p) / length(p) END, 9) AS cer, round(levenshtein(t, p) / greatest(length(t), length(p), 1), 9) AS normalized_difference FROM pairs WHERE p IS NOT NULL")
def cer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each turn against the one before."""
    t, p = F.col("t"), F.col("p")
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.cer(t, p), 9).alias("cer"), F.round(F.levenshtein(t, p) / F.greatest(F.length(t), F.length(p), F.lit(1)), 9).alias("normalized_difference"))


@query()
def wer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each turn against the one before."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.wer(F.col("t"), F.col("p")), 9).alias("wer"))


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, t, p, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)) AS a, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)) AS b FROM pairs WHERE p IS NOT NULL),
      f AS (SELECT *, regexp_replace(a, '[!-#%-*,-/:;?@\\[-\\]_{{}}]', '', 'g') = regexp_replace(b, '[!-#%-*,-/:;?@\\[-\\]_{{}}]', '', 'g') AS pe, regexp_replace(a, '{_WS}', '', 'g') = regexp_replace(b, '{_WS}', '', 'g') AS we,
        regexp_replace(a, '[0-9]', '', 'g') = regexp_replace(b, '[0-9]', '', 'g') AS de, regexp_replace(a, '[^0-9]', '', 'g') <> regexp_replace(b, '[^0-9]', '', 'g') AS dd FROM n)
    SELECT conv_id, turn, t = p AS exact, a = b AS normalized_equal, a <> b AND dd AND de AS digit_only, a <> b AND pe AND NOT we AS punctuation_only, a <> b AND we AND NOT pe AS whitespace_only, CAST(levenshtein(t, p) AS INTEGER) AS edit_distance FROM f"""
)
def text_compare_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of difference between consecutive turns (ASCII, so forms and digit scripts agree)."""
    d = tx.compare(F.col("t"), F.col("p"), nfc=False)
    return _pairs(spark, sf_dir).select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.exact", "d.normalized_equal", "d.digit_only", "d.punctuation_only", "d.whitespace_only", "d.edit_distance")


@query(
    """SELECT n_nationkey, sha256('{"name":"' || n_name || '","nation":' || n_nationkey || ',"region":"' || r_name || '"}') AS stable_hash,
      'nation-' || substr(sha256('{"name":"' || n_name || '","nation":' || n_nationkey || ',"region":"' || r_name || '"}'), 1, 16) AS id FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of each nation and its region, hashed, and an id from it."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    h = hashing.stable_hash({"region": (F.col("r_name"), "string"), "name": (F.col("n_name"), "string"), "nation": (F.col("n_nationkey"), "number")})
    return both.select("n_nationkey", h.alias("stable_hash"), hashing.deterministic_id("nation", h).alias("id"))


# --- verification -------------------------------------------------------------


@query(
    """WITH g AS (SELECT conv_id, role AS t, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2)
    SELECT conv_id, arg_max(t, {'n': n, 'f': -f, 't': t}) AS winner, max(n) AS votes, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY conv_id"""
)
def consensus_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation stands for a line, a turn for an attempt, its role for the normalized text."""
    return verify.winners(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query(
    """WITH f AS (SELECT conv_id, arg_min(text, {'a': turn, 'b': text}) AS first, count(*) AS n FROM conversations GROUP BY 1)
    SELECT c.conv_id, round(CASE WHEN max(n) > 1 THEN count(*) FILTER (text <> first) / (max(n) - 1) ELSE 0 END, 12)::DOUBLE AS disagreement_rate FROM conversations c JOIN f USING (conv_id) GROUP BY 1"""
)
def disagreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a conversation's later turns whose text differs from the first."""
    out = verify.disagreement(table(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn")
    return out.select("conv_id", F.round("disagreement_rate", 12).alias("disagreement_rate"))


@query(
    """WITH k AS (SELECT l_orderkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_orderkey, count(*) AS independent_evidence_count, max(n) AS stability_count, CAST(sum(n) AS BIGINT) AS attempts FROM k GROUP BY 1"""
)
def evidence_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands for a line, supplier and flag for the identity of the evidence."""
    return verify.independence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_suppkey", "l_returnflag"])


@query(
    """WITH c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_suppkey, l_discount) AS i, 'line ' || l_returnflag AS t, 1.0 - CAST(l_discount AS DOUBLE) AS conf, 'b' || (l_suppkey % 2) AS b FROM lineitem),
      g AS (SELECT k, t, count(*) AS n, min(i) AS first FROM c GROUP BY 1, 2), win AS (SELECT k, arg_max(t, {'n': n, 'f': -first}) AS t, max(n) AS n, count(*) AS texts FROM g GROUP BY 1),
      w AS (SELECT c.k, c.b, count(*) AS n FROM c JOIN win USING (k, t) GROUP BY 1, 2), e AS (SELECT k, count(*) AS independent, max(n) AS stable FROM w GROUP BY 1),
      s AS (SELECT c.k, count(DISTINCT c.b) AS backends, min(conf) >= 0.85 AS all_good, count(*) AS attempts, coalesce(bool_or(conf < 0.85) FILTER (c.t = win.t), false) AS low, any_value(win.n) >= 2 AS consensus, any_value(win.texts) > 1 AS split, any_value(win.t) AS wt FROM c JOIN win USING (k) GROUP BY 1),
      p AS (SELECT c.k, CASE WHEN s.backends = 1 THEN arg_max(c.i, {'c': conf, 'q': conf, 'e': -c.i}) ELSE min(c.i) END AS pos FROM c JOIN s USING (k) WHERE NOT s.consensus OR c.t = s.wt GROUP BY c.k, s.backends),
      sel AS (SELECT p.k, p.pos, c.conf, c.conf < 0.85 AS weak FROM p JOIN c ON c.k = p.k AND c.i = p.pos),
      d AS (SELECT s.*, e.independent, e.stable, sel.pos, sel.conf, sel.weak, s.backends > 1 AND NOT (s.consensus AND s.all_good) AS mismatch, (SELECT count(*) FROM w WHERE w.k = s.k) AS wb FROM s JOIN e USING (k) JOIN sel USING (k)),
      f AS (SELECT *, independent >= 2 AS ind, independent >= 2 AND wb = 1 AS recorded FROM d),
      h AS (SELECT *, NOT recorded AND NOT ind AS correlated, consensus AND NOT ind AND low AS lacking, low AND consensus AND ind AS overridden FROM f),
      u AS (SELECT *, mismatch OR split OR (low AND NOT overridden) OR lacking AS unresolved FROM h),
      r AS (SELECT *, CASE WHEN unresolved THEN 'human_review_required' WHEN consensus AND (conf >= 0.92 OR overridden) AND ind THEN 'verified' ELSE 'accepted' END AS status,
        list_filter([CASE WHEN weak THEN 'low_primary_confidence' END, CASE WHEN mismatch THEN 'confidence_scale_mismatch' END, CASE WHEN split THEN 'backend_disagreement' END, CASE WHEN split THEN 'normalized_disagreement' END,
          CASE WHEN consensus AND wb > 1 THEN 'consensus_across_backends' END, CASE WHEN consensus AND recorded THEN 'independent_backend_consensus' END, CASE WHEN consensus AND correlated THEN 'correlated_evidence_only' END,
          CASE WHEN consensus AND correlated THEN 'insufficient_independent_evidence' END, CASE WHEN NOT consensus THEN 'insufficient_evidence' END, CASE WHEN low AND NOT weak THEN 'low_primary_confidence' END,
          CASE WHEN unresolved AND split AND attempts >= (SELECT max(attempts) FROM d) THEN 'retry_exhausted' END], lambda x: x IS NOT NULL) AS reasons FROM u)
    SELECT k AS l_orderkey, status, 'candidate-' || pos AS selected_candidate_id, array_to_string(list_filter([CASE WHEN mismatch THEN 'confidence_scale_mismatch' END, CASE WHEN split THEN 'disagreement' END,
      CASE WHEN weak THEN 'low_confidence' END, CASE WHEN lacking THEN 'independent_evidence_insufficient' END], lambda x: x IS NOT NULL), ';') AS flags,
      CASE WHEN len(reasons) = 0 THEN status ELSE array_to_string(reasons, ';') END AS reason, CAST(stable AS INTEGER) AS stability_count, CAST(independent AS INTEGER) AS independent_evidence_count FROM r"""
)
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision: an order is a line, its items are attempts, the flag the text, the supplier the backend.

    All items take part: as many attempts are allowed as the largest order has items.
    """
    items = table(spark, sf_dir, "lineitem")
    most = items.groupBy("l_orderkey").count().agg(F.max("count")).head()[0] or 2
    c = items.select(
        "l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_suppkey", "l_discount").alias("attempt_idx"), F.concat(F.lit("line "), "l_returnflag").alias("raw_text"), F.concat(F.lit("line "), "l_returnflag").alias("normalized_text"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"), F.concat(F.lit("b"), F.col("l_suppkey") % 2).alias("backend"), F.lit("percent").alias("confidence_scale"), F.lit("en").alias("language"), F.lit("Latin").alias("script"),
    )
    out = verify.verify(c, ["l_orderkey"], policy=verify.Policy(max_attempts=max(2, most)), nfc=False)
    return out.select("l_orderkey", "status", "selected_candidate_id", F.array_join("flags", ";").alias("flags"), "reason", "stability_count", "independent_evidence_count")


_STATE = """state AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'uncertain' WHEN l.toxic = 1 THEN 'human_review_required' WHEN l.quality = 1 THEN 'verified' ELSE 'accepted' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for lines of their source; labels give the status, and unlabelled ones are uncertain."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "uncertain").when(F.col("toxic") == 1, "human_review_required").when(F.col("quality") == 1, "verified").otherwise("accepted")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left").select("doc_id", "source", "lang", "n_chars", status.alias("status"))


@query(f"WITH {_STATE}, r AS (SELECT source, lang, max(CASE status WHEN 'verified' THEN 1 WHEN 'accepted' THEN 2 WHEN 'uncertain' THEN 3 ELSE 4 END) AS k, count(*) AS n FROM state GROUP BY 1, 2) SELECT source, lang, CASE k WHEN 1 THEN 'verified' WHEN 2 THEN 'accepted' WHEN 3 THEN 'uncertain' ELSE 'human_review_required' END AS status, n FROM r")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest certainty by source and language."""
    return rollup.lowest_status(_state(spark, sf_dir), ["source", "lang"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    odd = F.when(F.col("n_chars") < 100, F.array(F.lit("low_confidence"))).otherwise(empty)
    return _state(spark, sf_dir).withColumns({"needs_review": F.lit(False), "flags": odd, "reason_codes": empty, "cell_row": F.lit(None).cast("int"), "page_number": (F.col("doc_id") % 10).cast("int")})


@query(
    f"""WITH {_STATE} SELECT doc_id, status, status IN ('accepted', 'verified') AND n_chars >= 100 AS accepted_verified, status = 'verified' AND n_chars >= 100 AS strict_verified_only, true AS all_with_status FROM state"""
)
def export_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents each export policy lets through; short ones carry a low-confidence flag."""
    items = _items(spark, sf_dir)
    args = [F.col(c) for c in ("status", "needs_review", "flags", "reason_codes")]
    return items.select("doc_id", "status", *(rollup.eligible(p, *args).alias(p) for p in ("accepted_verified", "strict_verified_only", "all_with_status")))


@query(
    f"""WITH {_STATE} SELECT source, count(DISTINCT doc_id % 10) AS pages, count(*) AS lines, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'uncertain') AS uncertain,
      count(*) FILTER (status = 'human_review_required') AS human_review_required, count(*) FILTER (status IN ('uncertain', 'human_review_required')) AS review_required, count(*) FILTER (status IN ('accepted', 'verified') AND n_chars >= 100) AS exported_lines FROM state GROUP BY 1"""
)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an export manifest for each source."""
    out = export.manifest_counts(_items(spark, sf_dir), ["source"], "accepted_verified")
    return out.select("source", "pages", "lines", "accepted", "verified", "uncertain", "human_review_required", "review_required", "exported_lines")


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS backend, s_name AS model, l_returnflag AS model_version FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def backend_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for backends, return flags for versions."""
    versions = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    both = versions.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return export.backend_inventory(both.select(F.col("l_suppkey").alias("backend"), F.col("s_name").alias("model"), F.col("l_returnflag").alias("model_version")), ["backend", "model", "model_version"])


# --- jobs, metrics, governance ----------------------------------------------


@query(
    """SELECT CASE WHEN event_type = 'purchase' THEN 'observe' ELSE 'increment' END AS kind, event_type AS name, CAST(user_id % 50 AS VARCHAR) AS labels,
      round(CASE WHEN event_type <> 'purchase' THEN sum(value) END, 6) AS value, CASE WHEN event_type = 'purchase' THEN count(*) END AS count, round(CASE WHEN event_type = 'purchase' THEN sum(value) END, 6) AS sum,
      CASE WHEN event_type = 'purchase' THEN min(value) END AS min, CASE WHEN event_type = 'purchase' THEN max(value) END AS max FROM events GROUP BY event_type, user_id % 50"""
)
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand for metrics (purchases are observed, the rest counted), user buckets for labels."""
    kind = F.when(F.col("event_type") == "purchase", "observe").otherwise("increment")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("name"), (F.col("user_id") % 50).cast("string").alias("labels"), "value")
    out = metrics.snapshot(e, max_series=None)
    return out.withColumns({"value": F.round("value", 6), "sum": F.round("sum", 6)})


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value, count(*) AS events FROM events GROUP BY 1")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for jobs, their events for writes: the last write wins."""
    return jobs.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


_REQUESTS = """r AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'key-' || (user_id % 40) END AS k, event_type || '|' || CAST(user_id % 80 AS VARCHAR) AS fp FROM events),
  o AS (SELECT k, arg_min(fp, event_id) AS owner FROM r WHERE k IS NOT NULL GROUP BY k), c AS (SELECT r.*, owner IS NOT NULL AND owner <> fp AS conflict FROM r LEFT JOIN o USING (k)),
  f AS (SELECT fp, min(event_id) AS first FROM c WHERE NOT conflict GROUP BY fp)"""


@query(f"WITH {_REQUESTS} SELECT event_id, fp AS fingerprint, CASE WHEN conflict THEN 'conflict' WHEN event_id = first THEN 'accepted' ELSE 'replay' END AS outcome FROM c LEFT JOIN f USING (fp)")
def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for submissions, with keys and fingerprints made from user and type."""
    key = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("key-"), F.col("user_id") % 40))
    r = table(spark, sf_dir, "events").select("event_id", key.alias("idempotency_key"), F.concat("event_type", F.lit("|"), F.col("user_id") % 80).alias("fingerprint"))
    return jobs.submissions(r, "event_id").select("event_id", "fingerprint", "outcome")


@query("SELECT o_orderkey, o_orderdate + to_days(CASE WHEN o_orderstatus = 'F' THEN 30 WHEN o_orderstatus = 'O' THEN 365 END) AS deadline, coalesce(o_orderdate + to_days(CASE WHEN o_orderstatus = 'F' THEN 30 WHEN o_orderstatus = 'O' THEN 365 END) <= TIMESTAMP '1996-06-30 00:00:00', false) AS expired FROM orders")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for documents, their status for the retention class: 30 days, 365 days, or no limit."""
    days = F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 365)
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", governance.deadline(F.col("o_orderdate"), days).alias("deadline"), governance.expired(F.col("o_orderdate"), days, F.lit("1996-06-30 00:00:00").cast("timestamp")).alias("expired"))


@query(
    """WITH c AS (SELECT o_custkey, arg_max(o_orderpriority, {'a': o_orderdate, 'b': o_orderkey}) AS p, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, c_name AS raw_text, p AS corrected_text, coalesce(n, 0) AS revision, CASE WHEN n IS NULL THEN 'uncertain' ELSE 'verified' END AS status, n IS NULL AS needs_review FROM customer LEFT JOIN c ON c_custkey = o_custkey"""
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for lines, orders for their corrections: the latest counts, the raw text stays."""
    flags = F.array(F.lit("low_confidence"))
    items = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("raw_text"), F.lit("uncertain").alias("status"), F.lit(True).alias("needs_review"), flags.alias("flags"), flags.alias("reason_codes"))
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("revision"), F.col("o_orderpriority").alias("corrected_text"), F.lit("r").alias("reviewer"), F.col("o_orderdate").alias("created_at"))
    out = governance.apply_corrections(items, made, ["c_custkey"])
    return out.select("c_custkey", "raw_text", "corrected_text", "revision", "status", "needs_review")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def deletion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for documents, open orders for running jobs."""
    running = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"))
    return governance.deletable(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), running, "c_custkey")


RULES = [fields.Rule("token", pattern=r'token = "([0-9a-f]+)"'), fields.Rule("number", pattern=r"([0-9]{4,})", required=True), fields.Rule("mail", pattern=r"([A-Za-z0-9.]+@[A-Za-z0-9.]+)")]


@query(
    f"""WITH {_LINES}, r AS (SELECT doc_id, line_index, unnest([{{'name': 'token', 'v': nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), ''), 'req': false}}, {{'name': 'number', 'v': nullif(regexp_extract(text, '([0-9]{{4,}})', 1), ''), 'req': true}},
      {{'name': 'mail', 'v': nullif(regexp_extract(text, '([A-Za-z0-9.]+@[A-Za-z0-9.]+)', 1), ''), 'req': false}}]) AS f FROM lines)
    SELECT doc_id, f.name AS name, arg_min(f.v, line_index) FILTER (f.v IS NOT NULL) AS raw_value, min(line_index) FILTER (f.v IS NOT NULL) AS evidence, bool_or(f.req) AND count(f.v) = 0 AS missing FROM r GROUP BY 1, 2"""
)
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over the lines of every document, first match in reading order."""
    items = lines_of(spark, sf_dir).select("doc_id", "page_number", "line_index", F.col("text").alias("raw_text"), F.col("line_index").alias("item_id"))
    return fields.extract(items, RULES, "doc_id", ["page_number", "line_index"]).select("doc_id", "name", "raw_value", "evidence", "missing")


# --- geometry and layout ------------------------------------------------------


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for intervals of a user's page: seconds of the day as x0, and a width from the value."""
    x0 = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", x0.alias("x0"), (x0 + F.floor(F.abs("value") % 50)).alias("x1"))


_INTERVALS = """iv AS (SELECT event_id, user_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER) AS DOUBLE) AS x0, CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER) AS DOUBLE) + floor(abs(value) % 50) AS x1 FROM events)"""


@query(
    f"""WITH {_INTERVALS}, o AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY user_id ORDER BY x0, x1, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 6912 THEN 1 ELSE 0 END AS opens FROM iv),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY x0, x1, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM o) SELECT user_id, CAST(grp AS INTEGER) AS column_group, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY 1, 2"""
)
def column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a user's intervals parted by gaps over 8 % of a day."""
    out = layout.column_groups(_intervals(spark, sf_dir), ["user_id"], "x0", "x1", F.lit(86400.0))
    return out.groupBy("user_id", "column_group").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_INTERVALS}, l AS (SELECT *, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY x0, x1, event_id)),
      o AS (SELECT *, CASE WHEN x0 - p1 > greatest(12.0, 2.5 * greatest(p1 - p0, x1 - x0)) THEN 1 ELSE 0 END AS opens FROM l)
      SELECT event_id, user_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY x0, x1, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS paragraph FROM o"""
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's intervals, read as line tops and bottoms, grouped into paragraphs."""
    return layout.paragraphs(_intervals(spark, sf_dir), ["user_id"], ["x0", "x1", "event_id"], "x0", "x1").select("event_id", "user_id", "paragraph")


@query(
    """WITH p AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS i, count(*) AS v FROM events GROUP BY 1, 2), a AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY event_type ORDER BY i) > 2 THEN 1 ELSE 0 END AS opens FROM p WHERE v >= 3),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_type, min(i) AS run_start, max(i) + 1 AS run_end FROM s GROUP BY event_type, run"""
)
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours stand for pixel rows, events in them for dark pixels: runs over gaps of one hour."""
    profile = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("i")).agg(F.count(F.lit(1)).alias("v"))
    return layout.active_runs(profile, ["event_type"], "i", "v", 3, 1)


def _box() -> Column:
    """Items of an order stand for boxes on a page."""
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    return g.box(x, y, x + F.col("l_quantity"), y + F.col("l_quantity") / 2 + 1)


def _boxes(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """The boxes of all items, by order and line number."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(f"{prefix}_id"), _box().alias(f"{prefix}_box" if prefix != "box" else "box"))


_BOXES = """b AS (SELECT l_orderkey, l_linenumber AS id, CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 89 AS DOUBLE) AS y0, CAST(l_partkey % 97 AS DOUBLE) + l_quantity AS x1, CAST(l_suppkey % 89 AS DOUBLE) + l_quantity / 2 + 1 AS y1 FROM lineitem)"""
_SHARED = "greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0))"


@query(
    f"""WITH {_BOXES}, p AS (SELECT a.l_orderkey, a.id AS left_id, c.id AS right_id, {_SHARED} AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS t FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey WHERE a.id < c.id)
    SELECT l_orderkey, left_id, right_id, round(s / (t - s), 9) AS iou FROM p WHERE s / (t - s) >= 0.1"""
)
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of an order."""
    pairs = matching.iou_pairs(_boxes(spark, sf_dir, "left"), _boxes(spark, sf_dir, "right"), ["l_orderkey"], 0.1)
    return pairs.where("left_id < right_id").withColumn("iou", F.round("iou", 9))


@query(
    f"""WITH {_BOXES}, p AS (SELECT a.l_orderkey, a.id, c.id AS rid, {_SHARED} AS s FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.id % 2 = 0 AND c.id % 2 = 1),
      m AS (SELECT l_orderkey, id, arg_max(rid, {{'s': s, 'r': -rid}}) FILTER (s > 0) AS region_id FROM p GROUP BY 1, 2)
    SELECT b.l_orderkey, b.id AS box_id, region_id FROM b LEFT JOIN m ON b.l_orderkey = m.l_orderkey AND b.id = m.id WHERE b.id % 2 = 0"""
)
def best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even items stand for lines, odd ones for regions of the same page."""
    boxes = _boxes(spark, sf_dir, "box").where("box_id % 2 = 0")
    regions = _boxes(spark, sf_dir, "region").where("region_id % 2 = 1").select("l_orderkey", "region_id", F.col("region_id").alias("region_idx"), F.col("region_box").alias("region"))
    return matching.best_region(boxes, regions, ["l_orderkey"])


@query(
    f"""WITH {_BOXES}, k AS (SELECT *, CASE id WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS band FROM b), o AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY l_orderkey, band ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 12 THEN 1 ELSE 0 END AS opens FROM k),
      s AS (SELECT *, CASE WHEN band = 1 THEN sum(opens) OVER (PARTITION BY l_orderkey, band ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) ELSE 0 END AS col FROM o)
    SELECT l_orderkey, id AS region_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY band, col, y0, x0, id) - 1 AS INTEGER) AS reading_order FROM s"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stand for regions: the first a title, the second a sidebar, the third a footer, the rest body."""
    kind = F.when(F.col("region_id") == 1, "title").when(F.col("region_id") == 2, "sidebar").when(F.col("region_id") == 3, "footer").otherwise("paragraph")
    r = _boxes(spark, sf_dir, "region").select("l_orderkey", "region_id", "region_box.*", kind.alias("block_type"), F.lit(150.0).alias("page_width"), F.lit("ltr").alias("direction"))
    return layout.reading_order(r, ["l_orderkey"], "region_id").select("l_orderkey", "region_id", "reading_order")


@query()
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order as lines in rows with a running centre."""
    r = _boxes(spark, sf_dir, "line").select("l_orderkey", "line_id", "line_box.*", F.lit("ltr").alias("direction"))
    return layout.reading_rows(r, "l_orderkey").select("l_orderkey", "line_id", "row_order")


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd items as predicted lines for the even ones of an order."""
    b = _boxes(spark, sf_dir, "line").select(F.col("l_orderkey").alias("page"), F.col("line_id").cast("string").alias("id"), F.col("line_id").alias("idx"), F.col("line_id").alias("reading_order"), "line_box.*")
    return matching.match_lines(b.where("idx % 2 = 0"), b.where("idx % 2 = 1"), "page", 0.1)


@query()
def table_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as cells of a table: row and column from part and supplier."""
    polygon = F.lit(None).cast("array<struct<x:double,y:double>>")
    items = table(spark, sf_dir, "lineitem")
    cells = items.select(F.col("l_orderkey").alias("region_id"), F.lit(140.0).alias("region_width"), F.lit(110.0).alias("region_height"), F.col("l_linenumber").alias("cell_idx"), (F.col("l_partkey") % 3).alias("row"), (F.col("l_suppkey") % 3).alias("column"), F.col("l_linestatus").alias("text"), F.lit(None).cast("string").alias("raw_text"), _box().alias("bbox"), polygon.alias("polygon"), F.lit(0.9).alias("confidence"))
    out = tables.validate(cells)
    return out.select("region_id", "n_cells", "n_filled", F.array_join("warnings", ";").alias("warnings"), F.array_join("flags", ";").alias("flags"), "usable")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'table' WHEN p_size % 7 = 1 THEN 'handwriting' WHEN p_size % 7 = 2 OR p_size % 5 = 0 THEN 'printed,handwriting' WHEN p_size % 5 = 1 THEN 'handwriting' ELSE 'printed' END AS routes FROM part"""
)
def region_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for regions, with block and text types from their size."""
    size = F.col("p_size")
    block = F.when(size % 7 == 0, "table").when(size % 7 == 1, "handwriting").when(size % 7 == 2, "form").otherwise("paragraph")
    text = F.when(size % 5 == 0, "mixed").when(size % 5 == 1, "handwritten").otherwise("printed")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(routing.region_routes(block, text, F.lit(None).cast("string")), ",").alias("routes"))


# --- evaluation ---------------------------------------------------------------

_METRICS = f"""{_STATE}, m AS (SELECT coalesce(lang, 'overall') AS category, count(*) AS document_count, count(*) FILTER (status = 'accepted') / count(*) AS accepted_automatically_rate,
      count(*) FILTER (status = 'human_review_required') / count(*) AS human_review_rate, avg(n_chars) AS mean_chars FROM state GROUP BY GROUPING SETS ((lang), ()))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for categories; rates of the statuses."""
    n = F.count(F.lit(1))
    rate = lambda s: evaluate.ratio(F.count_if(F.col("status") == s), n)
    state = _state(spark, sf_dir).withColumnRenamed("lang", "category")
    return evaluate.by_category(state, "category", n.alias("document_count"), rate("accepted").alias("accepted_automatically_rate"), rate("human_review_required").alias("human_review_rate"), F.avg("n_chars").alias("mean_chars"))


@query(f"WITH {_METRICS} SELECT category, document_count, round(accepted_automatically_rate, 9) AS accepted_automatically_rate, round(human_review_rate, 9) AS human_review_rate, round(mean_chars, 6) AS mean_chars FROM m")
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by category and overall, in one pass with grouping sets."""
    out = _metrics(spark, sf_dir)
    return out.select("category", "document_count", F.round("accepted_automatically_rate", 9).alias("accepted_automatically_rate"), F.round("human_review_rate", 9).alias("human_review_rate"), F.round("mean_chars", 6).alias("mean_chars"))


GATES = [("few_reviews", "human_review_rate", "overall", None, 0.05), ("some_accepted", "accepted_automatically_rate", "en", 0.01, None), ("unknown_category", "human_review_rate", "xx", None, 1.0)]


@query(
    f"""WITH {_METRICS}, u AS (SELECT category, 'human_review_rate' AS metric, human_review_rate AS v FROM m UNION ALL SELECT category, 'accepted_automatically_rate', accepted_automatically_rate FROM m),
      r AS (SELECT * FROM (VALUES ('few_reviews', 'human_review_rate', 'overall', NULL, 0.05), ('some_accepted', 'accepted_automatically_rate', 'en', 0.01, NULL), ('unknown_category', 'human_review_rate', 'xx', NULL, 1.0)) AS t(name, metric, category, lo, hi))
    SELECT r.name, r.category, r.metric, round(v, 9) AS actual, coalesce(v >= coalesce(lo, v) AND v <= coalesce(hi, v), false) AS passed FROM r LEFT JOIN u ON u.category = r.category AND u.metric = r.metric"""
)
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gates on those rates; a category that is missing fails."""
    rules = spark.createDataFrame(GATES, "name string, metric string, category string, minimum double, maximum double")
    long = evaluate.long_metrics(_metrics(spark, sf_dir), ["accepted_automatically_rate", "human_review_rate"])
    return evaluate.gates(long, rules).select("name", "category", "metric", F.round("actual", 9).alias("actual"), "passed")


@query(
    f"""WITH {_METRICS}, u AS (SELECT category, 'human_review_rate' AS metric, human_review_rate AS v FROM m UNION ALL SELECT category, 'accepted_automatically_rate', accepted_automatically_rate FROM m)
    SELECT a.category, a.metric, round(a.v, 9) AS current, round(b.v, 9) AS baseline, round(a.v - b.v, 9) AS delta, CASE a.metric WHEN 'human_review_rate' THEN 'neutral' ELSE 'higher' END AS direction,
      a.metric <> 'human_review_rate' AND round(a.v - b.v, 9) < -0.01 AS regression FROM u a JOIN u b ON a.metric = b.metric AND b.category = 'overall'"""
)
def metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category against the whole, with the direction of each metric."""
    long = evaluate.long_metrics(_metrics(spark, sf_dir), ["accepted_automatically_rate", "human_review_rate"])
    base = long.where("category = 'overall'").select(F.col("metric"), F.col("value").alias("_v"))
    baseline = long.join(base, "metric").select("category", "metric", F.col("_v").alias("value"))
    out = evaluate.compare(long, baseline, 0.01)
    rounded = {c: F.round(c, 9) for c in ("current", "baseline", "delta")}
    return out.withColumns(rounded)


# --- more operators on stand-in rows --------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'not_positive' WHEN least(x1, 100) <= x0 OR least(y1, 80) <= y0 THEN 'not_visible' END AS problem,
      CASE WHEN least(x1, 100) > x0 AND least(y1, 80) > y0 THEN x0 END AS x0, CASE WHEN least(x1, 100) > x0 AND least(y1, 80) > y0 THEN y0 END AS y0,
      CASE WHEN least(x1, 100) > x0 AND least(y1, 80) > y0 THEN least(x1, 100) END AS x1, CASE WHEN least(x1, 100) > x0 AND least(y1, 80) > y0 THEN least(y1, 80) END AS y1
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 97 * 2 AS DOUBLE) AS x0, CAST(l_suppkey % 89 AS DOUBLE) AS y0, CAST(l_partkey % 97 * 2 AS DOUBLE) + l_quantity AS x1, CAST(l_suppkey % 89 AS DOUBLE) + l_quantity / 2 + 1 AS y1 FROM lineitem)"""
)
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of items clipped to a page of 100 by 80, or why nothing of them is left."""
    x, y = (F.col("l_partkey") % 97 * 2).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    b = g.box(x, y, x + F.col("l_quantity"), y + F.col("l_quantity") / 2 + 1)
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.clip(b, F.lit(100.0), F.lit(80.0)).alias("c"))
    return c.select("l_orderkey", "l_linenumber", "c.problem", "c.box.x0", "c.box.y0", "c.box.x1", "c.box.y1")


@query(
    """SELECT p_partkey, greatest(0, least(511, CAST(floor(p_retailprice / 7) AS INTEGER))) AS x0, greatest(greatest(0, least(511, CAST(floor(p_retailprice / 7) AS INTEGER))) + 1, least(512, CAST(floor(p_retailprice / 7 + p_size / 3 + 0.999) AS INTEGER))) AS x1,
      CAST(greatest(1, round_even(p_size * 10 * 300 / 72, 0)) AS BIGINT) AS render_width, CASE WHEN greatest(1, round_even(p_size * 10 * 300 / 72, 0)) * greatest(1, round_even(p_size * 14 * 300 / 72, 0)) > 2000000 THEN 'too_many_pixels' END AS problem FROM part"""
)
def crops_and_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as regions to crop and pages to render."""
    left, size = F.col("p_retailprice") / 7, F.col("p_size")
    b = g.box(left, F.lit(0.0), left + size / 3, F.lit(9.0))
    crop = imaging.crop_box(b, F.lit(512), F.lit(16))
    render = imaging.render_dimensions(size * 10, size * 14, F.lit(300), 2_000_000)
    out = table(spark, sf_dir, "part").select("p_partkey", crop.alias("c"), render.alias("r"))
    return out.select("p_partkey", "c.x0", "c.x1", F.col("r.width").alias("render_width"), "r.problem")


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'low_contrast' END, CASE WHEN p_size % 6 < 3 THEN 'low_sharpness' END, CASE WHEN abs(p_size % 5 - 2) >= 1 THEN 'skew_detected' END, CASE WHEN p_size % 10 / 10 >= 0.2 THEN 'perspective_suspected' END,
      CASE WHEN p_size % 4 = 1 THEN 'tiny_text_suspected' END], lambda x: x IS NOT NULL), ';') AS flags FROM part"""
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for pages, their size for what was measured."""
    s = F.col("p_size")
    measured = {"contrast": s.cast("double"), "sharpness": (s % 6).cast("double"), "skew": (s % 5 - 2).cast("double"), "perspective": (s % 10) / 10, "background_variation": F.lit(None).cast("double"), "text_scale": F.when(s % 4 == 1, 8.0).otherwise(20.0), "compression": F.lit(None).cast("double")}
    return table(spark, sf_dir, "part").withColumns(measured).select("p_partkey", F.array_join(imaging.quality_flags(), ";").alias("flags"))


@query(
    """WITH l AS (SELECT p_partkey, list_extract(['Title', 'body text', 'Key/Value', 'figure', 'stamp', 'handwritten', 'TABLE'], CAST(p_size % 7 + 1 AS BIGINT)) AS label, p_size / 50 AS c FROM part)
    SELECT p_partkey, CASE label WHEN 'Title' THEN 'title' WHEN 'body text' THEN 'paragraph' WHEN 'Key/Value' THEN 'form' WHEN 'figure' THEN 'figure' WHEN 'handwritten' THEN 'handwriting' WHEN 'TABLE' THEN 'table' ELSE 'unknown' END AS block_type,
      CASE label WHEN 'Title' THEN 'printed_text' WHEN 'body text' THEN 'printed_text' WHEN 'Key/Value' THEN 'form' WHEN 'figure' THEN 'image' WHEN 'handwritten' THEN 'handwriting' WHEN 'TABLE' THEN 'table' ELSE 'unknown' END AS route_hint, label = 'stamp' OR c < 0.5 AS needs_review FROM l"""
)
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for regions with a provider's label and confidence."""
    names = F.array(*(F.lit(n) for n in ("Title", "body text", "Key/Value", "figure", "stamp", "handwritten", "TABLE")))
    regions = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_size") % 7 + 1).cast("int")).alias("label"), (F.col("p_size") / 50).alias("confidence"))
    return routing.classify_labels(regions).select("p_partkey", "block_type", "route_hint", "needs_review")


@query(
    rf"""WITH {_LINES}, s AS (SELECT doc_id, text, regexp_replace(text, '{_WS}', '', 'g') AS bare FROM lines), c AS (SELECT doc_id, length(bare) AS n, length(bare) - length(regexp_replace(bare, '{_ODD}', '', 'g')) AS odd, length(text) - length(regexp_replace(text, '[\p{{L}}\p{{N}}]', '', 'g')) AS good FROM s),
      d AS (SELECT doc_id, sum(n) AS n, sum(odd) AS odd, sum(good) AS good, count(*) AS k FROM c GROUP BY 1)
    SELECT doc_id, CAST(n AS BIGINT) AS characters, CASE WHEN n = 0 THEN 'no_native_text' WHEN n < 5 THEN 'native_text_too_sparse' WHEN odd / n > 0.2 THEN 'native_text_suspicious' WHEN good / n < 0.5 THEN 'native_text_implausible' ELSE 'reliable_native_text' END AS reason FROM d"""
)
def native_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's text could stand as native text of one page."""
    lines = lines_of(spark, sf_dir).select("doc_id", "text", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), text_pages.line_box(F.col("line_index")).alias("box"))
    return routing.native_evidence(lines, ["doc_id"]).select("doc_id", F.col("characters").cast("long").alias("characters"), "reason")


@query(
    f"""WITH {_LINES} SELECT doc_id AS document_id, string_agg(text, chr(10) ORDER BY line_index) FILTER (line_index % 7 <> 3) || chr(10) AS text FROM lines GROUP BY doc_id HAVING count(*) FILTER (line_index % 7 <> 3) > 0"""
)
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents exported as text; every seventh is uncertain and left out."""
    none, word = F.lit(None).cast("string"), F.array().cast("array<string>")
    items = lines_of(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("block_order"), F.col("line_index").alias("position"), F.lit(None).cast("int").alias("cell_row"), F.lit(None).cast("int").alias("cell_column"),
        F.col("text").alias("raw_text"), none.alias("corrected_text"), F.when(F.col("line_index") % 7 == 3, "uncertain").otherwise("verified").alias("status"), F.lit(False).alias("needs_review"), word.alias("flags"), word.alias("reason_codes"),
    )
    return export.document_text(export.pages_text(items, items))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber % 3 AS r, l_linenumber % 2 AS c, l_returnflag AS t FROM lineitem), p AS (SELECT l_orderkey, r, c, arg_max(l, idx) AS l FROM (SELECT l_orderkey, l_linenumber % 3 AS r, l_linenumber % 2 AS c, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS l, l_extendedprice AS idx FROM lineitem) GROUP BY 1, 2, 3)
    SELECT l_orderkey, count(*) AS reference_cells, count(*) FILTER (t = l) AS matches FROM r LEFT JOIN p USING (l_orderkey, r, c) GROUP BY 1"""
)
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as cells of an order's table: the flag is the truth, the status the prediction."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("row"), (F.col("l_linenumber") % 2).alias("column"), F.col("l_extendedprice").alias("idx"), F.lit(None).cast("string").alias("normalized_text"), "l_returnflag", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("p"))
    return matching.cell_accuracy(c.withColumn("raw_text", F.col("l_returnflag")), c.withColumn("raw_text", F.col("p")), ["l_orderkey"])


@query("SELECT d.doc_id, 'left' AS side FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT DISTINCT l.doc_id, 'right' FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels stand for reference and prediction: ids that only one side has."""
    return matching.same_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT item_id, length(text) AS n, upper(substr(text, 1, 1)) = substr(text, 1, 1) AS capital, CASE WHEN length(text) > 0 THEN CAST(strpos(text, ' ') > 0 AS BOOLEAN) END AS several,
      '[accepted;review] ' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), ' ') AS entry FROM benchmark"""
)
def markdown_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference texts escaped for Markdown, with a status label."""
    t = F.col("text")
    entry = F.concat(F.lit("["), export.status_label(F.lit("accepted"), F.lit(True)), F.lit("] "), export.escape_markdown(t))
    return table(spark, sf_dir, "benchmark").select("item_id", F.length(t).cast("long").alias("n"), (F.upper(F.substring(t, 1, 1)) == F.substring(t, 1, 1)).alias("capital"), F.when(F.length(t) > 0, F.instr(t, " ") > 0).alias("several"), entry.alias("entry"))


@query("SELECT event_id, least(99.0, greatest(1.0, 5 + (user_id % 30) / greatest(event_id % 20, 1) * 90))::DOUBLE AS percent FROM events")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of a job with the user's pages done of the event's."""
    return table(spark, sf_dir, "events").select("event_id", F.round(jobs.progress(F.col("user_id") % 30, F.col("event_id") % 20), 9).alias("percent"))


SQL["job_progress"] = SQL["job_progress"].replace("least(99.0", "round(least(99.0").replace("* 90))::DOUBLE", "* 90)), 9)::DOUBLE")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, [1.0 + l_discount, 0, l_quantity, 0, 2, l_tax, 0, 0, 1] AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(m[1] * 10 + m[2] * 20 + m[3], 9)::DOUBLE AS x, round(m[4] * 10 + m[5] * 20 + m[6], 9)::DOUBLE AS y FROM m"""
)
def mapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point taken through a mapping made of each item's numbers, composed with the identity."""
    d = lambda c: c.cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(d(1 + F.col("l_discount")), zero, d(F.col("l_quantity")), zero, F.lit(2.0), d(F.col("l_tax")), zero, zero, one)
    identity = F.array(one, zero, zero, zero, one, zero, zero, zero, one)
    p = g.apply_mapping(g.multiply(m, identity), F.lit(10.0), F.lit(20.0))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return out.select("l_orderkey", "l_linenumber", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query()
def words_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as words of an order's page, joined to lines with a moving centre."""
    w = _boxes(spark, sf_dir, "word").select("l_orderkey", F.col("word_id").cast("string").alias("text"), F.lit(0.5).alias("confidence"), "word_box.*")
    return layout.words_in_rows(w, "l_orderkey")


# --- single operators on stand-in rows --------------------------------------


@query(
    f"""WITH {_BOXES}, p AS (SELECT a.l_orderkey, a.id AS left_id, c.id AS right_id, {_SHARED} AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS t, (c.x1 - c.x0) * (c.y1 - c.y0) AS u, a.x0 >= c.x0 AND a.y0 >= c.y0 AND a.x1 <= c.x1 AND a.y1 <= c.y1 AS inside
      FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey WHERE a.id < c.id)
    SELECT l_orderkey, left_id, right_id, round(s / least(t, u), 9) AS overlap, inside FROM p WHERE s > 0"""
)
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order that meet: the overlap of the smaller, and whether the first lies in the second."""
    left, right = _boxes(spark, sf_dir, "left"), _boxes(spark, sf_dir, "right")
    both = left.join(right, "l_orderkey").where("left_id < right_id")
    share, inside = g.overlap_of_smaller(F.col("left_box"), F.col("right_box")), g.inside(F.col("left_box"), F.col("right_box"))
    return both.where(share > 0).select("l_orderkey", "left_id", "right_id", F.round(share, 9).alias("overlap"), inside.alias("inside"))


@query(f"WITH {_BOXES} SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_and(x1 <= 120 AND y1 <= 100) AS all_within FROM b GROUP BY 1")
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest box around an order's boxes, and whether all lie on the page."""
    b = _boxes(spark, sf_dir, "box")
    out = b.groupBy("l_orderkey").agg(g.union_of(F.col("box")).alias("u"), F.bool_and(g.within(F.col("box"), F.lit(120.0), F.lit(100.0))).alias("all_within"))
    return out.select("l_orderkey", "u.*", "all_within")


@query(f"WITH {_BOXES} SELECT l_orderkey, id AS box_id, CAST(greatest(0, floor(x0)) AS INTEGER) AS x0, CAST(greatest(0, floor(y0)) AS INTEGER) AS y0, CAST(least(110, ceil(x1)) AS INTEGER) AS x1, CAST(least(90, ceil(y1)) AS INTEGER) AS y1 FROM b")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pixels around every box, inside a picture of 110 by 90."""
    return _boxes(spark, sf_dir, "box").select("l_orderkey", "box_id", g.pixel_box(F.col("box"), F.lit(110), F.lit(90)).alias("p")).select("l_orderkey", "box_id", "p.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v BETWEEN 0 AND 1 THEN round(v, 9) END AS printed, round(least(1.0, greatest(0.0, CASE WHEN q > 1 THEN q / 100 ELSE q END)), 9) AS cell FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * 15 - 0.1 AS v, CAST(l_quantity AS DOUBLE) * 3 - 5 AS q FROM lineitem)")
def provider_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and quantities stand for what providers print as confidences of texts and of cells."""
    v, q = F.col("l_discount").cast("double") * 15 - 0.1, F.col("l_quantity").cast("double") * 3 - 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(tables.provider_confidence(v), 9).alias("printed"), F.round(tables.table_confidence(q), 9).alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_size * 20 >= 600 THEN CASE WHEN p_partkey % 3 > 1 THEN 'crop_upscaled' ELSE 'high_dpi' END ELSE 'first_pass' END AS stage FROM part")
def tiny_text_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for attempts, their size for the resolution and their key for the scale."""
    return table(spark, sf_dir, "part").select("p_partkey", imaging.stage_of(F.col("p_size") * 20, F.col("p_partkey") % 3).alias("stage"))


@query(r"SELECT doc_id, CASE WHEN r AND l THEN 'mixed' WHEN r THEN 'rtl' ELSE 'ltr' END AS direction FROM (SELECT doc_id, regexp_matches(coalesce(text, ''), '[\x{590}-\x{8FF}]') AS r, regexp_matches(coalesce(text, ''), '[A-Za-z]') AS l FROM documents)")
def reading_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of every document by its letters."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = tx.direction(tx.count_matching(t, tx.RIGHT_TO_LEFT), tx.count_matching(t, tx.LATIN_LETTERS))
    return texts(spark, sf_dir, "documents").select("doc_id", found.alias("direction"))


@query("SELECT l_orderkey, bool_and(coalesce(1 - l_discount >= 0.93, false)) AS confident FROM lineitem GROUP BY 1")
def confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for results, their items for lines: confident where all lines are."""
    return routing.confident(table(spark, sf_dir, "lineitem").select("l_orderkey", (1 - F.col("l_discount")).alias("confidence")), ["l_orderkey"], 0.93)


@query(
    """WITH e AS (SELECT user_id, ts, event_id, ['queued', 'running', 'completed', 'failed'][1 + event_id % 4] AS state FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e)
    SELECT event_id, previous, state, coalesce((previous IS NULL AND state = 'queued') OR previous = state OR (previous NOT IN ('completed', 'failed') AND (state = 'failed' OR (previous = 'queued' AND state = 'running') OR (previous = 'running' AND state = 'completed'))), false) AS valid FROM p"""
)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for jobs, their events for writes of states: which may follow the one before."""
    state = F.element_at(F.array(*(F.lit(s) for s in ("queued", "running", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state"))
    return jobs.transitions(e, "user_id", ["ts", "event_id"]).select("event_id", "previous", "state", "valid")


@query(
    f"""WITH {_BOXES}, w AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) * 2 - 4 AS c FROM lineitem),
      t AS (SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text, round(avg(c) FILTER (c >= 0) / 100, 9) AS confidence, count(*) AS n_words FROM w GROUP BY 1),
      u AS (SELECT l_orderkey, min(x0) AS x0, max(y1) AS y1 FROM b GROUP BY 1)
    SELECT t.l_orderkey, text, confidence, n_words, x0, y1 FROM t JOIN u USING (l_orderkey)"""
)
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stand for a recogniser's words, an order for one of its lines."""
    words = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("word"), F.col("l_returnflag").alias("text"), (F.col("l_quantity").cast("double") * 2 - 4).alias("confidence"),
        (F.col("l_partkey") % 97).cast("double").alias("x0"), (F.col("l_suppkey") % 89).cast("double").alias("y0"), ((F.col("l_partkey") % 97).cast("double") + F.col("l_quantity")).alias("x1"), ((F.col("l_suppkey") % 89).cast("double") + F.col("l_quantity") / 2 + 1).alias("y1"),
    )
    out = tables.words_to_lines(words, ["l_orderkey"])
    return out.select("l_orderkey", "text", F.round("confidence", 9).alias("confidence"), "n_words", "bbox.x0", "bbox.y1")


@query(
    """WITH d AS (SELECT page_id, octet_length(encode(html)) AS n, 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '/x' ELSE '' END || '.html' AS name, CASE WHEN page_id % 5 = 0 THEN 'text/plain' ELSE 'text/html' END AS declared,
        CASE WHEN regexp_matches(substr(html, 1, 4096), '(?i)<\\s*(?:!doctype\\s+html|html|body|head|title|meta|p|div|span|table|script|main|article)\\b') THEN 'text/html' WHEN regexp_matches(html, '[\\r\\n]') AND trim(html) <> '' THEN 'text/plain' END AS kind FROM pages)
    SELECT page_id, CASE WHEN n = 0 THEN 'source_is_empty' WHEN n > 4000 THEN 'too_large' WHEN contains(name, '/') THEN 'unsafe_name' WHEN kind IS NULL OR kind <> declared THEN 'unsupported_type' END AS rejection FROM d"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for uploads of at most 4,000 bytes; some names hold a path, some types are declared wrongly."""
    name = F.concat(F.lit("page-"), F.col("page_id"), F.when(F.col("page_id") % 7 == 0, "/x").otherwise(""), F.lit(".html"))
    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("byte_size"), detect.text_type(F.col("html")).alias("content_type"), name.alias("name"), F.when(F.col("page_id") % 5 == 0, "text/plain").otherwise("text/html").alias("declared"))
    return detect.accepted(p, 4000, detect.TEXT_TYPES, "name", "declared").select("page_id", "rejection")


@query(
    f"""WITH {_STATE} SELECT doc_id, n_chars < 100 OR status IN ('uncertain', 'human_review_required') AS needs_review, CASE WHEN n_chars < 100 AND status IN ('accepted', 'verified') THEN 'human_review_required' ELSE status END AS status FROM state"""
)
def settled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for lines: what requires review says so in its status."""
    return rollup.settle(_items(spark, sf_dir), tiny=None).select("doc_id", "needs_review", "status")


@query(
    f"""WITH {_LINES}, {_SCORED}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (suspicious_rate > 0.1) AS r FROM scored WHERE visible > 0 GROUP BY 1)
    SELECT d.doc_id AS document_id, CASE WHEN coalesce(r, 0) > 0 THEN 'human_review_required' ELSE 'accepted' END AS quality_status, coalesce(n, 0) AS line_count, coalesce(r, 0) AS review_count FROM documents d LEFT JOIN s USING (doc_id)"""
)
def document_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of every document: lines, candidates, verification, settled states, quality."""
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    lines = text_pages.native_lines(text_pages.lines(docs, "document_id", "text")).select("document_id", "page_number", "line_index", "text")
    pages = text_pages.pages(docs, "document_id", "text").select("document_id", "page_number")
    # Only the documents are wanted, so nothing is held, and what they do not need is not computed.
    out = document.process(document.native_candidates(lines), pages, hold=lambda items: items)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.documents.select("document_id", "quality_status", zero("line_count"), zero("review_count"))

"""The thin ``opN_<name>`` queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, html_extract, langid, mixing, reshard, simhash, toxicity, warc, webp
from .common import Scratch, crc32_of_id

BPE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), 0, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors of equal label at cosine 0.93 or more, and their components."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text with the byte-level vocabulary."""
    return bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary(BPE_VOCABULARY), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language with a model fitted on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, vocabulary(PIECE_VOCABULARY))
    out = langid.identify(docs.select("doc_id", "text"), model, pred_col="lang_pred", score_col="score")
    return out.select("doc_id", (crc32_of_id("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, tau=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as lossless WebP pictures and reads them back."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return webp.media(table(spark, sf_dir, "documents"), outputs=names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document with a machine fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), machine, score_col="score")
    return out.select("doc_id", (crc32_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rakes token weights to the default marginals and samples documents by them."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grows 32 shards by id hash to 40 of equal row counts, moving the fewest bytes; moved rows are those read back."""
    docs = table(spark, sf_dir, "documents")
    size, crc = reshard.size_of(F.col("text")), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", size.alias("size"), crc.alias("text_crc32"), reshard.old_shard("doc_id").alias("old_shard"))
    stay, written = reshard.rewrite(rows, Scratch(spark, "shards").path("rewritten"))
    out = stay.unionByName(written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "old_shard", "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_warc, op2_embedding_dedup, op3_bpe, op4_language_id, op5_simhash, op6_html_extraction, op7_media, op8_toxicity, op9_mixing, op10_resharding, pipeline)
    return {f.__name__: f for f in named}


_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) AS INTEGER) * (1 << (4 - k)::INTEGER))) AS INTEGER), 1)), '')"
_NIBBLES = ", ".join(f"'{x:04b}'" for x in range(16))

#: DuckDB SQL of the operators that it can express, by brute force where need be.
_ORACLES: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, h,
          array_to_string(list_transform(string_split(sha1(h), ''), lambda c: list_extract([{_NIBBLES}], strpos('0123456789abcdef', c))), '') AS bits FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
      SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op2_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT a AS node, a AS reach FROM (SELECT DISTINCT a FROM l) UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
        c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
      SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.node""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

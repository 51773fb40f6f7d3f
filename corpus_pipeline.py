"""Corpus pipeline: toxicity, language, near-duplicates, mix, tokens.

Each stage takes what the stage before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, langid, mixing, simhash, toxicity
from folioscope.llm.common import Scratch, scratch_scope
from folioscope.llm.queries import BPE_VOCABULARY, PIECE_VOCABULARY, vocabulary

#: A document whose language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the factorization machine, fitted on the labels, scores as toxic."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, machine, score_col="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without an identifiable language, and corrects ``lang`` nowhere."""
    model = langid.train(docs, vocabulary(PIECE_VOCABULARY))
    found = langid.identify(docs, model, pred_col="_lang_pred", score_col="_lang_score")
    return found.where((F.col("_lang_pred") != langid.UND) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents that are linked by five-word shingles at Jaccard 0.8 or more.

    It is the row with the smallest id.  Other rows of that id stay if they are
    the first of groups of their own; of wholly equal rows one stays; rows
    without id come after all others.
    """
    return simhash.keep_one(docs, shingle=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to the source, language and topic targets.

    Rows of one id are taken or left together; a null source or language is a
    value of its own; texts without tokens are taken like others of their cell.
    """
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of both, and whether the text came back."""
    return bpe.tokenize(docs, vocabulary(BPE_VOCABULARY), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each reading what the one before wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over documents: five stages, each of which is one operator of gridloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
one's docs.  All but the last return the columns of documents; a stage works on all that its predecessor kept.

toxicity       documents that the classifier rejects go; it learns from the labels of documents that are there
line_dedup     lines that repeat an earlier one, exactly or (from 24 bytes on) within two edits, go, blank lines stay; a document that
               has lost all its text goes, blank lines or none being what is left
jaccard_join   of documents linked by n-gram Jaccard similarity the one with the smallest doc_id stays
mix_sources    documents are repeated or left out so that sources reach their target weights, shard by shard, shuffled
bpe            every document's ids, encoded and decoded again
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import encode
from gridloom.llm.common import Scratch, table
from gridloom.llm.jaccard import jaccard_components
from gridloom.llm.lines import dedup_lines
from gridloom.llm.mixing import mixture
from gridloom.llm.toxicity import scored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"
PIECES = 150_000  # remembered by a Python worker, which lives on beside other stages' memory


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scored(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = dedup_lines(docs, ("n_lines", "n_removed", "kept"), keep=("doc_id", "lang", "source", "n_chars"), short=True)
    rows = rows.where(F.expr("n_removed = 0") | F.col("kept").rlike(r"[^\x20\t\n\x0B\f\r]"))
    return rows.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard_components(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path(TOKENIZER), ("n_tokens", "ids_sha256", "decoded_sha256"), pieces=PIECES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("mix_sources", mix_sources_stage),
    ("bpe", bpe_stage),
]

#: Classifier, edit distances and hash draws are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs

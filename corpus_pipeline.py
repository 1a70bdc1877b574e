"""A corpus pipeline of five operators: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.chunk_bpe import bpe_digests
from colloquy.llm.common import table
from colloquy.llm.line_dedup import line_dedup
from colloquy.llm.mixing import mixed_documents
from colloquy.llm.near_dedup import near_dedup
from colloquy.llm.toxicity import score_toxicity, train_toxicity


def _on_columns(stage: Callable[[DataFrame], DataFrame], docs: DataFrame, new_text: bool = False) -> DataFrame:
    """What stage makes of doc_id, text and source, and of docs' other columns under names that can't clash with those of an
    operator; then all have their own names again. Where texts are new, n_chars, if there is one, is that of the new text.

    A table without a source is of one, the null source. Null ids, null and empty texts, repeated rows and empty tables are
    as the operators define them; all values of other columns stay with their row."""
    used = {c.lower(): c for c in docs.columns if c.lower() in ("doc_id", "text", "source")}
    aside = {c: f"__column_{k}" for k, c in enumerate(docs.columns) if c not in used.values()}
    rows = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c.lower())) for c in docs.columns])
    out = stage(rows if "source" in used else rows.withColumn("source", F.lit(None).cast("string")))
    return out.select(*[(F.char_length("text").cast(docs.schema[c].dataType) if new_text and c.lower() == "n_chars" else F.col(aside.get(c, c.lower()))).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled ones, doesn't call toxic."""
    labels = table(spark, sf_dir, "labels")
    return _on_columns(lambda rows: score_toxicity(rows, train_toxicity(rows, labels)).where("predicted = 0"), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id has; one that loses all of them stays, empty."""
    return _on_columns(lambda rows: line_dedup(rows).withColumn("text", F.col("kept_text")), docs, new_text=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows that repeat its id and text stay with it."""
    return _on_columns(lambda rows: near_dedup(rows).where("kept"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes; documents without words are in no mix."""
    return _on_columns(mixed_documents, docs, new_text=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bpe_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenise),
]

#: A learned score and a tokenizer have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

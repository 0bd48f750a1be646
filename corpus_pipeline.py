"""From raw documents to token ids: five operators in a row, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, of every stage: null and empty texts are low quality only if the classifier scores them so, have no near
duplicates and no benchmark passages, weigh nothing in the mix (a source's whole repetitions take them along) and are
encoded as the end id alone; null doc_ids, sources and languages are kept as they are; rows that repeat a doc_id are
documents of their own, but equal rows are one group of copies; very long texts go through whole; an empty table gives
an empty result; further columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import decontamination, mixing, neardup, quality, tokens
from lexispark.llm.common import Scratch, temporary
from lexispark.llm.queries import table, tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs, tokenizer_path())


STAGES = [
    ("quality", reject_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Trees, sketches, tiling and tokenizer have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written to the shared folder and read again by the next, and then dropped. The
    store of token ids, which the last stage writes, stays."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        with nullcontext() if stage is write_tokens else temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs

"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again as the next one's docs. All but the last return the columns of ``documents``. Models are learned from the docs of
their own stage. Rows with null text or without words go in the first stage; rows without an id or with repeated ids are rows
like others, of equal texts one stays; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm import language, minhash, mixing, packing, quality
from quillstage.llm.common import discard, read, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Estimation, compression and sketches are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():  # what the stage has written on its way is of no use behind it
            before, docs = docs, written(stage(spark, docs, sf_dir), name, keep=True)
        if k:
            discard(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces are a table of their own
    return packed

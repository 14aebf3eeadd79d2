"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing and sharding, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, jaccard, mixing, rules, sharding


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule learned from the table labels rejects.

    Null and empty texts are judged like others, by features of 0; rows that
    repeat are judged alike; without usable labels, or rows, nothing goes.
    """
    return rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Rows that repeat both doc_id and text are copies of each other, and one of
    them stays.  Rows with a null doc_id can't be linked and stay.
    """
    member = jaccard.linked(docs, n=3, t=0.6)
    kept = common.semi(docs, member.where("doc_id != class_id").select("doc_id"), "left_anti")
    twice = common.repeated_ids(kept)
    if twice is None:
        return kept
    again = common.semi(kept, twice).dropDuplicates(["doc_id", "text"])
    return common.semi(kept, twice, "left_anti").unionByName(again)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of 13 words of a benchmark passage (or all of a shorter one)."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=13)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for; no source loses words, so none is dropped.

    Rows without words stay once; a null source is a source of its own; rows
    that repeat are copied alike; an empty table stays empty.
    """
    return mixing.mixed(docs, temperature=0.7)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the column `shard`: 16 shards of even size that keep linked documents together.

    Rows of one doc_id go to one shard; those without one are spread by chance;
    null and empty texts have no links; an empty table stays empty.
    """
    return sharding.sharded(docs, shards=16, slack=0.02)


STAGES = [("quality_rules", _quality), ("near_duplicates", _jaccard), ("decontamination", _decontaminate), ("mixing", _mix), ("sharding", _shard)]

#: No stage but the last can be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and deleted once the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.dropped(before)
    return docs

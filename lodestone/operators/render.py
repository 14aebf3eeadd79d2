"""Cutting results to what a reader or a model may be given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEST_SECTIONS, BUDGET = 3, 10_000
SECTION_WORDS, ALL_WORDS = 200, 8_000


def rendered(hits: DataFrame, sections: int = BEST_SECTIONS, budget: int = BUDGET) -> DataFrame:
    """Hits (qid, rank, source, section_id, place, score, content): the best sections of each result in their order in it, as far as the query's budget of characters goes.

    Adds total_length and, where the content is cut, next_offset.
    """
    best = F.row_number().over(Window.partitionBy("qid", "rank").orderBy(F.desc("score"), "place"))
    kept = hits.withColumn("n", best).where(F.col("n") <= sections).drop("n").withColumn("total_length", F.length("content"))
    before = F.coalesce(F.sum("total_length").over(Window.partitionBy("qid").orderBy("rank", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.least(F.col("total_length"), F.lit(budget) - before)).cast("int")
    out = kept.withColumn("room", room)
    return out.withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("room"))).withColumn("next_offset", F.when(F.col("room") < F.col("total_length"), F.col("room"))).drop("room")


def prompt_words(hits: DataFrame, section: int = SECTION_WORDS, total: int = ALL_WORDS) -> DataFrame:
    """Hits (qid, place, section_id, words): words of each section that a prompt takes, in order, under both limits."""
    one = F.least("words", F.lit(section))
    before = F.coalesce(F.sum(one).over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("taken", F.greatest(F.lit(0), F.least(one, F.lit(total) - before)).cast("int"))

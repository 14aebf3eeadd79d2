"""Searches in several rounds; models are injected as callables on DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import fusion
from lodestone.shared import saved_table

MIN_SCORE, MAX_ROUNDS, SUB_QUERIES = 0.4, 1, 3
STATUSES = ("valid", "partial", "invalid")

#: (qid, query) -> hits (qid, rank, source, section_id)
Search = Callable[[DataFrame], DataFrame]
#: hits -> (relevant (qid, section_id), verdict (qid, status, score))
Evaluate = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
#: unanswered (qid, query) -> (qid, query)
Reformulate = Callable[[DataFrame], DataFrame]


def status(raw: Column) -> Column:
    """valid, partial or invalid; anything else is partial."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin(*STATUSES), s).otherwise("partial")


def score(raw: Column) -> Column:
    """Within 0 and 1; 0.5 without a verdict."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.cast("double"), F.lit(0.5))))


def sub_queries(queries: DataFrame, parts: DataFrame, most: int = SUB_QUERIES) -> DataFrame:
    """(qid, grp, query): the query itself first, then its distinct trimmed parts (qid, n, part) in order, `most` at the most."""
    own = queries.select("qid", F.lit(0).alias("n"), "query")
    clean = parts.select("qid", "n", F.trim("part").alias("query")).where("query != ''").join(queries.select("qid"), "qid", "left_semi")
    first = clean.unionByName(own).groupBy("qid", F.lower("query").alias("low")).agg(F.min(F.struct("n", "query")).alias("f")).select("qid", "f.n", "f.query")
    return first.withColumn("grp", F.row_number().over(Window.partitionBy("qid").orderBy("n")) - 1).where(F.col("grp") <= most).select("qid", "grp", "query")


def grounded(queries: DataFrame, hits: DataFrame, evaluate: Evaluate) -> DataFrame:
    """(qid, status, score) of every query (qid, query): the evaluator's verdict, partial and 0.5 without one, invalid and 0 without hits."""
    try:
        verdict = saved_table(evaluate(hits)[1].select("qid", "status", "score"), "verdict")
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"no verdict: {e!r:.500}", stacklevel=2)
        verdict = queries.select("qid", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("score"))
    there = hits.select("qid").distinct().withColumn("there", F.lit(True))
    known = queries.select("qid").join(there, "qid", "left").join(verdict, "qid", "left")
    return known.select("qid", F.when(F.col("there"), status(F.col("status"))).otherwise("invalid").alias("status"), F.when(F.col("there"), score(F.col("score"))).otherwise(0.0).alias("score"))


def hypothetical(queries: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """HyDE: queries (qid, text) with the passage that `generate` made up for each appended; as they are where it made none."""
    made = generate(queries).select("qid", F.col("text").alias("passage"))
    return queries.join(made, "qid", "left").select("qid", F.when(F.trim(F.coalesce("passage", F.lit(""))) != "", F.concat_ws("\n", "text", "passage")).otherwise(F.col("text")).alias("text"))


def widened(queries: DataFrame, targets: DataFrame, translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Queries (qid, text) with their translations into the target languages (lang) appended, each once; `translate` takes (qid, text, lang)."""
    asked = queries.join(F.broadcast(targets.select("lang")))
    made = translate(asked).select("qid", "lang", F.trim("text").alias("other")).join(queries, "qid").where("other != '' and other != text")
    listed = made.groupBy("qid").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("lang", "other"))), lambda r: r["other"])), "\n").alias("others"))
    return queries.join(listed, "qid", "left").select("qid", F.concat_ws("\n", "text", "others").alias("text"))


@dataclass
class Iterative:
    """Retrieve, judge, drop or demote what isn't relevant, ask again where evidence is weak.

    Without an evaluator, or if it fails, results stay as they are.  `saved` cuts the lineage after each round; it must write where all
    executors read.
    """

    search: Search
    evaluate: Evaluate | None = None
    reformulate: Reformulate | None = None
    mode: str = "demote"
    rounds: int = MAX_ROUNDS
    least: float = MIN_SCORE
    saved: Callable[[DataFrame], DataFrame] = staticmethod(lambda df: saved_table(df, "iterative"))

    def run(self, queries: DataFrame) -> DataFrame:
        """(qid, rank, source, section_id) for all queries."""
        hits = self.saved(self.search(queries).withColumn("grp", F.lit(0)))
        pending, round_ = queries, 0
        while True:
            verdict = None
            if self.evaluate is not None:
                try:  # what the evaluator does lazily fails here too
                    relevant, verdict = (self.saved(x) for x in self.evaluate(hits))
                    judged = self._apply(hits, relevant)
                except Exception as e:  # noqa: BLE001  (it may be any model's)
                    warnings.warn(f"results are returned without a verdict: {e!r:.500}", stacklevel=2)
                    judged, verdict = hits, None
            else:
                judged = hits
            if round_ >= self.rounds or verdict is None or self.reformulate is None:
                return judged.drop("grp")
            weak = verdict.where(~((status(F.col("status")) == "valid") & (score(F.col("score")) >= self.least)))
            pending = pending.join(weak.select("qid"), "qid", "left_semi")
            if pending.isEmpty():
                return judged.drop("grp")
            round_ += 1
            pending = self.reformulate(pending)
            more = self.search(pending).withColumn("grp", F.lit(round_))
            fused = fusion.fuse_groups(hits.unionByName(more)).select("qid", "grp", F.col("position").alias("rank"), "source", F.explode("sections").alias("section_id"))
            hits = self.saved(fused)

    def _apply(self, hits: DataFrame, relevant: DataFrame) -> DataFrame:
        if self.mode == "filter":
            return fusion.only_relevant(hits, relevant)
        return fusion.demoted(hits, relevant).select("qid", F.col("new_rank").alias("rank"), "source", "section_id", "grp")

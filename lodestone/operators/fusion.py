"""Fusing, filtering and reordering of ranked results, for all queries at once.

Results are rows (qid, rank, source, sections, ...), ranks counted from 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import saved_table

#: Constant of reciprocal-rank fusion.
RRF = 60
#: A leg is asked for so many times the results wanted.
OVERFETCH = 2
DEFAULT_MAX = 3
UNRANKED = 1 << 30
POOL, MOST = 100, 500


def leg_limit(most: int) -> int:
    return OVERFETCH * (most or DEFAULT_MAX)


def ranked(df: DataFrame, *order, keep: int | None = None) -> DataFrame:
    """`df` with `rank` by `order` within each query."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return out if keep is None else out.where(F.col("rank") <= keep)


def rrf(legs: DataFrame, key: str = "source", keep: int | None = None) -> DataFrame:
    """Legs (qid, weight, rank, key) fused: the sum of weight / (60 + rank); ties by key."""
    fused = legs.groupBy("qid", key).agg(F.round(F.sum(F.col("weight") / (RRF + F.col("rank"))), 9).alias("score"))
    return ranked(fused, F.desc("score"), F.asc(key), keep=keep)


def rrf_chunks(legs: DataFrame, keep: int | None = None) -> DataFrame:
    """Legs (qid, rank, chunk_id, source) fused by chunk without weights, then summed by source."""
    chunk = legs.groupBy("qid", "chunk_id", "source").agg(F.sum(1 / (RRF + F.col("rank"))).alias("s"))
    out = chunk.groupBy("qid", "source").agg(F.round(F.sum("s"), 9).alias("score"), F.count("*").alias("chunks"))
    return ranked(out, F.desc("score"), F.asc("source"), keep=keep)


def without_ancestors(hits: DataFrame) -> DataFrame:
    """Sections (qid, source, section_id, branch) less those of which a direct child is there, then less those of which any ancestor is left.

    branch lists ids from the root to the section.  Ids are joined, not
    compared pair by pair, so a document's sections cost no square.
    """
    keys = ["qid", "source"]
    parent = hits.where(F.size("branch") > 1).select(*keys, F.element_at("branch", -2).alias("section_id")).distinct()
    left = hits.join(parent, [*keys, "section_id"], "left_anti")
    above = left.select(*keys, "section_id", F.explode(F.slice("branch", 1, F.size("branch") - 1)).alias("ancestor"))
    there = left.select(*keys, F.col("section_id").alias("ancestor"))
    covered = above.join(there, [*keys, "ancestor"], "left_semi").select(*keys, "section_id").distinct()
    return left.join(covered, [*keys, "section_id"], "left_anti")


def fuse_groups(hits: DataFrame) -> DataFrame:
    """Hits (qid, grp, rank, source, section_id) of several searches: a section stays with the first group and rank that has it, results left empty go."""
    first = Window.partitionBy("qid", "section_id").orderBy("grp", "rank", "source")
    one = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    grouped = one.groupBy("qid", "grp", "rank", "source").agg(F.sort_array(F.collect_list("section_id")).alias("sections"))
    return grouped.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("grp", "rank", "source")))


def only_relevant(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hits (qid, source, section_id, rank) of relevant sections (qid, section_id); a source without any is gone."""
    return hits.join(relevant.select("qid", "section_id").distinct(), ["qid", "section_id"], "left_semi")


def demoted(results: DataFrame, relevant: DataFrame, section: str = "section_id") -> DataFrame:
    """Results with a relevant section first, otherwise in their order: column new_rank."""
    good = relevant.select("qid", F.col(section).alias("good")).distinct()
    marked = results.join(good, (results["qid"] == good["qid"]) & (results[section] == good["good"]), "left").select(results["*"], F.col("good").isNotNull().cast("int").alias("is_relevant"))
    by_result = Window.partitionBy("qid", "rank")
    marked = marked.withColumn("is_relevant", F.max("is_relevant").over(by_result))
    return marked.withColumn("new_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("is_relevant"), "rank")))


def nonempty(results: DataFrame) -> DataFrame:
    return results.where(F.size("sections") > 0)


def head(page: int) -> int:
    """How many results are reranked."""
    return max(4 * page, 20)


def apply_ranking(results: DataFrame, order: DataFrame, window: int) -> DataFrame:
    """Results (qid, rank, source, section_id) reordered by sections' new ranks (qid, section_id, section_rank) among the first `window`; the rest stays.

    A result counts as its best section, one without a rank comes last, equals
    keep their order.  score is 1 / (1 + rank among the reordered, from 0).
    """
    best = results.join(order, ["qid", "section_id"], "left").groupBy("qid", "rank", "source").agg(F.min(F.coalesce("section_rank", F.lit(UNRANKED))).alias("best"))
    within = F.col("rank") <= window
    out = best.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(~within, F.when(within, F.col("best")), "rank")))
    return out.select("qid", "source", "rank", "new_rank", F.when(within, F.round(1 / F.col("new_rank"), 9)).alias("score"))


def target(offset: int, page: int, pool: int | None = None, filtered: bool = False) -> int:
    """How many candidates to rank for a page."""
    if pool is not None:
        return pool
    want = offset + page + 1
    return want if filtered else min(max(want, POOL), MOST)


def postfilter_windows(target: int, total: int) -> list[int]:
    """The windows a post-filter goes through when nothing passes: three times the target, then three times more each, up to 500 or all."""
    out = [min(3 * target, MOST)]
    while out[-1] < min(MOST, total):
        out.append(min(3 * out[-1], MOST))
    return out


def postfiltered(ranked: DataFrame, judge: Callable[[DataFrame], DataFrame], target: int, key: str = "source") -> DataFrame:
    """The first `target` rows of each query in `ranked` (qid, rank, key, ...) that a judge lets through, with new ranks.

    Windows are those of `postfilter_windows`; only queries that are still short
    go on to the next one.  `judge` takes keys and returns the good ones; it
    sees each key once.
    """
    ranked = ranked.where(F.col("rank") <= MOST)
    short, seen, good, before = ranked.select("qid").distinct(), None, None, 0
    for upto in postfilter_windows(target, MOST):
        window = ranked.where((F.col("rank") > before) & (F.col("rank") <= upto)).join(short, "qid", "left_semi")
        new = window.select(key).distinct()
        new = saved_table(new if seen is None else new.join(seen, key, "left_anti"), "judged")
        passed = saved_table(judge(new).select(key).distinct(), "passed")
        seen = new if seen is None else seen.unionByName(new)
        good = passed if good is None else good.unionByName(passed)
        many = ranked.where(F.col("rank") <= upto).join(good, key, "left_semi").groupBy("qid").count().where(F.col("count") >= target)
        short = saved_table(ranked.where(F.col("rank") > upto).select("qid").distinct().join(many, "qid", "left_anti"), "short")
        before = upto
        if short.isEmpty():
            break
    kept = ranked.limit(0) if good is None else ranked.join(good, key, "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= target)

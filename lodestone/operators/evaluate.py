"""Measures of ranked runs: run (qid, rank, source), qrels (qid, source), k from 1."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import answer_normalised

KS = (1, 3, 5, 10)
#: Pairs of answers whose words are counted at once.
PAIRS = 1000


def normalised_ks(ks: Iterable[int]) -> list[int]:
    return sorted({k for k in ks if k > 0}) or [1]


def per_query(run: DataFrame, qrels: DataFrame, ks: Iterable[int] = KS) -> DataFrame:
    """(qid, k, recall, precision, ndcg, ndcg_std, rr, first_rank) for every query with a relevant source.

    precision divides by min(k, retrieved).  ndcg's ideal knows no more places
    than were retrieved, ndcg_std's is the usual one.  A source counts at its
    first rank; rr is 0 and first_rank -1 where nothing relevant is found.
    """
    gold = qrels.select("qid", "source").distinct()
    wanted = gold.groupBy("qid").agg(F.count("*").alias("relevant"))
    got = run.groupBy("qid", "source").agg(F.min("rank").alias("rank"))
    size = run.groupBy("qid").agg(F.max("rank").alias("retrieved"))
    hit = got.join(gold, ["qid", "source"])
    grid = wanted.join(size, "qid", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0))).withColumn("k", F.explode(F.array(*(F.lit(k) for k in normalised_ks(ks)))))
    at = grid.join(hit.select("qid", "rank"), "qid", "left").groupBy("qid", "k", "relevant", "retrieved").agg(F.count(F.when(F.col("rank") <= F.col("k"), 1)).alias("hits"), F.sum(F.when(F.col("rank") <= F.col("k"), 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.min("rank").alias("first"))
    ideal = lambda m: F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    dcg = F.coalesce("dcg", F.lit(0.0))
    short = F.least(F.col("relevant"), F.least(F.col("k").cast("bigint"), F.col("retrieved").cast("bigint")))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return at.select("qid", "k", ratio(F.col("hits"), F.col("relevant")).alias("recall"), ratio(F.col("hits"), F.least("k", "retrieved")).alias("precision"), ratio(dcg, ideal(short)).alias("ndcg"), ratio(dcg, ideal(F.least(F.col("relevant"), F.col("k").cast("bigint")))).alias("ndcg_std"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.coalesce("first", F.lit(-1)).cast("int").alias("first_rank"))


def means(measured: DataFrame, *by: str) -> DataFrame:
    """Averages over queries by k (and by further columns)."""
    return measured.groupBy("k", *by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "ndcg", "ndcg_std")), F.round(F.avg("rr"), 6).alias("mrr"))


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, em, f1) of rows (id, p, g): words of both are counted row by row, PAIRS rows at a time."""

    def counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        words = pc.split_pattern(texts, " ")
        row, flat = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy())), words.flatten()
        there = pc.greater(pc.binary_length(flat), 0)
        return row[there.to_numpy(zero_copy_only=False)], flat.filter(there)

    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS):
            batch = whole.slice(at, PAIRS)
            (p_row, p), (g_row, g) = counted(batch.column("p")), counted(batch.column("g"))
            both = pa.concat_arrays([p, g]).dictionary_encode()
            code, kinds = both.indices.to_numpy().astype(np.int64), max(1, len(both.dictionary))
            p_pair, p_times = np.unique(p_row * kinds + code[: len(p)], return_counts=True)
            g_pair, g_times = np.unique(g_row * kinds + code[len(p) :], return_counts=True)
            pair, i, j = np.intersect1d(p_pair, g_pair, assume_unique=True, return_indices=True)
            overlap = np.bincount(pair // kinds, np.minimum(p_times[i], g_times[j]), batch.num_rows)
            words = np.bincount(p_row, minlength=batch.num_rows) + np.bincount(g_row, minlength=batch.num_rows)
            f1 = np.where(words == 0, 1.0, 2 * overlap / np.maximum(words, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.equal(batch.column("p"), batch.column("g")).cast(pa.int32()), pa.array(f1)], ["id", "em", "f1"])


def answers(rows: DataFrame) -> DataFrame:
    """Rows (id, pred, golds array) with exact match and token F1, each the best over the golds; two empty answers agree.

    Texts aren't shuffled: words are counted where the row is, and only its measures are grouped by id.
    """
    each = rows.select("id", answer_normalised(F.col("pred")).alias("p"), F.explode("golds").alias("g")).select("id", "p", answer_normalised(F.col("g")).alias("g")).where("p is not null and g is not null")
    scored = each.mapInArrow(_agreed, f"id {dict(each.dtypes)['id']}, em int, f1 double")
    return scored.groupBy("id").agg(F.max("em").alias("em"), F.round(F.max("f1"), 6).alias("f1"))


def answerable(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Queries all of whose relevant sources, at least one, are in the corpus."""
    missing = qrels.join(corpus.select("source"), "source", "left_anti").select("qid")
    return queries.join(qrels.select("qid"), "qid", "left_semi").join(missing, "qid", "left_anti")


def subsample(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, n_queries: int, distractors: int) -> tuple[DataFrame, DataFrame]:
    """The first queries by id that the corpus can answer, and a corpus of all their sources and the first distractors in order of `place`."""
    chosen = answerable(queries.orderBy("qid").limit(n_queries), qrels, corpus)
    gold = qrels.join(chosen.select("qid"), "qid", "left_semi").select("source").distinct()
    kept = corpus.join(gold, "source", "left_semi")
    rest = corpus.join(gold, "source", "left_anti").orderBy("place", "source").limit(distractors)
    return chosen, kept.unionByName(rest)


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both, the first's rows where they share a key."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def translated(queries: DataFrame, translations: DataFrame) -> DataFrame:
    """Queries with their translated text where there is one."""
    t = translations.select("qid", F.col("query").alias("other"))
    return queries.join(t, "qid", "left").withColumn("query", F.coalesce("other", "query")).drop("other")

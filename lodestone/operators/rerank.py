"""Model-free reranking: BM25 over the pool, coverage, proximity, phrase and prior.

`pool` has (qid, section_id, content, prior), `queries` (qid, query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.lexical import idf, term_score

DEFAULT = {"prior": 1.0, "bm25": 1.0, "coverage": 0.0, "proximity": 0.0, "phrase": 0.0}


def positions(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, section_id, len, term, pos, tf): where each section has its query's terms; pos ascends."""
    terms = queries.select("qid", F.explode(T.unique_terms(F.col("query"))).alias("term"))
    words = pool.select("qid", "section_id", T.tokens(F.col("content")).alias("w")).select("qid", "section_id", F.size("w").alias("len"), F.posexplode("w").alias("at", "term"))
    hit = words.join(terms, ["qid", "term"])
    return hit.groupBy("qid", "section_id", "term").agg(F.first("len").alias("len"), F.sort_array(F.collect_list("at")).alias("pos"), F.count("*").alias("tf"))


def shortest_window(hits: DataFrame) -> DataFrame:
    """(qid, section_id, terms, width): words of the shortest stretch that has every query term the section has.

    The places of all terms are gone through in order once, with the last place
    of each term at hand.
    """
    term = Window.partitionBy("qid", "section_id").orderBy("term")
    numbered = hits.withColumn("no", F.row_number().over(term) - 1)
    places = F.sort_array(F.flatten(F.collect_list(F.transform("pos", lambda p: F.struct(p.alias("p"), F.col("no").alias("no"))))))
    by = numbered.groupBy("qid", "section_id").agg(F.count("*").cast("int").alias("terms"), places.alias("places"))
    fold = """aggregate(places, named_struct('last', array_repeat(-1, terms), 'width', 2147483647),
        (a, x) -> named_struct(
            'last', transform(a.last, (v, i) -> if(i = x.no, x.p, v)),
            'width', if(array_min(transform(a.last, (v, i) -> if(i = x.no, x.p, v))) < 0, a.width,
                        least(a.width, x.p - array_min(transform(a.last, (v, i) -> if(i = x.no, x.p, v))) + 1))), a -> a.width)"""
    return by.select("qid", "section_id", "terms", F.expr(fold).alias("width"))


def features(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, section_id, prior, bm25, coverage, proximity, phrase), each to 6 digits; pool statistics are those of the query's pool."""
    hits = positions(pool, queries)
    size = pool.groupBy("qid").agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col("content")))).alias("average"))
    df = hits.groupBy("qid", "term").agg(F.count("*").alias("df"))
    asked = queries.select("qid", "query", T.unique_terms(F.col("query")).alias("terms"))
    each = asked.select("qid", F.explode("terms").alias("term")).join(df, ["qid", "term"], "left").join(size, "qid").withColumn("idf", idf(F.col("n"), F.coalesce("df", F.lit(0))))
    whole = each.groupBy("qid").agg(F.sum("idf").alias("all_idf"))
    scored = hits.join(each.select("qid", "term", "idf", "n", "average"), ["qid", "term"])
    sums = scored.groupBy("qid", "section_id").agg(F.sum(term_score(F.col("idf"), F.col("tf"), F.col("len"), F.col("average"))).alias("bm25"), F.sum("idf").alias("own_idf"))
    near = shortest_window(hits)
    q = F.size("terms_asked")
    proximity = F.when(F.col("terms").isNull(), 0.0).when(F.col("terms") == 1, 1 / q).otherwise(F.col("terms") / F.col("width") * F.col("terms") / q)
    phrase = (q > 1) & T.normalised(F.col("content")).contains(T.normalised(F.col("query")))
    out = pool.join(asked.withColumnRenamed("terms", "terms_asked"), "qid").join(sums, ["qid", "section_id"], "left").join(near, ["qid", "section_id"], "left").join(whole, "qid", "left")
    return out.select("qid", "section_id", "prior", F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25"), F.round(F.when(F.col("all_idf") > 0, F.coalesce("own_idf", F.lit(0.0)) / F.col("all_idf")).otherwise(0.0), 6).alias("coverage"), F.round(proximity, 6).alias("proximity"), phrase.cast("double").alias("phrase"))


def blended(features_: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, section_id, score, new_rank): weighted features, BM25 and prior scaled to 0..1 in the pool (0 where all are equal); ties by section."""
    w = DEFAULT | (weights or {})
    over = Window.partitionBy("qid")

    def scaled(c: str):
        low, high = F.min(c).over(over), F.max(c).over(over)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    wide = features_.withColumns({"prior": scaled("prior"), "bm25": scaled("bm25")})
    score = sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    return wide.select("qid", "section_id", F.round(score, 8).alias("score")).withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "section_id")))

"""Lexical retrieval: postings, BM25 and hits by source, for all queries at once.

`best` is the way to rankings: texts are tokenised once into codes of the
queries' terms, and blocks of them are scored against all queries, so that only
k rows a block and query are shuffled.  `bm25` scores by joins; it is taken for
more query terms than QUERY_TERMS, and where all scores are wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.shared import batches_of, saved_table

K1, B = 1.2, 0.75
#: (query, term) pairs up to which they are broadcast, at 24 bytes each.
QUERY_TERMS = 2_000_000
#: Texts of an Arrow batch, and words of it that are coded at once.
TEXTS, WORDS = 1000, 500_000
#: Meetings of a document's terms and queries that are scored at once.
MEETINGS = 500_000
#: Scores that a task keeps to know which are among a query's k best so far; beyond, each block gives its own k best.
KEPT = 2_000_000


#: Text to an array of terms.  `analyzed` makes one of several languages' stemmers.
Analyzer = Callable[[Column], Column]


def analyzed(stem: Callable[[Column], Column], keep: bool = True) -> Analyzer:
    """An analyzer that stems each token, and with `keep` has the token itself as well, once where they are the same."""

    def terms(text: Column) -> Column:
        plain = T.tokens(text)
        stems = F.filter(F.transform(plain, stem), lambda w: w != "")
        if not keep:
            return stems
        return F.concat(plain, F.filter(F.zip_with(plain, F.transform(plain, stem), lambda a, b: F.when((a != b) & (b != ""), b)), lambda w: w.isNotNull()))

    return terms


def by_language(analyzers: dict[str, Analyzer], guess: Callable[[Column], Column] = T.guess_language) -> Analyzer:
    """Each text under the analyzer of its own language, found by `guess`; plain tokens for languages without one."""

    def terms(text: Column) -> Column:
        out = T.tokens(text)
        for lang, analyzer in sorted(analyzers.items()):
            out = F.when(guess(text) == lang, analyzer(text)).otherwise(out)
        return out

    return terms


def by_languages(analyzers: dict[str, Analyzer]) -> Analyzer:
    """Every text under all analyzers at once, the terms of each marked with its language, and the plain tokens."""

    def terms(text: Column) -> Column:
        mark = lambda lang: lambda w: F.concat(F.lit(lang + ":"), w)
        return F.concat(T.tokens(text), *(F.transform(analyzer(text), mark(lang)) for lang, analyzer in sorted(analyzers.items())))

    return terms


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", analyzer: Analyzer = T.tokens) -> DataFrame:
    """(key, term, tf, len): one row for each term of each text."""
    terms = docs.select(key, analyzer(F.col(text)).alias("terms")).select(key, F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", repeated: DataFrame | None = None, analyzer: Analyzer = T.tokens) -> DataFrame:
    """(term, sections, occurrences): in how many keys each term is, and how often.

    A text's own terms are counted in its row, so rows are summed by term
    before any shuffle.  That takes keys that one row has; of texts in
    `repeated`, with the same columns, several may have the same key.
    """
    terms = docs.select(key, analyzer(F.col(text)).alias("terms"))
    ways = F.array(F.struct("terms", F.lit(0).alias("own")), F.struct(F.array_distinct("terms").alias("terms"), F.col(key).isNotNull().cast("int").alias("own")))
    each = terms.select(F.posexplode(ways).alias("way", "w")).select("way", "w.own", F.explode("w.terms").alias("term"))
    out = each.groupBy("term").agg(F.sum("own").alias("sections"), F.sum(1 - F.col("way")).alias("occurrences"))
    if repeated is None:
        return out
    rest = repeated.select(key, F.explode(analyzer(F.col(text))).alias("term")).groupBy("term").agg(F.countDistinct(key).alias("sections"), F.count("*").alias("occurrences"))
    return out.unionByName(rest).groupBy("term").agg(F.sum("sections").alias("sections"), F.sum("occurrences").alias("occurrences"))


def query_terms(queries: DataFrame, qid: str, text: str = "text", analyzer: Analyzer = T.tokens) -> DataFrame:
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(analyzer(F.col(text)))).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def term_score(idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(docs: DataFrame, queries: DataFrame, qid: str, key: str = "doc_id", analyzer: Analyzer = T.tokens) -> DataFrame:
    """(qid, key, len, terms, score) of every document that has a term of the query.

    Queries' terms filter the postings before they are shuffled: Spark
    broadcasts them where they are small.  Sums are rounded to 6 digits, so
    results don't depend on the order of addition.
    """
    wanted = query_terms(queries, qid, analyzer=analyzer)
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(analyzer(F.col("text")))).alias("average"))
    post = postings(docs, key, analyzer=analyzer).join(wanted.select("term").distinct(), "term", "left_semi")
    frequency = post.groupBy("term").agg(F.count("*").alias("df"))
    hit = post.join(frequency, "term").join(wanted, "term").crossJoin(F.broadcast(size))
    score = term_score(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("len"), F.col("average"))
    return hit.groupBy("qid", key).agg(F.first("len").alias("len"), F.count("*").alias("terms"), F.round(F.sum(score), 6).alias("score"))


def _coded(docs: DataFrame, key: str, hashes: np.ndarray, text: str, analyzer: Analyzer) -> DataFrame:
    """(key, len, codes, tf) of every text: the place in `hashes` of each of its terms that is there, and how often it comes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            until = whole.column("words").offsets.to_numpy()
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(until, until[lo] + WORDS, "right")) - 1)
                batch = whole.slice(lo, hi - lo)
                size = np.diff(until[lo : hi + 1])
                h = batch.column("words").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[at] == h
                pair, tf = np.unique(doc[known] * np.int64(len(hashes)) + at[known], return_counts=True)
                starts = np.searchsorted(pair // len(hashes), np.arange(len(size) + 1)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(starts), pa.array(x.astype(np.int32))) for x in (pair % len(hashes), tf))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size.astype(np.int32)), *lists], [key, "len", "codes", "tf"])
                lo = hi

    kind = docs.schema[key].dataType.simpleString()
    words = docs.select(key, F.transform(analyzer(F.col(text)), lambda w: F.xxhash64(w)).alias("words"))
    return words.mapInArrow(code, f"{key} {kind}, len int, codes array<int>, tf array<int>")


def ranking(docs: DataFrame, queries: DataFrame, qid: str, key: str = "doc_id", text: str = "text", analyzer: Analyzer = T.tokens) -> Callable[..., DataFrame]:
    """A function of (k, only, after) to what `best` returns; texts are coded once for all its calls.

    Of the tables of keys, `only` goes below the scores and `after` is applied
    to rankings of everything.
    """
    wanted = query_terms(queries, qid, analyzer=analyzer).withColumn("h", F.xxhash64("term"))
    asked = wanted.select("qid", "h").distinct().limit(QUERY_TERMS + 1).toArrow().combine_chunks()
    if asked.num_rows > QUERY_TERMS:
        scored = bm25(docs.select(key, F.col(text).alias("text")), queries, qid, key, analyzer)

        def joined(k: int, only: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
            rows = scored if only is None else scored.join(only, key, "left_semi")
            return top(rows if after is None else rows.join(after, key, "left_semi"), k, key)

        return joined
    qids = asked["qid"].combine_chunks().dictionary_encode() if asked.num_rows else pa.array([], asked.schema.field("qid").type).dictionary_encode()
    hashes, term = np.unique(asked["h"].to_numpy(), return_inverse=True)
    schema = f"qid {dict(wanted.dtypes)['qid']}, {key} {docs.schema[key].dataType.simpleString()}, len int, terms bigint, score double"
    if not len(hashes):
        return lambda k, only=None, after=None: top(docs.sparkSession.createDataFrame([], schema), k, key)
    order = np.argsort(term, kind="stable")
    query, bounds = qids.indices.to_numpy()[order], np.searchsorted(term[order], np.arange(len(hashes) + 1))
    with batches_of(docs.sparkSession, TEXTS):
        coded = saved_table(_coded(docs, key, hashes, text, analyzer), "coded")
    size = coded.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(len(hashes))
    for code, n in coded.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        df[code] = n
    weight = np.maximum(0.0, np.log(1 + (size[0] - df + 0.5) / (df + 0.5)))
    sent = docs.sparkSession.sparkContext.broadcast((qids.dictionary, query, bounds, weight, size[1]))

    def ranked(k: int, only: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, query, bounds, weight, average = sent.value
            many = np.diff(bounds)
            so_far = np.full((k, len(names)), -1.0) if k * len(names) <= KEPT else None
            for batch in batches:
                codes, length = batch.column("codes"), batch.column("len").to_numpy()
                passed = batch.column("passed").to_numpy(zero_copy_only=False)
                starts = codes.offsets.to_numpy() - codes.offsets[0].as_py()
                code, tf = codes.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
                meet = np.concatenate(([0], np.cumsum(many[code])))[starts] + np.arange(len(starts)) * len(names)
                lo = 0
                while lo < len(length):
                    hi = max(lo + 1, int(np.searchsorted(meet, meet[lo] + MEETINGS, "right")) - 1)
                    own = slice(starts[lo], starts[hi])
                    doc = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
                    part = weight[code[own]] * tf[own] * (K1 + 1) / (tf[own] + K1 * (1 - B + B * length[lo:hi][doc] / average))
                    times = many[code[own]]
                    q = query[np.repeat(bounds[code[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                    spot = np.repeat(doc, times) * len(names) + q
                    shape = (hi - lo, len(names))
                    total = np.round(np.bincount(spot, np.repeat(part, times), shape[0] * shape[1]).astype(np.float64), 6).reshape(shape)
                    terms = np.bincount(spot, minlength=shape[0] * shape[1]).reshape(shape)
                    good = (terms > 0) & passed[lo:hi, None]
                    placed = np.where(good, total, -1.0)
                    if so_far is None:
                        least = np.partition(placed, max(0, shape[0] - k), axis=0)[max(0, shape[0] - k)]
                    else:
                        so_far = np.partition(np.concatenate((so_far, placed)), shape[0], axis=0)[shape[0] :]
                        least = so_far[0]
                    d, q = np.nonzero((placed >= least) & good)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(key).take(pa.array(d + lo)), pa.array(length[d + lo]), pa.array(terms[d, q]), pa.array(total[d, q])], ["qid", key, "len", "terms", "score"])
                    lo = hi

        rows = coded if only is None else coded.join(only.select(key), key, "left_semi")
        if after is None:
            rows = rows.withColumn("passed", F.lit(True))
        else:
            rows = rows.join(after.select(key, F.lit(True).alias("passed")).distinct(), key, "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
        return top(rows.select(key, "len", "codes", "tf", "passed").mapInArrow(score, schema), k, key)

    return ranked


def best(docs: DataFrame, queries: DataFrame, qid: str, k: int, key: str = "doc_id", only: DataFrame | None = None, text: str = "text", analyzer: Analyzer = T.tokens) -> DataFrame:
    """(qid, key, len, terms, score, rank) of each query's k best documents by BM25; ties by key.

    With `only` (a table of keys) none but those are ranked, under the whole
    corpus's statistics.  A document without a term of the query isn't ranked;
    scores are rounded to 6 digits before they are compared.  Null texts and
    queries have no terms.
    """
    return ranking(docs, queries, qid, key, text, analyzer)(k, only)


def top(scored: DataFrame, k: int, *tie: str, by: str = "score", ascending: bool = False) -> DataFrame:
    """The k best rows of each query, with their rank from 1."""
    order = [F.col(by).asc() if ascending else F.col(by).desc(), *(F.col(c) for c in tie)]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def restricted(docs: DataFrame, bridge: DataFrame, collections: list[str], key: str = "doc_id") -> DataFrame:
    """Documents in any of the collections."""
    return docs.join(bridge.where(F.col("collection_id").isin(*collections)).select(key), key, "left_semi")


def by_source(hits: DataFrame, source: str, section: str) -> DataFrame:
    """Hits (qid, source, section, score, rank) grouped: summed score, sections in order of hits, each one's score."""
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(section).alias("section"), "score")))
    out = hits.groupBy("qid", source).agg(F.round(F.sum("score"), 6).alias("score"), listed.alias("l"))
    return out.select("qid", source, "score", F.expr("transform(l, x -> x.section)").alias("sections"), F.expr("map_from_entries(transform(l, x -> struct(x.section, x.score)))").alias("section_scores"))


def normalise_rank(score: Column, length: Column, unique: Column, mask: int) -> Column:
    """Bits: 1 divides by 1 + log(length), 2 by length, 8 by unique words, 32 gives r / (r + 1)."""
    if mask & 1:
        score = score / (1 + F.log(F.greatest(length, F.lit(1))))
    if mask & 2:
        score = score / F.greatest(length, F.lit(1))
    if mask & 8:
        score = score / F.greatest(unique, F.lit(1))
    return score / (score + 1) if mask & 32 else score

"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = exp(lambda_s * x) with x its words over the mean
and s its source: of all rates whose words per source are as wanted, these
stray least, in relative entropy, from taking each document once.  The
multipliers lambda solve the convex dual, which has one dimension a source and,
as a document has one source, a diagonal Hessian.  Each Newton iteration is one
distributed aggregation over a table of (source, words) counts, which the
documents are summed up in once without loss; only two sums a source reach the
driver.  Rates are rounded to whole copies without bias.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import aside, dropped, saved

#: Relative error of a source's words at which its multiplier counts as solved.
TOLERANCE = 1e-9
ITERATIONS = 100
#: Sources up to which their multipliers are broadcast.
BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("null"))


def _name(key: str) -> str | None:
    return None if key == "null" else key[1:]


def solve(hist: DataFrame, wanted: dict[str, float], unit: float) -> dict[str, float]:
    """lambda of each source such that its documents' words times rates add up to `wanted`.

    `hist` has (src, words, n).  Newton's method on log(sum of words*rate),
    which is convex and increasing in lambda, so from the second step on every
    step is downhill and none overshoots; sums are taken relative to their
    largest exponent, so none overflows.
    """
    spark = hist.sparkSession
    at = dict.fromkeys(wanted, 0.0)
    ends = {r.src: (r.lo / unit, r.hi / unit) for r in hist.where("words > 0").groupBy("src").agg(F.min("words").alias("lo"), F.max("words").alias("hi")).collect()}
    open_ = set(wanted)
    x = F.col("words") / F.lit(unit)
    for _ in range(ITERATIONS):
        top = {s: max(at[s] * ends[s][0], at[s] * ends[s][1]) for s in open_}
        step = spark.createDataFrame([(s, at[s], top[s]) for s in sorted(open_)], "src string, lam double, top double")
        step = F.broadcast(step) if len(open_) <= BROADCAST else step
        part = F.col("n") * x * F.exp(F.col("lam") * x - F.col("top"))
        sums = hist.where("words > 0").join(step, "src").groupBy("src").agg(F.sum(part).alias("g"), F.sum(part * x).alias("h")).collect()
        for r in sums:
            off = math.log(r.g) + top[r.src] - math.log(wanted[r.src] / unit)
            if abs(off) < TOLERANCE:
                open_.discard(r.src)
            else:
                at[r.src] -= off * r.g / r.h
        if not open_:
            return at
    raise ArithmeticError(f"no multiplier within {ITERATIONS} iterations for {sorted(open_)[:5]}")


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, total_words: float | None = None) -> DataFrame:
    """Adds word count, rate and copies to each row of `docs`: columns mix_words, mix_rate, mix_copies.

    `weights` gives each source's share of the words (scaled to add up to 1;
    the key None is the rows without a source); sources that it lacks get rate
    0.  Without it a source's share goes with its words to the power of
    `temperature`.  `total_words` is the mixture's size; without it the
    smallest in which no source with a weight has fewer words than now, so
    that every rate is 1 at least and no document is lost.

    copies = floor(rate + u) with u in [0, 1) from a hash of id and text, so the
    expected copies are the rate, and repeated rows are treated alike.  A row
    without words (null or blank text) carries no constraint: rate 1, or 0 in a
    source without weight.  A source none of whose rows has words can't be
    given any; its weight is spread over the rest.  A null doc_id is allowed.
    An empty table stays empty.  Columns named mix_words, mix_rate or
    mix_copies are replaced; all others are kept.
    """
    src = "mix_source"
    docs, back = aside(docs, src, "mix_lambda")
    sized = docs.withColumns({"mix_words": words(docs["text"]), src: _source(docs)})
    hist = saved(sized.groupBy(F.col(src).alias("src"), F.col("mix_words").alias("words")).agg(F.count("*").alias("n")), "mixing-counts")
    have = {r.src: r.words for r in hist.groupBy("src").agg(F.sum(F.col("words") * F.col("n")).alias("words")).collect()}
    if weights is None:
        share = {s: float(w) ** temperature for s, w in have.items() if w}
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("a weight is negative")
        share = {s: float(weights.get(_name(s), 0)) for s, w in have.items() if w}
        share = {s: w for s, w in share.items() if w}
    whole = sum(share.values())
    share = {s: w / whole for s, w in share.items()}
    total = total_words or max((have[s] / w for s, w in share.items()), default=0)
    unit = sum(have.values()) / max(1, hist.agg(F.sum("n")).first()[0] or 0) or 1.0
    lam = solve(hist, {s: total * w for s, w in share.items()}, unit) if share else {}
    dropped(hist)
    blank = {s for s, w in have.items() if not w} if weights is None else {s for s, w in have.items() if not w and weights.get(_name(s))}
    rows = [(s, v) for s, v in lam.items()] + [(s, 0.0) for s in sorted(blank)]
    at = docs.sparkSession.createDataFrame(rows, f"{src} string, mix_lambda double")
    at = F.broadcast(at) if len(rows) <= BROADCAST else at
    out = sized.join(at, src, "left").withColumn("mix_rate", F.coalesce(F.exp(F.col("mix_lambda") * F.col("mix_words") / F.lit(float(unit))), F.lit(0.0)))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    return out.withColumn("mix_copies", F.floor(F.round("mix_rate", 12) + u).cast("bigint")).drop(src, "mix_lambda").transform(back)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as `mixture` says, with the columns of `docs`."""
    docs, back = aside(docs, "mix_words", "mix_rate", "mix_copies", "mix_copy")
    many = mixture(docs, **how).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return many.select(*(F.col(f"`{c}`") for c in docs.columns)).transform(back)

"""Sharding by balanced label propagation.

Documents are linked by what they share: sentences of 40 characters or more,
n-grams of 16 words and whole texts.  Of the n-grams of every 17 neighbouring
ones the one with the least hash is taken (winnowing), so any run of 32 words
that two documents share is a link, wherever their sentences end; so is every
copy, however short.  The links stay bipartite (document - unit), so a unit that
k documents share costs k rows and not k*k; it weighs 1/(k-1) for each two of
them, so every unit weighs 1 to a document.  Units that the very same documents
share are one link of added weight.

Each round is a chain of Spark joins: labels are counted by unit and shard,
every document sums the counts of its units and wishes for the shard with the
most weight.  Wishes from shard i to j are granted, best gain first, as far as
wishes from j to i match them or j has room, so sizes stay even.  In each round a
hash lets about half of the documents act, so two that want each other's shard
don't swap for ever.  Rounds go on until hardly a wish is left, or none of the
left ones can be granted.  Documents without links fill the shards up at
the end.

Who is granted a wish is decided by counts of gains in bins (eighths of powers
of two) and, within the bin in which the quota runs out, of bins of hashes; so
no shard's documents are sorted or numbered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textgrams as G
from lodestone.llm.common import aside, dropped, repeated_ids, saved, semi, small_batches, small_enough

#: Documents without links that are numbered in one bucket.
NUMBERED = 1_000_000
#: Bins of hashes by which a shard's, or a bin of gains', documents are told apart.
SUB = 4096
#: Words of an n-gram, and neighbouring n-grams of which one is taken: runs of GRAM + SPAN - 1 words are links.
GRAM, SPAN = 16, 17

#: Shards up to which a link's counts are columns.
WIDE = 32
#: Units gathered in a task before they are sent off in packets, and units for which a bucket is planned, at CHARS characters of text each.
FLUSH, PER_BUCKET, CHARS = 1_000_000, 500_000, 40

UNITS = pa.schema([("doc_id", pa.int64()), ("link", pa.int64())])
_SENT = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("links", pa.binary()), ("known", pa.binary())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Doc ids and units of rows (doc_id, norm, whole, sentences): sentences, winnowed n-grams and the whole text; FLUSH of them or so at once."""
    docs, units, waiting = [], [], 0
    for batch in batches:
        for part in G.pieces(batch):
            h, text = G.winnowed(*G.grams(*G.words(part.column("norm")), GRAM), SPAN)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            whole, sentences = part.column("whole"), part.column("sentences")
            full = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
            many = np.repeat(np.arange(len(doc)), np.diff(sentences.offsets.to_numpy()))
            text, unit = np.concatenate((text, full, many)), np.concatenate((h.view(np.int64), whole.drop_null().to_numpy(), sentences.flatten().to_numpy()))
            docs.append(doc[text]), units.append(unit)
            waiting += len(units[-1])
            if waiting >= FLUSH:
                yield np.concatenate(docs), np.concatenate(units)
                docs, units, waiting = [], [], 0
        G.give_back()
    if waiting:
        yield np.concatenate(docs), np.concatenate(units)
    G.give_back(True)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _once(doc: np.ndarray, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows by key, those of one document and key once."""
    by = np.argsort(key)
    ranked = key[by]
    same = np.zeros(len(by), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    few = by[twice]  # only keys that come again need their documents in order
    by[twice] = few = few[np.lexsort((doc[few], key[few]))]
    again = np.zeros(len(few), bool)
    again[1:] = (key[few[1:]] == key[few[:-1]]) & (doc[few[1:]] == doc[few[:-1]])
    drop = np.zeros(len(by), bool)
    drop[np.flatnonzero(twice)[again]] = True
    by = by[~drop]
    return doc[by], unit[by], key[by]


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, how many rows it has, and whether they are of several documents."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return first, np.diff(np.append(first, len(key))), several


def _packets(buckets: int):
    """Units as packets: those that several of the gathered documents have are links already (buckets below 0) and go to their bucket once, without a document; the others go there to be compared."""

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, unit in _units(batches):
            doc, unit, key = _once(doc, unit, G.mix(unit.view(np.uint64)))
            first, size, several = _runs(doc, key)
            shared = np.repeat(several, size)
            known, known_key = unit[first[several]], key[first[several]]
            rows = {"bucket": [-1 - int(key[0] % np.uint64(buckets))], "docs": [doc[shared].tobytes()], "links": [unit[shared].tobytes()], "known": [b""]}
            doc, unit, key = doc[~shared], unit[~shared], key[~shared]
            every = np.arange(buckets + 1, dtype=np.uint64)
            cut, known_cut = (np.searchsorted(_bucket(k, buckets), every) for k in (key, known_key))
            for b in np.flatnonzero(np.diff(cut) + np.diff(known_cut)).tolist():
                own = slice(cut[b], cut[b + 1])
                for name, value in (("bucket", b), ("docs", doc[own].tobytes()), ("links", unit[own].tobytes()), ("known", known[known_cut[b] : known_cut[b + 1]].tobytes())):
                    rows[name].append(value)
            del key, shared
            yield pa.RecordBatch.from_pydict(rows, schema=_SENT)
            del doc, unit, known, rows
            G.give_back()

    return packets


def _common(table: pa.Table) -> pa.Table:
    """(doc_id, link) of a bucket's units that several documents have."""
    doc, link, known = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("docs", "links", "known"))
    if table["bucket"][0].as_py() >= 0:
        by = np.argsort(link)
        doc, link = doc[by], link[by]
        first, size, several = _runs(doc, link)
        keep = np.repeat(several | np.isin(link[first], known), size)
        doc, link = doc[keep], link[keep]
        G.give_back()
    return pa.table([doc, link], schema=UNITS)


def _chars(docs: DataFrame) -> int:
    """Characters of the texts, to plan buckets by: three a byte of the files that are read, or counted where there are none."""
    files = docs.inputFiles()
    if not files:
        return docs.agg(F.sum(F.length("text"))).first()[0] or 0
    context = docs.sparkSession.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    return 3 * sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def links(docs: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, link, weight, k): sentences of `least` characters or more, winnowed n-grams and whole texts that several documents share."""
    small_batches(docs.sparkSession)
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    long = lambda s: F.length(s) >= least
    sentence = F.filter(F.transform(F.filter(F.split("text", r"[.!?\n\r]+"), long), lambda s: F.trim(s)), long)
    norm = slim.select("doc_id", "text", F.when(F.expr(r"text rlike '\\S'"), G.normalised(F.col("text"))).alias("norm"), F.transform(sentence, lambda s: F.xxhash64(s)).alias("sentences"))
    whole = F.when(F.col("norm") != "", F.xxhash64("norm")).when(F.col("norm") == "", F.xxhash64("text"))
    buckets = max(4, math.ceil(_chars(slim) / CHARS / PER_BUCKET))
    sent = norm.select("doc_id", "norm", whole.alias("whole"), "sentences").mapInArrow(_packets(buckets), "bucket long, docs binary, links binary, known binary")
    has = sent.groupBy("bucket").applyInArrow(_common, "doc_id bigint, link bigint")
    twice = repeated_ids(slim)
    if twice is not None:  # several rows of one document may have the same unit; documents of one row can't
        has = saved(has, "shard-rows")
        has = semi(has, twice, "left_anti").unionByName(semi(has, twice).distinct())
    has = saved(has, "shard-units")
    by = has.groupBy("link").agg(F.count("*").alias("k"), F.sum(F.xxhash64("doc_id") % (1 << 40)).alias("sig"), F.bit_xor(F.xxhash64(F.col("doc_id") + 1)).alias("sig2")).where("k > 1")
    alike = by.groupBy("k", "sig", "sig2").agg(F.min("link").alias("link"), F.count("*").alias("times"))
    out = saved(has.join(alike.select("link", (F.col("times") / (F.col("k") - 1)).alias("weight"), "k"), "link").select("doc_id", "link", "weight", "k"), "shard-links")
    dropped(has)
    return out


def _quotas(wishes: dict[tuple[int, int], int], size: list[int], cap: int) -> dict[tuple[int, int], int]:
    """How many may go from i to j: as many as come the other way, then into what room j has."""
    room = [cap - s for s in size]
    out = {(i, j): min(w, wishes.get((j, i), 0)) for (i, j), w in wishes.items()}
    for (i, j), w in sorted(wishes.items()):
        more = max(0, min(w - out[i, j], room[j]))
        out[i, j] += more
        room[j] -= more
    return {k: v for k, v in out.items() if v}


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _level(sizes: list[int], free: int) -> list[int]:
    """Rows to add to each shard so that the smallest ones are filled up evenly."""
    add = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda s: (sizes[s], s))
    for n in range(len(order), 0, -1):
        low = order[:n]
        level, extra = divmod(sum(sizes[s] for s in low) + free, n)
        if level >= sizes[low[-1]]:
            for k, s in enumerate(low):
                add[s] = level + (k < extra) - sizes[s]
            break
    return add


def _sub() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SUB)).cast("int")


def _upto(counts: list[tuple[int, int]], most: int) -> tuple[int | None, int]:
    """Of (bin, size) the first bin, in ascending order, that `most` can't hold whole (None if there is none), and what is left for it."""
    for k, n in sorted(counts):
        if n > most:
            return k, most
        most -= n
    return None, most


def _by(rows: list, keys: int) -> dict[tuple, list]:
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault(tuple(r[:keys]), []).append((r[keys], r[keys + 1]))
    return out


def _granted(wish: DataFrame, quota: dict[tuple[int, int], int]) -> DataFrame:
    """(doc_id, to) of the wishes (doc_id, size, own, to, gain) of greatest gain that the quotas hold; of about equal gains a hash of the doc_id decides."""
    spark = wish.sparkSession
    binned = wish.withColumns({"bin": F.floor(-8 * F.log2("gain")).cast("int"), "sub": _sub()})
    counts = _by(binned.groupBy("own", "to", "bin").agg(F.sum("size")).collect(), 2)
    edge = {k: _upto(counts[k], q) for k, q in quota.items() if k in counts}
    rows = [(i, j, b, rest) for (i, j), (b, rest) in edge.items() if b is not None]
    last = binned.join(_table(spark, rows, "own int, to int, bin int, rest long"), ["own", "to", "bin"])
    fine = _by(last.groupBy("own", "to", "sub").agg(F.sum("size")).collect(), 2)
    limit = []
    for (i, j), (b, rest) in edge.items():
        sub = _upto(fine.get((i, j), []), rest)[0]
        limit.append((i, j, 1 << 30 if b is None else b, SUB if sub is None else sub))
    met = binned.join(_table(spark, limit, "own int, to int, last int, upto int"), ["own", "to"])
    return met.where("bin < last or (bin = last and sub < upto)").select("doc_id", "to")


def _wishes(own: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, own, to, gain) of documents for which another shard has more weight than their own.

    Up to WIDE shards a link's counts are columns, so that a link with documents
    in every shard makes one row a document, not one a document and shard.
    """
    if shards <= WIDE:
        count = own.groupBy("link").agg(*(F.expr(f"sum(if(own = {s}, size, 0L)) as c{s}") for s in range(shards)))
        score = own.join(count, "link").groupBy("doc_id", "size", "own").agg(*(F.expr(f"round(sum(weight * (c{s} - if(own = {s}, size, 0L))), 9) as s{s}") for s in range(shards)))
        rows = score.select("doc_id", "size", "own", F.expr(f"array_max(array({', '.join(f'struct(s{s} as score, own = {s} as stay, {-s} as neg)' for s in range(shards))})) as best"), F.expr(f"element_at(array({', '.join(f's{s}' for s in range(shards))}), own + 1) as now"))
    else:
        count = own.groupBy("link", F.col("own").alias("shard")).agg(F.sum("size").alias("c"))
        score = own.join(count, "link").groupBy("doc_id", "size", "own", "shard").agg(F.sum(F.col("weight") * (F.col("c") - F.when(F.col("shard") == F.col("own"), F.col("size")).otherwise(0))).alias("score"))
        rows = score.groupBy("doc_id", "size", "own").agg(F.max(F.struct(F.round("score", 9).alias("score"), (F.col("shard") == F.col("own")).alias("stay"), (-F.col("shard")).alias("neg"))).alias("best"), F.max(F.when(F.col("shard") == F.col("own"), F.round("score", 9))).alias("now"))
    return rows.where("not best.stay").select("doc_id", "size", "own", (-F.col("best.neg")).alias("to"), (F.col("best.score") - F.coalesce("now", F.lit(0.0))).alias("gain")).where("gain > 0")


def _fill(nodes: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, size) placed in shards, by number, so that all shards end as even as they can."""
    spark = nodes.sparkSession
    buckets = max(64, -(-nodes.count() // NUMBERED))
    bucket = nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    totals = dict(bucket.groupBy("bucket").agg(F.sum("size")).collect())
    before, offset = 0, []
    for b in sorted(totals):
        offset.append((b, before))
        before += totals[b]
    if not before:
        return nodes.select("doc_id", "size", F.lit(0).alias("shard")).limit(0)
    bounds, upto = [], 0
    for s, n in enumerate(_level(sizes, before)):
        if n:
            bounds.append((s, upto, upto + n))
            upto += n
    row = Window.partitionBy("bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = bucket.withColumn("at", F.coalesce(F.sum("size").over(row), F.lit(0))).join(_table(spark, offset, "bucket long, offset long"), "bucket").withColumn("at", F.col("at") + F.col("offset"))
    starts = F.array(*(F.lit(a) for _, a, _ in bounds))
    shard = F.element_at(F.array(*(F.lit(s) for s, _, _ in bounds)), F.size(F.filter(starts, lambda a: a <= F.col("at"))))
    return at.select("doc_id", "size", shard.alias("shard"))


def assignment(docs: DataFrame, shards: int = 16, rounds: int = 50, slack: float = 0.02, least: int = 40, settled: float = 0.001) -> DataFrame:
    """(doc_id bigint, shard int, linked boolean) for every distinct doc_id that isn't null.

    Rows that repeat a doc_id go to one shard together and count as many as
    they are.  A shard has at most (1 + slack) * rows / shards rows, unless the
    rows of one doc_id alone are more; whatever links leave over is evened out
    by the documents without links.  Null and empty texts have no links.

    `least` is the number of characters from which on an equal sentence is a
    link of its own; runs of 32 words and whole texts are links at any length.
    Rounds end when all wishes left would gain the share `settled` of all links'
    weight or less, or when in three rounds in a row that gain hasn't shrunk by
    a hundredth; `rounds` is only a bound in case that neither happens.

    Ties: of shards of equal weight a document prefers its own, then the lowest;
    of about equal gains a hash of the doc_id decides.  An empty table gives no
    rows; extra columns are ignored.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    spark = docs.sparkSession
    link = links(docs, least)
    counted = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("size"))
    # the least hash of a document's links is the same for two documents as often as they share their links, so most copies start together
    anchor = link.groupBy("doc_id").agg(F.min(F.xxhash64("link")).alias("a")).select("doc_id", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("first"))
    nodes = saved(counted.join(anchor, "doc_id", "left"), "shard-nodes")
    cap = -(-int((nodes.agg(F.sum("size")).first()[0] or 0) * (1 + slack)) // shards)

    def sizes(df: DataFrame) -> list[int]:
        found = dict(df.groupBy("shard").agg(F.sum("size")).collect())
        return [found.get(s, 0) for s in range(shards)]

    def within(df: DataFrame) -> DataFrame:
        """What goes beyond a shard's capacity moves to where there is room."""
        if max(sizes(df)) <= cap:
            return df
        counts = _by(df.groupBy("shard", _sub().alias("sub")).agg(F.sum("size")).collect(), 1)
        limit = [(s, SUB if k is None else k) for (s,), (k, _) in ((x, _upto(n, cap)) for x, n in counts.items())]
        ranked = saved(df.join(_table(spark, limit, "shard int, upto int"), "shard"), "shard-over")
        stay = ranked.where(_sub() < F.col("upto")).select("doc_id", "size", "shard")
        out = saved(stay.unionByName(_fill(ranked.where(_sub() >= F.col("upto")).select("doc_id", "size"), sizes(stay))), "shard-within")
        dropped(ranked)
        return out

    labels = within(saved(nodes.where("first is not null").select("doc_id", "size", F.col("first").alias("shard")), "shard-labels"))
    own = saved(link.join(labels, "doc_id").select("doc_id", "link", "weight", "size", F.col("shard").alias("own")), "shard-own")
    whole = link.agg(F.sum(F.col("weight") * (F.col("k") - 1))).first()[0] or 0.0
    dropped(link)
    lowest, stalled = math.inf, 0
    for number in range(rounds):
        wish = saved(_wishes(own, shards), "shard-wishes")
        acts = F.pmod(F.xxhash64("doc_id", F.lit(number)), F.lit(2)) == 0
        rows = wish.groupBy("own", "to").agg(F.sum(F.when(acts, F.col("size"))).alias("now"), F.sum("gain").alias("gain")).collect()
        gain = sum(r.gain for r in rows)
        stalled = stalled + 1 if gain > 0.99 * lowest else 0
        lowest = min(lowest, gain)
        if gain <= settled * whole or stalled == 3:
            dropped(wish)
            break
        quota = _quotas({(r.own, r.to): r.now for r in rows if r.now}, sizes(labels), cap)
        if quota:
            moved = saved(_granted(wish.where(acts), quota), "shard-moves")
            to = F.broadcast(moved) if small_enough(moved, 4_000_000) else moved
            now = [saved(df.join(to, "doc_id", "left").withColumn(c, F.coalesce("to", c)).drop("to"), "shard-labels") for df, c in ((labels, "shard"), (own, "own"))]
            dropped(labels, own, moved)
            labels, own = now
        dropped(wish)
    linked = within(labels)
    rest = _fill(nodes.where("first is null").select("doc_id", "size"), sizes(linked))
    out = saved(linked.select("doc_id", "shard", F.lit(True).alias("linked")).unionByName(rest.select("doc_id", F.col("shard").cast("int").alias("shard"), F.lit(False).alias("linked"))), "shards")
    dropped(own, nodes, labels, linked)
    return out


def sharded(docs: DataFrame, **how) -> DataFrame:
    """`docs` with their shard in the column `shard` (one of that name is replaced).

    Rows without a doc_id have no links; they are spread by a hash of their
    place in the table, so each shard gets about as many of them, equal rows or
    not, but for chance.
    Up to four million ids are broadcast; beyond that the join is shuffled.
    """
    shards = how.get("shards", 16)
    at = assignment(docs, **how).select(F.col("doc_id").alias("shard_doc_id"), F.col("shard").alias("shard_found"))
    at = F.broadcast(at) if small_enough(at, 4_000_000) else at
    kept, back = aside(docs.drop("shard"), "shard_doc_id", "shard_found")
    joined = kept.join(at, kept["doc_id"].cast("bigint") == at["shard_doc_id"], "left")
    return joined.withColumn("shard", F.coalesce("shard_found", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))).drop("shard_doc_id", "shard_found").transform(back)

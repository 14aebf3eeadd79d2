"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Method (exact; nothing is sampled or capped):

1. *Screen.*  Two documents whose word n-gram sets have Jaccard >= t share at
   least ceil(t*|x|) of x's n-grams, so a document of whose n-grams fewer are
   found in any other document has no partner.  N-grams travel as packed 32-bit
   keys to hash buckets; one that a task has met in several of its documents is
   sent once, without an owner, so no n-gram has more keys than there are
   packets.  Keys that collide can only keep a document that would have been
   dropped.
2. *Classes.*  Documents with equal n-gram sets are one class; the smallest id
   stands for it.
3. *Order.*  The representatives' n-grams are kept as blocks.  A block asks the
   buckets of the hash space for the frequency of each of its distinct n-grams
   and gets one byte for each: exact up to 32, by steps of an eighth of a power
   of two beyond.  N-grams are ordered by that byte, then by hash, so rarest
   first and alike in every document.  Those of frequency 1 are never joined.
4. *Prefix filter.*  Only prefixes of |x| - ceil(t*|x|) + 1 n-grams are joined.  A
   run of n-grams common to two prefixes makes one row, at its first n-gram.
   The length filter and the positional filter act on each such meeting.
5. *Verification.*  Pairs are grouped in cells by a neighbour's id, each cell is
   given its documents once, the suffix filter drops pairs by counting on either
   side of the suffix's middle, and the rest are counted exactly, once a pair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textgrams as G
from lodestone.llm.common import dropped, one_row_per_id, saved, semi, small_batches

#: N-grams gathered in a task before they are sent off in packets, or make a block.
FLUSH = 1_500_000
#: N-grams for which a bucket is planned.
PER_BUCKET = 1_500_000
#: Documents of one verification cell's row or column.
BLOCK = 512
#: N-grams of one verification cell's documents, about; some 60 bytes each are held.
CELL_GRAMS = 4_000_000

_SENT = pa.schema([("bucket", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_SCREENED = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("shared", pa.int64())])
_ORDERED = pa.schema([("doc_id", pa.int64()), ("m", pa.int32()), ("u", pa.int32()), ("rank", pa.binary()), ("gram", pa.binary())])


def need(m: np.ndarray | int, t: float):
    """ceil(t*m), with room for the rounding of t*m."""
    return np.ceil(np.asarray(m) * t - 1e-9).astype(np.int64)


def _doc_grams(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    word, start = G.words(batch.column("norm"))
    return G.distinct(*G.grams(word, start, n))


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Doc ids, sizes and distinct n-grams of a task's documents, FLUSH n-grams or so at once."""
    grams, sizes, ids, waiting = [], [], [], 0
    for batch in batches:
        for part in G.pieces(batch):
            h, at = _doc_grams(part, n)
            grams.append(h), sizes.append(np.diff(at)), ids.append(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
            waiting += len(h)
            if waiting >= FLUSH:
                yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(grams)
                grams, sizes, ids, waiting = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(grams)
    G.give_back(True)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _repeated(ranked: np.ndarray) -> np.ndarray:
    """Which of sorted values aren't the only ones of their kind."""
    twice = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] = same
    twice[:-1] |= same
    return twice


def _summed(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `size` values, some of which may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _send(n: int, buckets: int):
    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, size, h in _gathered(batches, n):
            starts = np.cumsum(size) - size
            full = size > 0
            sig_a, sig_b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(h):
                sig_a[full] = np.add.reduceat(G.mix(h + np.uint64(1)), starts[full])
                sig_b[full] = np.add.reduceat(G.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts[full])
            by = np.argsort(h)
            repeated = _repeated(h[by])
            twice = np.zeros(len(h), bool)
            twice[by] = repeated
            known = np.unique(h[by][repeated])
            about = np.column_stack((size, sig_a.view(np.int64), sig_b.view(np.int64), _summed(twice, size)))
            owner = np.repeat(np.arange(len(size)), size)[~twice]
            h = h[~twice]
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            owner, keys = owner[order], (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
            every = np.arange(buckets + 1, dtype=np.uint64)
            cut, known_cut = np.searchsorted(bucket[order], every), np.searchsorted(_bucket(known, buckets), every)
            del by, repeated, twice, h, bucket, order
            rows = {"bucket": [-1 - int(abs(int(doc[0])) % buckets)], "doc_ids": [doc.tobytes()], "counts": [b""], "keys": [np.ascontiguousarray(about.T).tobytes()]}
            for b in np.flatnonzero(np.diff(cut) + np.diff(known_cut)).tolist():
                own = owner[cut[b] : cut[b + 1]]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                rows["bucket"].append(b)
                rows["doc_ids"].append(doc[own[first]].tobytes())
                rows["counts"].append(np.diff(np.append(first, len(own))).astype(np.uint32).tobytes())
                free = (known[known_cut[b] : known_cut[b + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows["keys"].append(keys[cut[b] : cut[b + 1]].tobytes() + free.tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=_SENT)
            del owner, keys, known, rows
            G.give_back()

    return packets


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's documents: how many of the n-grams that they own another document has too."""
    if table["bucket"][0].as_py() < 0:
        out = []
        for ids, about in zip(table["doc_ids"], table["keys"]):
            doc = np.frombuffer(ids.as_buffer(), np.int64)
            out.append(pa.table([doc, *np.frombuffer(about.as_buffer(), np.int64).reshape(4, -1)], schema=_SCREENED))
        return pa.concat_tables(out)
    keys, doc, size = [], [], []
    for ids, counts, sent in zip(table["doc_ids"], table["counts"], table["keys"]):
        k, s = np.frombuffer(sent.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        d, free = np.frombuffer(ids.as_buffer(), np.int64), len(k) - int(s.sum())
        keys.append(k), doc.append(d), size.append(s)
        if free:  # n-grams without an owner are known to be shared: they count twice, for no document
            keys.append(k[len(k) - free :]), doc.append(np.zeros(2, np.int64)), size.append(np.full(2, -free))
    doc, size, keys = np.concatenate(doc), np.concatenate(size), np.concatenate(keys)
    order = np.argsort(keys)
    twice = np.zeros(len(keys), bool)
    twice[order] = _repeated(keys[order])
    shared = _summed(twice, np.abs(size))
    keep = (shared > 0) & (size > 0)
    none = pa.nulls(int(keep.sum()), pa.int64())
    del keys, order, twice
    G.give_back()
    return pa.table([pa.array(doc[keep]), none, none, none, pa.array(shared[keep])], schema=_SCREENED)


def _blocks(n: int):
    """Documents' n-grams as blocks (block, doc_ids, sizes, grams), each document's in ascending order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, size, h in _gathered(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([doc.tobytes()]), pa.array([size.astype(np.int64).tobytes()]), pa.array([h.tobytes()], pa.binary())], ["block", "doc_ids", "sizes", "grams"])
            G.give_back()

    return blocks


def _ask(buckets: int):
    """A block's distinct n-grams and how many of its documents have each, as one packet a bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, grams in zip(batch.column("block").to_pylist(), batch.column("grams")):
                distinct, count = np.unique(np.frombuffer(grams.as_buffer(), np.uint64), return_counts=True)
                cut = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1, dtype=np.uint64))
                names = np.flatnonzero(np.diff(cut)).tolist()
                bodies = [G.pack(np.diff(distinct[cut[b] : cut[b + 1]], prepend=np.uint64(0)), count[cut[b] : cut[b + 1]]) for b in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    return ask


def rarity(df: np.ndarray) -> np.ndarray:
    """The frequency as a byte that rises with it: exact up to 32, by eighths of powers of two beyond."""
    return np.where(df <= 32, df, np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1))) - 7)).astype(np.uint8)


def _frequency(table: pa.Table) -> pa.Table:
    """A bucket's answers: to each block the rarity of what it asked for, in the same order."""
    keys, counts = [], []
    for body in table["body"]:
        delta, count = G.unpack(body.as_py())
        keys.append(np.cumsum(delta, dtype=np.uint64)), counts.append(count.astype(np.int64))
    size = [len(k) for k in keys]
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    df = np.empty(len(key), np.int64)
    df[order] = np.add.reduceat(count[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    byte, at, bodies = rarity(df), 0, []
    for s in size:
        bodies.append(pa.Codec("zstd", compression_level=1).compress(byte[at : at + s].tobytes(), asbytes=True))
        at += s
    G.give_back()
    return pa.table([table["block"], table["bucket"], pa.array(size, pa.int64()), pa.array(bodies, pa.binary())], names=["to_block", "bucket", "n", "body"])


def _order(t: float):
    """Documents with a prefix to join: their n-grams that others have, rarest first, and how many others lack (u)."""

    def order(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows:
            by = np.argsort(answers["bucket"].to_numpy())
            size = answers["n"].to_numpy()
            byte = np.concatenate([np.frombuffer(pa.Codec("zstd").decompress(answers["body"][int(i)].as_py(), int(size[i])), np.uint8) for i in by]) if len(by) else np.zeros(0, np.uint8)
            h = np.frombuffer(block["grams"][0].as_buffer(), np.uint64)
            doc, many = (np.frombuffer(block[c][0].as_buffer(), np.int64) for c in ("doc_ids", "sizes"))
            rank = byte[np.searchsorted(np.unique(h), h)]
            ends = np.cumsum(many)
            for d, m, end in zip(doc.tolist(), many.tolist(), ends.tolist()):
                r, g = rank[end - m : end], h[end - m : end]
                inside = np.flatnonzero(r > 1)
                if len(inside) >= int(need(m, t)):
                    inside = inside[np.argsort(r[inside], kind="stable")]
                    rows.append((d, m, m - len(inside), r[inside].tobytes(), g[inside].tobytes()))
            del h, rank, byte
            G.give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ORDERED)], schema=_ORDERED) if rows else _ORDERED.empty_table()

    return order


def _prefixes(t: float):
    """A row for each n-gram of the prefixes: (gram, doc_id, m, k, pos, prev), k its place among those that others have, prev the one before."""
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("m", pa.int32()), ("k", pa.int32()), ("pos", pa.int32()), ("prev", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, u = (batch.column(c).to_numpy() for c in ("m", "u"))
            p = np.maximum(m - need(m, t) + 1 - u, 0)
            gram = [np.frombuffer(g.as_buffer(), np.int64)[:k] for g, k in zip(batch.column("gram"), p.tolist())]
            prev = [np.concatenate((np.zeros(min(1, len(g)), np.int64), g[:-1])) for g in gram]
            k = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            many = lambda x: np.repeat(x, p)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.concatenate(gram or [[]]), many(batch.column("doc_id").to_numpy()), many(m), k, many(u) + k, np.concatenate(prev or [[]])), schema)], schema=schema)

    return prefixes


def _verify(t: float):
    """Exact Jaccard of a cell's pairs."""
    out = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("jaccard", pa.float64())])

    def cell(key, pairs: pa.Table, docs: pa.Table) -> pa.Table:
        ids = docs["doc_id"].to_numpy()
        m = docs["m"].to_numpy().astype(np.int64)
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in docs["gram"]]
        size = np.array([len(g) for g in grams], np.int64)
        start = np.cumsum(size) - size
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        _, code = np.unique(flat, return_inverse=True)
        # along the global order, for counting on either side of the middle; equal for n-grams of equal rarity and high bits
        rank = (np.concatenate([np.frombuffer(r.as_buffer(), np.uint8) for r in docs["rank"]]).astype(np.uint64) << np.uint64(56)) | (flat >> np.uint64(8)) if grams else flat
        by = np.argsort(ids)
        x, y = (by[np.searchsorted(ids[by], pairs[c].to_numpy())] for c in "xy")
        least = np.ceil(t / (1 + t) * (m[x] + m[y]) - 1e-9).astype(np.int64)
        middle = rank[start + size // 2]
        before = np.array([np.searchsorted(rank[a : a + n], q) for a, n, q in zip(start.tolist(), size.tolist(), middle)], np.int64)
        order = np.lexsort((y, x))
        x, y, least = x[order], y[order], least[order]
        mark = np.zeros(len(flat), bool)
        a, b, jac = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            i, others, want = int(x[lo]), y[lo:hi], least[lo:hi]
            left_x, left_y = np.searchsorted(rank[start[i] : start[i] + size[i]], middle[others]), before[others]
            live = np.minimum(left_x, left_y) + np.minimum(size[i] - left_x, size[others] - left_y) >= want
            others = others[live]
            if not len(others):
                continue
            own = code[start[i] : start[i] + size[i]]
            mark[own] = True
            at = np.repeat(start[others] - (np.cumsum(size[others]) - size[others]), size[others]) + np.arange(size[others].sum())
            common = _summed(mark[code[at]], size[others])
            mark[own] = False
            j = common / (m[i] + m[others] - common)
            ok = j >= t - 1e-12
            a.append(np.minimum(ids[i], ids[others[ok]])), b.append(np.maximum(ids[i], ids[others[ok]])), jac.append(j[ok])
        del flat, code, rank, mark, grams
        G.give_back()
        return pa.table([np.concatenate(a), np.concatenate(b), np.concatenate(jac)], schema=out)

    return cell


def _cells(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (x, y) in cells (cell, i, j): by the least id that either is paired with, cut into as many parts as its pairs and its documents' n-grams ask for."""
    near = F.least("x", "y")
    label = pairs.select(F.explode(F.array("x", "y")).alias("doc_id"), near.alias("low")).groupBy("doc_id").agg(F.min("low").alias("cell"))
    celled = pairs.join(label.withColumnRenamed("doc_id", "x"), "x")
    crowd = celled.groupBy("cell").agg(F.count("*").alias("n_pairs"))
    there = celled.select("cell", F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    load = there.join(docs.select("doc_id", (F.col("m") - F.col("u")).alias("size")), "doc_id").groupBy("cell").agg(F.sum("size").alias("grams"))
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_pairs").cast("double")) / BLOCK), F.ceil(2 * F.col("grams") / CELL_GRAMS))
    return celled.join(crowd.join(load, "cell"), "cell").withColumn("parts", parts).select("cell", F.expr("pmod(xxhash64(x), parts)").alias("i"), F.expr("pmod(xxhash64(y), parts)").alias("j"), "x", "y")


def _classes(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """Saved tables: links (doc_a, doc_b, jaccard) between different n-gram sets, by their smallest ids, and members (doc_id, rep) of sets that several documents have, but their smallest ids."""
    small_batches(docs.sparkSession)
    unique = one_row_per_id(docs)
    norm = unique.select("doc_id", G.normalised(F.col("text")).alias("norm")).where("norm != ''")
    total = unique.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4, math.ceil(total / 6.5 / PER_BUCKET))
    sent = norm.mapInArrow(_send(n, buckets), "bucket long, doc_ids binary, counts binary, keys binary")
    parts = sent.groupBy("bucket").applyInArrow(_shared, "doc_id long, m long, sig_a long, sig_b long, shared long")
    screened = parts.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("m", "sig_a", "sig_b")), F.sum("shared").alias("shared"))
    screened = saved(screened.where(F.col("shared") >= F.ceil(F.col("m") * t - 1e-9)).select("doc_id", "m", "sig_a", "sig_b"), "jaccard-screen")
    sets = screened.groupBy("sig_a", "sig_b", "m").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    equal = saved(screened.join(sets.where("n > 1"), ["sig_a", "sig_b", "m"]).where("doc_id != rep").select("doc_id", "rep"), "jaccard-equal")
    grams = sets.agg(F.sum("m")).first()[0] or 0

    left = semi(unique, sets.select(F.col("rep").alias("doc_id"))).select("doc_id", G.normalised(F.col("text")).alias("norm"))
    blocks = saved(left.mapInArrow(_blocks(n), "block long, doc_ids binary, sizes binary, grams binary"), "jaccard-blocks")
    dropped(screened)
    asked = blocks.select("block", "grams").mapInArrow(_ask(max(4, math.ceil(grams / PER_BUCKET))), "bucket long, block long, body binary")
    answers = asked.groupBy("bucket").applyInArrow(_frequency, "to_block long, bucket long, n long, body binary")
    ordered = blocks.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(_order(t), "doc_id long, m int, u int, rank binary, gram binary")
    ordered = saved(ordered, "jaccard-ordered")
    dropped(blocks)

    entry = ordered.select("doc_id", "m", "u", "gram").mapInArrow(_prefixes(t), "gram long, doc_id long, m int, k int, pos int, prev long")
    a, b = (entry.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "m", "k", "pos", "prev"))) for s in "xy")
    met = a.join(b, "gram").where("struct(m_x, doc_id_x) < struct(m_y, doc_id_y)").where(F.col("m_x") >= F.col("m_y") * t - 1e-9).where("k_x = 0 or k_y = 0 or prev_x != prev_y")
    bound = F.least("k_x", "k_y") + 1 + F.least(F.col("m_x") - F.col("pos_x") - 1, F.col("m_y") - F.col("pos_y") - 1)
    met = met.where(bound >= F.ceil(t / (1 + t) * (F.col("m_x") + F.col("m_y")) - 1e-9))
    pairs = saved(met.select(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y")).distinct(), "jaccard-pairs")

    celled = _cells(pairs, ordered)
    celled = saved(celled, "jaccard-cells")
    dropped(pairs)
    wanted = celled.select(F.col("cell").alias("to_cell"), F.col("i").alias("to_i"), F.col("j").alias("to_j"), F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    brought = wanted.join(ordered.select("doc_id", "m", "rank", "gram"), "doc_id")
    checked = celled.groupBy("cell", "i", "j").cogroup(brought.groupBy("to_cell", "to_i", "to_j")).applyInArrow(_verify(t), "doc_a long, doc_b long, jaccard double")
    found = saved(checked, "jaccard-links")
    dropped(ordered, celled)
    return found, equal


def jaccard_join(docs: DataFrame, n: int = 3, t: float = 0.6) -> DataFrame:
    """All links of documents whose sets of word n-grams have Jaccard similarity >= t.

    Returns (doc_a bigint, doc_b bigint, jaccard double, same_set boolean) with
    doc_a < doc_b.  Documents with equal sets are linked to the smallest id of
    their class (jaccard 1.0, same_set true); every two classes at or above t
    are linked once, by their smallest ids (same_set false).  Thus the pairs of
    the full join are the members of linked classes crossed, and the result
    doesn't grow with the square of the number of exact copies.

    A text of fewer than n words has one n-gram, all its words; a text without
    words (null, empty, punctuation alone) has none and joins nothing.  Rows
    with a null doc_id are left out.  The distinct texts of rows that share an
    id are taken as one document.  Equal similarity needs no tie-break, since
    all pairs are returned.  An empty table gives an empty result; extra
    columns are ignored.
    """
    found, equal = _classes(docs, n, t)
    copies = equal.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("same_set"))
    return found.withColumn("same_set", F.lit(False)).unionByName(copies)


def linked(docs: DataFrame, n: int = 3, t: float = 0.6) -> DataFrame:
    """(doc_id bigint, class_id bigint, n_links bigint) for every document that `jaccard_join` links to another.

    n_links is the number of other documents whose n-gram sets have Jaccard
    similarity >= t with this one's, copies included; class_id is the smallest
    doc_id that links lead to from here, over however many steps.  Every link is
    found and counted, none is written out, so the result has at most a row a
    document.  A document without a link has no row.  Nulls, empty texts,
    repeated ids, empty tables and extra columns are as in `jaccard_join`.
    """
    found, equal = _classes(docs, n, t)
    size = equal.groupBy("rep").agg((F.count("*") + 1).alias("copies"))
    both = found.select("doc_a", "doc_b").unionByName(found.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b")))
    near = both.join(size.select(F.col("rep").alias("doc_b"), "copies"), "doc_b", "left").groupBy("doc_a").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("near"))
    group = groups(found)
    top = near.select(F.col("doc_a").alias("rep"), "near").join(size, "rep", "full").join(group.withColumnRenamed("doc_id", "rep"), "rep", "left")
    top = top.select("rep", F.coalesce("group_id", "rep").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    top = saved(top, "jaccard-top")
    out = top.withColumnRenamed("rep", "doc_id").unionByName(equal.join(top, "rep").select("doc_id", "class_id", "n_links"))
    out = saved(out, "jaccard-linked")
    dropped(found, equal, group, top)
    return out


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) for every document in `pairs` (doc_a, doc_b): group_id is the smallest doc_id it is connected to.

    By contraction: every node goes over into the neighbour (or itself) of least
    hash, which leaves a graph of those alone, until no edge is left.  In random
    order this takes about as many rounds as the logarithm of the nodes, however
    long paths are; each is written to the shared folder.  Pairs with a null end
    or of a document with itself are ignored.
    """
    edges = pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("doc_a is not null and doc_b is not null and u != v")
    edges, steps = saved(edges.distinct(), "groups-edges"), []
    while not steps or not edges.isEmpty():
        key = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = saved(both.groupBy("u").agg(F.min(key("v")).alias("best")).select(F.col("u").alias("node"), F.least(key("u"), F.col("best"))["to"].alias("to")), "groups-step")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "uv")
        met = edges.join(left, "u").join(right, "v").where("to_u != to_v")
        after = saved(met.select(F.greatest("to_u", "to_v").alias("u"), F.least("to_u", "to_v").alias("v")).distinct(), "groups-edges")
        dropped(edges)
        edges = after
    label = steps[-1]
    for step in steps[-2::-1]:
        label = step.join(label.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    least = label.groupBy("to").agg(F.min("node").alias("group_id"))
    out = saved(label.join(least, "to").select(F.col("node").alias("doc_id"), "group_id"), "groups")
    dropped(edges, *steps)
    return out

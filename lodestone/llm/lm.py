"""Language-model scores by deleted interpolation.

A word's probability after u v is a mixture of maximum-likelihood estimates,

    l3 * c(uvw)/c(uv) + l2 * c(vw)/c(v) + l1 * c(w)/N + l0 / (V + 1),

with weights for each bucket of context frequency: by powers of two of c(uv),
or of c(v) where u v is unseen.  The weights of each bucket are learned by
expectation-maximisation on held-out counts: events of every HELD-th document,
by a hash of its id and text, under counts from all other documents.  To score
a document, counts are taken over all documents but itself; its own are deleted.

Counting: a task gathers its documents into blocks of word codes, which are
kept.  A block sends each bucket of the n-gram hash space its distinct n-grams
with their counts, as one packed row; the bucket adds up and answers with
totals in the same order, so a block can put them back in place.  Texts are
read once and never shuffled.  Vocabulary and counts never pass through the
driver; only the buckets' weights do.

For the weights, held-out events are added up in cells: those of one context
bucket whose estimates agree to half a power of two.  A cell stands for its
events by the mean of each estimate, so the number of cells is bounded whatever
the corpus, and the means leave out only what estimates vary within a cell.
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
from lodestone.llm.common import dropped, saved, small_batches

#: Words of a block, and distinct n-grams planned for a bucket.
BLOCK, PER_BUCKET = 1_000_000, 1_200_000
#: One document of so many is held out for the weights.
HELD = 10
#: Bits of a hash that are told apart within a bucket.
KEY_BITS = 42
ROUNDS, FLOOR = 60, 1e-4

_END = np.uint64(0x8F1BBCDC5A827999)
_BLOCK = "block long, held boolean, body binary"
_PACKET = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("held", pa.bool_()), ("body", pa.binary())])
_SUMS = ("v", "n", "v_train", "n_train")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held, norm) as packed blocks of ids, sizes and coded words; held-out ones in blocks of their own."""
    waiting: dict[bool, list] = {False: [], True: []}

    def row(held: bool) -> pa.RecordBatch:
        ids, null, size, word = (np.concatenate(x) for x in zip(*waiting[held]))
        waiting[held] = []
        known, code = np.unique(word, return_inverse=True)
        body = G.pack(ids.view(np.uint64), null.astype(np.uint64), size, known, code)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([held]), pa.array([body], pa.binary())], ["block", "held", "body"])

    for batch in batches:
        for part in G.pieces(batch):
            word, start = G.words(part.column("norm"))
            size, flag = np.diff(start), part.column("held").to_numpy(zero_copy_only=False).astype(bool)
            ids, null = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for held in (False, True):
                own = flag == held
                if own.any():
                    waiting[held].append((ids[own], null[own], size[own], word[np.repeat(own, size)]))
                    if sum(len(x[3]) for x in waiting[held]) >= BLOCK:
                        yield row(held)
                        G.give_back()
    for held in (False, True):
        if waiting[held]:
            yield row(held)
    G.give_back(True)


class Events:
    """The events of a block's texts: every word and each text's end.  A text without words has none.

    grams[k] are the hashes of the (k+1)-grams that end at the events at[k].
    """

    def __init__(self, word: np.ndarray, size: np.ndarray, order: int):
        self.size = size + (size > 0)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        n = int(self.start[-1])
        self.doc = np.repeat(np.arange(len(size)), self.size)
        self.pos = np.arange(n) - self.start[:-1][self.doc]
        token = np.full(n, _END, np.uint64)
        token[self.pos < size[self.doc]] = word
        self.grams, self.at = [], []
        for k in range(order):
            at = np.flatnonzero(self.pos >= k)
            h = np.zeros(len(at), np.uint64)
            for j in range(k + 1):
                h += token[at - j] * G._SLOT[j]
            self.grams.append(G.mix(h + np.uint64(k + 1)))
            self.at.append(at)

    def __len__(self) -> int:
        return len(self.doc)


def _opened(body: bytes, order: int) -> tuple[pa.Array, Events]:
    """A block's doc ids and events."""
    ids, null, size, known, code = G.unpack(body)
    return pa.array(ids.view(np.int64), mask=null.astype(bool)), Events(known[code.astype(np.int64)], size.astype(np.int64), order)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _send(order: int, buckets: int):
    shift = np.uint64(max(0, 64 - KEY_BITS - math.ceil(math.log2(buckets))))

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, body in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), batch.column("body")):
                parts: dict[int, list] = {}
                for k, h in enumerate(_opened(body.as_py(), order)[1].grams):
                    distinct, count = np.unique(h, return_counts=True)
                    cut = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1, dtype=np.uint64))
                    short = distinct >> shift
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        own = short[cut[b] : cut[b + 1]]
                        parts.setdefault(b, [np.zeros(0, np.uint64)] * (2 * order))[2 * k : 2 * k + 2] = [np.diff(own, prepend=np.uint64(0)), count[cut[b] : cut[b + 1]]]
                names = sorted(parts)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array([held] * len(names), pa.bool_()), pa.array([G.pack(*parts.pop(b)) for b in names], pa.binary())], schema=_PACKET)
                G.give_back()

    return packets


def _add_up(order: int):
    def totals(table: pa.Table) -> pa.Table:
        bucket, flags = table["bucket"][0].as_py(), table["held"].to_pylist()
        keys, counts, sizes = [], [], []
        for body in table["body"]:
            part = G.unpack(body.as_py())
            keys += [np.cumsum(x, dtype=np.uint64) for x in part[::2]]
            counts += [x.astype(np.int64) for x in part[1::2]]
            sizes += [len(x) for x in part[::2]]
        key = np.concatenate(keys)
        del keys
        by = np.argsort(key, kind="stable")
        ranked = key[by]
        new = np.append(True, ranked[1:] != ranked[:-1])
        del key, ranked
        at, group = np.flatnonzero(new), np.empty(len(by), np.int32)
        group[by] = np.cumsum(new, dtype=np.int32) - 1
        count = np.concatenate(counts)
        del counts, new
        held = np.repeat(np.array(flags), [sum(sizes[i : i + order]) for i in range(0, len(sizes), order)])
        first = np.repeat(np.arange(len(sizes)) % order == 0, sizes)
        add = lambda x: np.add.reduceat(x[by], at)
        all_, trained = add(count), add(np.where(held, 0, count))
        sums = []
        for which in (first, first & ~held):
            unigram = add(np.where(which, count, 0))
            sums += [int((unigram > 0).sum()), int(unigram.sum())]
        del by, at, first, held, count
        bodies, place = [], 0
        for i, flag in enumerate(flags):
            own = []
            for s in sizes[i * order : (i + 1) * order]:
                g = group[place : place + s]
                own += [all_[g], trained[g] if flag else np.zeros(0, np.int64)]
                place += s
            bodies.append(G.pack(*own))
        G.give_back()
        once = [pa.array([x, *[0] * (len(flags) - 1)], pa.int64()) for x in sums]
        return pa.table([pa.array([bucket] * len(flags), pa.int64()), table["block"], table["held"], pa.array(bodies, pa.binary()), *once], names=[*_PACKET.names, *_SUMS])

    return totals


def _answers(packets: pa.Table, order: int, which: int) -> list[np.ndarray]:
    """A block's totals by order, aligned with its distinct n-grams in ascending order."""
    by = np.argsort(np.array(packets["bucket"].to_pylist(), np.int64))
    parts = [G.unpack(packets["body"][int(i)].as_py())[which::2] for i in by]
    return [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(order)]


def _by_event(ev: Events, answers: list[np.ndarray], delete_own: bool) -> list[np.ndarray]:
    """For each event the counts of the 1-, 2-, ... -grams that end there; 0 where the text is too short."""
    out = []
    for h, at, total in zip(ev.grams, ev.at, answers):
        _, back = np.unique(h, return_inverse=True)
        value = total[back]
        if delete_own:
            _, own, many = np.unique(ev.doc[at] * np.int64(len(total) + 1) + back, return_inverse=True, return_counts=True)
            value = value - many[own]
        c = np.zeros(len(ev), np.int64)
        c[at] = value
        out.append(c)
    return out


def _before(c: np.ndarray, ev: Events, back: int) -> np.ndarray:
    """Each event's context count: that of the gram that ends at the event before; 0 where there is none."""
    out = np.zeros(len(c), np.int64)
    out[1:] = c[:-1]
    out[ev.pos < back] = 0
    return out


def _estimates(ev: Events, c: list[np.ndarray], n: np.ndarray | int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each event's context and its estimates: a column an order, highest first, then the uniform one."""
    order = len(c)
    bucket = np.zeros(len(ev), np.int64)
    columns = []
    for k in range(order - 1, 0, -1):
        context = _before(c[k - 1], ev, k)
        columns.append(np.where(context > 0, c[k] / np.maximum(context, 1), 0.0))
        free = (bucket == 0) & (context > 0)
        bucket[free] = 64 * k + np.floor(np.log2(context[free])).astype(np.int64)
    columns += [c[0] / np.maximum(n, 1), np.full(len(ev), 1.0 / (v + 1))]
    return bucket, np.column_stack(columns)


_NONE = -999


def _held_out(order: int, n: int, v: int):
    """Held-out events by bucket and cell: their number, and the sum of each estimate."""
    sums = [f"p{k}" for k in range(order + 1)]

    def count(key, blocks, packets):
        if blocks.num_rows:
            _, ev = _opened(blocks["body"][0].as_py(), order)
        if not blocks.num_rows or not len(ev):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64()), *(pa.array([], pa.float64()) for _ in sums)], names=["bucket", "q", "events", *sums])
        bucket, p = _estimates(ev, _by_event(ev, _answers(packets, order, 1), False), n, v)
        q = np.where(p > 0, np.round(2 * np.log2(np.maximum(p, 1e-300))), _NONE).astype(np.int64)
        cell, of, many = np.unique(np.column_stack((bucket, q)), axis=0, return_inverse=True, return_counts=True)
        total = [np.bincount(of.reshape(-1), column, len(cell)) for column in p.T]
        return pa.table([pa.array(cell[:, 0]), pa.array(cell[:, 1:].tolist(), pa.list_(pa.int64())), pa.array(many.astype(np.int64)), *map(pa.array, total)], names=["bucket", "q", "events", *sums])

    return count


def em(p: np.ndarray, events: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of the columns of `p` under which `events` occurrences of each row are likeliest."""
    usable = (p > 0).any(axis=0)
    lam = usable / usable.sum()
    for _ in range(rounds):
        part = p * lam
        whole = part.sum(axis=1)
        ok = whole > 0
        new = (part[ok] / whole[ok, None] * events[ok, None]).sum(axis=0)
        new = new / new.sum()
        if np.abs(new - lam).max() < 1e-6:
            return new
        lam = new
    return lam


def _weights(table: pa.Table) -> pa.Table:
    events = table["events"].to_numpy().astype(float)
    sums = [c for c in table.column_names if c[0] == "p"]
    lam = em(np.column_stack([table[c].to_numpy() for c in sums]) / events[:, None], events)
    return pa.table([table["bucket"].slice(0, 1), pa.array([lam.tolist()], pa.list_(pa.float64()))], names=["bucket", "weights"])


def weight_table(found: dict[int, list[float]], order: int) -> np.ndarray:
    """Weights by bucket number.  A bucket that no held-out event was in takes the nearest one of its order, or equal weights of the estimates that it can have; all are raised by FLOOR, so no event is impossible."""
    out = np.zeros((64 * order, order + 1))
    for b in range(len(out)):
        k = b // 64 if b >= 64 else 0
        near = [x for x in found if (x // 64 if x >= 64 else 0) == k]
        if near:
            out[b] = found[min(near, key=lambda x: (abs(x - b), x))]
        else:
            out[b, order - 1 - k :] = 1 / (k + 2)
    return (out + FLOOR) / (1 + FLOOR * (order + 1))


def _score(order: int, n: int, v: int, weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n_events", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])

    def score(key, blocks, packets):
        if not blocks.num_rows:
            return schema.empty_table()
        ids, ev = _opened(blocks["body"][0].as_py(), order)
        total = np.zeros(len(ev.size))
        if len(ev):
            bucket, p = _estimates(ev, _by_event(ev, _answers(packets, order, 0), True), n - ev.size[ev.doc], v)
            logs = np.log((p * weights[bucket]).sum(axis=1))
            full = ev.size > 0
            total[full] = np.add.reduceat(logs, ev.start[:-1][full])
            del bucket, p, logs
        mean = np.where(ev.size > 0, total / np.maximum(ev.size, 1), 0.0)
        G.give_back()
        return pa.table([ids, pa.array(ev.size), pa.array(np.round(total, 6)), pa.array(np.round(np.exp(-mean), 6), mask=ev.size == 0)], schema=schema)

    return score


def scored(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, n_events, log_prob, perplexity) for every row of `docs`.

    Words are as in `textgrams`; a text's end is an event too.  log_prob is the
    natural logarithm of the text's probability, perplexity is
    exp(-log_prob / n_events).  A text without words (null, empty, punctuation
    alone) has no event, log_prob 0 and perplexity null.  Each row counts and
    is scored by itself: repeated rows count repeatedly, and each one's own
    counts alone are deleted from its score; a null doc_id is passed through.
    Hash collisions (about one n-gram in four million) add counts.  A text is
    held and scored whole by one task.  An empty
    table gives no rows; extra columns are ignored.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    small_batches(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4, math.ceil(chars / 6.5 * order / PER_BUCKET))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD)) == 0).alias("held"), F.coalesce(G.normalised(F.col("text").cast("string")), F.lit("")).alias("norm"))
    blocks = saved(d.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    kinds = "bucket long, block long, held boolean, body binary"
    with_sums = kinds + "".join(f", {c} long" for c in _SUMS)
    totals = saved(blocks.mapInArrow(_send(order, buckets), kinds).groupBy("bucket").applyInArrow(_add_up(order), with_sums), "lm-counts")
    v, n, v_train, n_train = (x or 0 for x in totals.agg(*(F.sum(c) for c in _SUMS)).first())
    answers = totals.select("bucket", F.col("block").alias("to_block"), "held", "body")
    sums = [f"p{k}" for k in range(order + 1)]
    cells = blocks.where("held").groupBy("block").cogroup(answers.where("held").groupBy("to_block")).applyInArrow(_held_out(order, n_train, v_train), "bucket long, q array<long>, events long" + "".join(f", {c} double" for c in sums))
    rows = cells.groupBy("bucket", "q").agg(*(F.sum(c).alias(c) for c in ("events", *sums))).groupBy("bucket").applyInArrow(_weights, "bucket long, weights array<double>").collect()
    weights = weight_table({r["bucket"]: r["weights"] for r in rows}, order)
    out = saved(blocks.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(_score(order, n, v, weights), "doc_id long, n_events long, log_prob double, perplexity double"), "lm-scores")
    dropped(totals, blocks)
    return out

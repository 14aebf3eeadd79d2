"""Benchmark decontamination with suffix arrays over the training documents.

Each task gathers whole documents into shards of about SHARD words and sorts the
shard's suffixes (none runs over its document's end) by prefix doubling, down to
the length of the longest test item.  Every suffix of every test item is then
looked up by binary search in every shard; the interval of training suffixes
that begin with its first `min_words` words holds all places of a match.  Places
that go on from the word before are left out, and from the others the match is
followed word by word to its end.  This is done for SLICE places at a time, so
memory doesn't follow the product of repetitive texts and items.  The search is
exact, nothing is shuffled, and a task holds one shard at a time.

Words are compared after lower-casing and with punctuation as spaces.
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
from lodestone.llm.common import small_batches

#: Words of a shard; a longer document is a shard of its own.
SHARD = 600_000
#: Words of test items that are broadcast at once (about 72 bytes each); more are searched in several passes.
TEST_WORDS = 1_000_000
#: Places of matches that are held at once.
SLICE = 2_000_000

_BITS, _PACK = np.uint64(21), 3
MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("item_words", pa.int64())])


def _codes(word: np.ndarray) -> np.ndarray:
    """Words as 20-bit codes from 1 up; equal words have equal codes, and matches are compared in full later."""
    return (word >> np.uint64(44)) + np.uint64(1)


def _packed(code: np.ndarray, left: np.ndarray) -> np.ndarray:
    """At each place, the next three codes in one integer; 0 stands past the text's end."""
    padded = np.concatenate((code, np.zeros(_PACK, np.uint64)))
    key = np.zeros(len(code), np.uint64)
    for k in range(_PACK):
        part = padded[k : k + len(code)].copy()
        if k:
            part[left <= k] = 0
        key = (key << _BITS) | part
    return key


class SuffixArray:
    """Suffixes of the shard's documents in the order of their codes, down to `depth` words."""

    def __init__(self, word: np.ndarray, start: np.ndarray, depth: int):
        self.word = word
        size = np.diff(start)
        self.left = np.repeat(start[1:], size) - np.arange(len(word))
        self.key = _packed(_codes(word), self.left)
        order = np.argsort(self.key)
        ranked = self.key[order]
        new = np.ones(len(order), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        done = _PACK
        if done < depth and len(order):
            rank = np.empty(len(order), np.int64)
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + 1
            last = np.append(new[1:], True)
            tied = np.flatnonzero(~(new & last))
            while done < depth and len(tied):
                at = order[tied]
                goes_on = self.left[at] > done
                second = np.where(goes_on, rank[np.where(goes_on, at + done, 0)], 0)
                first = rank[at]
                by = np.lexsort((second, first))
                at, first, second = at[by], first[by], second[by]
                order[tied] = at
                fresh = np.ones(len(at), bool)
                fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
                end = np.append(fresh[1:], True)
                tied = tied[~(fresh & end)]
                done *= 2
        self.order, self.ranked = order, ranked

    def interval(self, wanted: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in the array of the suffixes that begin with `words` given codes; `wanted` has a row of packed keys a query."""
        shift = lambda k: np.uint64(21 * max(0, (k + 1) * _PACK - words))
        ranked = self.ranked >> shift(0) if shift(0) else self.ranked
        lo = np.searchsorted(ranked, wanted[:, 0] >> shift(0), "left")
        hi = np.searchsorted(ranked, wanted[:, 0] >> shift(0), "right")
        for k in range(1, wanted.shape[1]):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            target = wanted[live, k] >> shift(k)
            bounds = []
            for right in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while (todo := a < b).any():
                    mid = (a + b) >> 1
                    at = self.order[np.where(todo, mid, 0)]
                    inside = self.left[at] > k * _PACK
                    value = np.where(inside, self.key[np.where(inside, at + k * _PACK, 0)], np.uint64(0)) >> shift(k)
                    up = todo & ((value <= target) if right else (value < target))
                    a = np.where(up, mid + 1, a)
                    b = np.where(todo & ~up, mid, b)
                bounds.append(a)
            lo[live], hi[live] = bounds
        return lo, hi


class Items:
    """Test items as words; `suffixes` groups their suffixes by the words that a match must have."""

    def __init__(self, ids: list, texts: pa.Array, min_words: int):
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        self.null = np.array([x is None for x in ids], bool)
        self.word, self.start = G.words(texts)
        self.size = np.diff(self.start)
        self.longest = int(self.size.max()) if len(self.size) else 0
        left = np.repeat(self.start[1:], self.size) - np.arange(len(self.word))
        self.left, self.owner = left, np.repeat(np.arange(len(self.size)), self.size)
        key = np.concatenate((_packed(_codes(self.word), left), np.zeros(min_words + _PACK, np.uint64)))
        least = np.minimum(self.size, min_words)[self.owner]
        self.suffixes = []
        for words in np.unique(least).tolist():
            at = np.flatnonzero((least == words) & (left >= words))
            self.suffixes.append((words, at, np.column_stack([key[at + k] for k in range(0, words, _PACK)])))


def matches(word: np.ndarray, start: np.ndarray, items: Items) -> dict[str, np.ndarray]:
    """For each (document, item) that share a long enough run of words, the longest; of equally long ones the first in the document, then in the item."""
    best = np.zeros((0, 5), np.int64)
    if len(word) and len(items.word):
        sa = SuffixArray(word, start, items.longest)
        for words, at, wanted in items.suffixes:
            lo, hi = sa.interval(wanted, words)
            met = np.flatnonzero(hi > lo)
            at, lo, count = at[met], lo[met], (hi - lo)[met]
            end = np.cumsum(count)
            for first in range(0, int(end[-1]) if len(end) else 0, SLICE):
                place = np.arange(first, min(first + SLICE, int(end[-1])))
                of = np.searchsorted(end, place, "right")
                p, q = sa.order[lo[of] + place - (end[of] - count[of])], at[of]
                best = _longest(np.concatenate((best, _followed(sa, start, items, p, q, words))))
    return dict(zip(("doc", "item", "match_words", "doc_word", "item_word"), best.T))


def _followed(sa: SuffixArray, start: np.ndarray, items: Items, p: np.ndarray, q: np.ndarray, words: int) -> np.ndarray:
    """Of matches at places p of the shard and q of the items, those that can't begin a word earlier, as (doc, item, length, place in doc, place in item)."""
    word = sa.word
    doc, item = np.searchsorted(start, p, "right") - 1, items.owner[q]
    before = (p > start[doc]) & (q > items.start[item])
    begins = ~before | (word[np.where(before, p - 1, 0)] != items.word[np.where(before, q - 1, 0)])
    p, q, doc, item = p[begins], q[begins], doc[begins], item[begins]
    length = np.zeros(len(p), np.int64)
    most = np.minimum(sa.left[p], items.left[q])
    live = np.arange(len(p))
    while len(live):
        live = live[length[live] < most[live]]
        live = live[word[p[live] + length[live]] == items.word[q[live] + length[live]]]
        length[live] += 1
    full = length >= words
    return _longest(np.column_stack((doc, item, length, p - start[doc], q - items.start[item]))[full])


def _longest(rows: np.ndarray) -> np.ndarray:
    """The longest match of each (doc, item); of equally long ones the first in the document, then in the item."""
    doc, item, length, at, of = rows.T
    rows = rows[np.lexsort((of, at, -length, item, doc))]
    return rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))[: len(rows)]]


def _shards(batches: Iterator[pa.RecordBatch], norm: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole documents gathered until there are SHARD words; their rows, words and starts."""
    rows, word, size, have = [], [], [], 0
    for batch in batches:
        for part in G.pieces(batch, norm):
            w, s = G.words(part.column(norm))
            rows.append(part), word.append(w), size.append(np.diff(s))
            have += len(w)
            if have >= SHARD:
                yield pa.Table.from_batches(rows), np.concatenate(word), np.concatenate(([0], np.cumsum(np.concatenate(size))))
                rows, word, size, have = [], [], [], 0
                G.give_back()
    if rows:
        yield pa.Table.from_batches(rows), np.concatenate(word), np.concatenate(([0], np.cumsum(np.concatenate(size))))
    rows, word, size = [], [], []
    G.give_back(True)


def _test_passes(bench: DataFrame, min_words: int) -> list[Items]:
    """The items, in as many parts as keep each within about TEST_WORDS words; their number follows the benchmark, not the corpus."""
    norm = bench.select(F.col("item_id").cast("bigint").alias("item_id"), G.normalised(F.col("text")).alias("norm")).where("norm != ''").distinct()
    chars = norm.agg(F.sum(F.length("norm"))).first()[0] or 0
    parts = max(1, math.ceil(chars / 4 / TEST_WORDS))
    out = []
    for k in range(parts):
        rows = norm.where(F.pmod(F.xxhash64("norm"), F.lit(parts)) == k).orderBy("item_id", "norm").toArrow()
        if rows.num_rows:
            out.append(Items(rows["item_id"].to_pylist(), rows["norm"].combine_chunks(), min_words))
    return out


def find_matches(docs: DataFrame, bench: DataFrame, min_words: int = 13) -> DataFrame:
    """The longest verbatim match of each document and test item that share one.

    Returns (doc_id, item_id, match_words, doc_word, item_word, item_words):
    length of the longest common run of words, where it begins in the document
    and in the item (from 0), and the item's length.  Reported are runs of at
    least `min_words` words, or of the whole item where that is shorter.  Of
    equally long runs the first in the document counts, then in the item.

    Null and empty texts and items match nothing.  A null doc_id or item_id is
    reported as null.  Each row of documents is searched by itself, so repeated
    rows are reported repeatedly; repeated items are one, but the same text
    under two ids is reported for both.  Empty tables give no rows; extra
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    norm = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), G.normalised(F.col("text")).alias("norm")).where("norm != ''")

    def search(part: Items):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for rows, word, start in _shards(batches, "norm"):
                m = matches(word, start, items)
                if len(m["doc"]):
                    ids = rows["doc_id"].combine_chunks().take(pa.array(m["doc"]))
                    item = pa.array(items.ids[m["item"]], mask=items.null[m["item"]])
                    yield pa.RecordBatch.from_arrays([ids, item, *(pa.array(m[c]) for c in ("match_words", "doc_word", "item_word")), pa.array(items.size[m["item"]])], schema=MATCHES)

        return norm.mapInArrow(run, ", ".join(f"{f.name} long" for f in MATCHES))

    passes = [search(items) for items in _test_passes(bench, min_words)]
    if not passes:
        return docs.sparkSession.createDataFrame([], ", ".join(f"{f.name} long" for f in MATCHES))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def decontaminated(docs: DataFrame, bench: DataFrame, min_words: int = 13) -> DataFrame:
    """`docs`, with all their columns, without the rows that `find_matches` would report.

    Rows are dropped where they are read, so null and repeated ids need no
    join: every row is judged by its own text.  Null and empty texts stay.
    """
    small_batches(docs.sparkSession)
    norm = "norm_" + uuid.uuid4().hex[:8]
    for part in _test_passes(bench, min_words):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for rows, word, start in _shards(batches, norm):
                stays = np.ones(rows.num_rows, bool)
                stays[matches(word, start, items)["doc"]] = False
                yield from rows.drop_columns([norm]).filter(pa.array(stays)).to_batches()

        docs = docs.withColumn(norm, G.normalised(F.col("text"))).mapInArrow(keep, docs.schema)
    return docs

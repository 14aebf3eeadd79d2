"""Exact nearest neighbours for all queries at once, and the operations around them.

Vectors are packed into blocks.  A task takes blocks of queries, each past the
vectors' blocks of one part, and keeps each query's k best so far; one matrix
product of single precision gives a lower bound of all distances of two blocks,
and only what may still be among the k best is measured in full.  Each part's k
best are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import batches_of, saved_table

#: Vectors of a block.
BLOCK = 2048
#: Blocks of vectors that a query block passes in one task, which the JVM holds; pairs of blocks of an Arrow batch; blocks that are cut into groups together.
PART, PAIRS, CUT = 256, 16, 16


def normalise(v: Column, size: int) -> Column:
    """The first `size` dimensions scaled to length 1; null where there are fewer, as it is where the length is 0."""
    cut = F.slice(v.cast("array<double>"), 1, size)
    length = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(v) >= size, F.transform(cut, lambda x: x / F.when(length == 0, 1.0).otherwise(length)))


def quantise(v: Column) -> Column:
    """Sign bits as a string of 0 and 1, one a dimension."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def _packed(vectors: DataFrame, vec_id: str, vec: str, group: str | None, prefix: str) -> DataFrame:
    single = vectors.schema[vec].dataType.simpleString() == "array<float>"

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, groups = batch.column("id").to_numpy(), batch.column("grp").dictionary_encode()
        code = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        for c in np.unique(code).tolist():
            own = np.flatnonzero(code == c)
            name = None if c < 0 else groups.dictionary[c].as_py()
            for at in range(0, len(own), BLOCK):
                part = own[at : at + BLOCK]
                yield pa.RecordBatch.from_pydict({"grp": pa.array([name], pa.string()), "ids": pa.array([ids[part].tobytes()]), "flat": pa.array([flat[part].tobytes()])})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= CUT * BLOCK:
                yield from blocks(held)
                held = []
        if held:
            yield from blocks(held)

    slim = vectors.select(F.col(vec_id).cast("bigint").alias("id"), (F.col(group) if group else F.lit("")).cast("string").alias("grp"), F.col(vec).cast(f"array<{'float' if single else 'double'}>").alias("vec"))
    slim = slim.where("vec is not null and id is not null and not exists(vec, x -> x is null)")
    with batches_of(vectors.sparkSession, BLOCK):
        packed = slim.mapInArrow(pack, "grp string, ids binary, flat binary").withColumns({"no": F.monotonically_increasing_id(), "single": F.lit(single)})
        return saved_table(packed.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("grp", "ids", "flat", "no", "single"))), "blocks")


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows; those of l2 by differences, so equal vectors are at 0."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "cosine":
        return 1 - np.einsum("ij,ij->i", a, b) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
    return ((a > 0) != (b > 0)).sum(1).astype(np.float64)


class _Nearest:
    """The k nearest so far of each query of a block; ties by id.  With `also`, that distance is taken beside."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, k: int, metric: str, also: str | None) -> None:
        self.ids, self.flat, self.k, self.metric, self.also = ids, flat, k, metric, also
        whole = flat[np.isfinite(flat).all(1)] if metric == "l2" else flat[:0]
        self.shift = whole.mean(0) if len(whole) else np.zeros(flat.shape[1])
        self.own = self._terms(flat)
        self.worst = np.full(len(ids), np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def _terms(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose squared distances order as the metric does, and their squared lengths."""
        if self.metric == "l2":
            y = x - self.shift
            return y, (y * y).sum(1)
        y = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] if self.metric == "cosine" else np.where(x > 0, 1.0, -1.0)
        return y, np.full(len(x), 1.0 if self.metric == "cosine" else float(x.shape[1]))

    def _least(self, v: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances: what rounding may add to them is taken off."""
        (a, n), (b, m) = self.own, self._terms(v)
        largest = max((float(np.abs(x[np.isfinite(x)]).max(initial=0)) for x in (a, b)), default=0)
        kind = np.float32 if largest < 1e15 else np.float64
        slack = 4 * (a.shape[1] + 20) * float(np.finfo(kind).eps)
        left = np.concatenate((-2 * a, np.ones((len(a), 1)), n[:, None] * (1 - slack)), 1).astype(kind)
        right = np.concatenate((b, m[:, None] * (1 - slack), np.ones((len(b), 1))), 1).astype(kind)
        return left @ right.T

    def _measured(self, row: np.ndarray, col: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
        step = max(1, (8 << 20) // (8 * v.shape[1]))
        return np.concatenate([_exact(self.flat[row[i : i + step]], v[col[i : i + step]], metric) for i in range(0, len(row), step)] or [np.zeros(0)])

    def add(self, ids: np.ndarray, v: np.ndarray, not_self: bool) -> None:
        least = self._least(v)
        if not_self and len(np.intersect1d(self.ids, ids)):
            least[self.ids[:, None] == ids[None, :]] = np.nan
        new = np.flatnonzero(np.isinf(self.worst))
        if len(new) and len(ids) > self.k:
            pick = np.argpartition(least[new], self.k - 1, axis=1)[:, : self.k]
            there = np.isfinite(np.take_along_axis(least[new], pick, 1)).all(1)
            new, pick = new[there], pick[there]
            far = self._measured(np.repeat(new, self.k), pick.ravel(), v, self.metric).reshape(-1, self.k).max(1, initial=0)
            self.worst[new] = np.where(np.isfinite(far), far, np.inf)
        bound = {"l2": self.worst**2, "cosine": 2 * self.worst + 1e-9, "hamming": 4 * self.worst}[self.metric] * (1 + 1e-9)
        row, col = np.divmod(np.flatnonzero(least <= np.nextafter(bound.astype(least.dtype), np.inf, dtype=least.dtype)[:, None]), len(ids))
        near = self._measured(row, col, v, self.metric)
        keep = np.isfinite(near) & (near <= self.worst[row])
        row, col, near = row[keep], col[keep], near[keep]
        self.found.append((row, ids[col], near, self._measured(row, col, v, self.also) if self.also else near))
        self.waiting += len(row)
        if self.waiting >= len(self.ids) * self.k:
            self._settle()

    def _settle(self) -> None:
        row, ids, near, also = (np.concatenate(x) for x in zip(*self.found))
        by = np.lexsort((ids, near, row))
        row, ids, near, also = row[by], ids[by], near[by], also[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.worst[row[last]] = near[last]
        self.found, self.waiting = [tuple(x[place < self.k] for x in (row, ids, near, also))], 0

    def rows(self, group: str | None) -> pa.RecordBatch:
        self._settle()
        row, ids, near, also = self.found[0]
        return pa.RecordBatch.from_pydict({"qid": pa.array(self.ids[row]), "vec_id": pa.array(ids), "distance": pa.array(near), "also": pa.array(also), "grp": pa.array([group] * len(row), pa.string())})


def _found(queries: DataFrame, vectors: DataFrame, k: int, metric: str, qid: str, vec_id: str, vec: str, per_group: str | None, not_self: bool, also: str | None = None) -> DataFrame:
    """(qid, vec_id, distance, also, grp): each query's k nearest of each part of the vectors, or k of each group there."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):

                def raw(c: str, i: int = i, batch: pa.RecordBatch = batch) -> np.ndarray:
                    kind = np.int64 if c.endswith("ids") else np.float32 if batch.column(f"{c[0]}_single")[i].as_py() else np.float64
                    return np.frombuffer(batch.column(c)[i].as_buffer(), kind)

                now = batch.column("q_no")[i].as_py(), batch.column("v_grp")[i].as_py()
                if now != at:
                    if held:
                        yield held.rows(at[1])
                    qi = raw("q_ids").copy()
                    at, held = now, _Nearest(qi, raw("q_flat").reshape(len(qi), -1).astype(np.float64), k, metric, also)
                vi = raw("v_ids")
                held.add(vi, raw("v_flat").reshape(len(vi), -1).astype(np.float64), not_self)
        if held:
            yield held.rows(at[1])

    spark = queries.sparkSession
    asked, there = _packed(queries, qid, vec, None, "q"), _packed(vectors, vec_id, vec, per_group, "v")
    n, m = asked.count(), there.count()
    asked = asked.repartition(max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))
    there = saved_table(there.repartition(max(1, -(-m // PART))).sortWithinPartitions("v_grp"), "blocks")
    with batches_of(spark, PAIRS):
        return saved_table(asked.join(there.hint("shuffle_replicate_nl")).mapInArrow(best, "qid long, vec_id long, distance double, also double, grp string"), "nearest")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", qid: str = "vec_id", vec_id: str = "vec_id", vec: str = "embedding", per_group: str | None = None, not_self: bool = True, digits: int = 4) -> DataFrame:
    """(qid, vec_id, distance, rank[, grp]): each query's k nearest vectors, or k of each group.

    metric is l2, cosine or hamming (of sign bits).  Ranks go by the full
    distance, ties to the lesser id; the distances returned are rounded to
    `digits`.  Null ids, and vectors that are null or have a null in them, take
    no part.
    """
    found = _found(queries, vectors, k, metric, qid, vec_id, vec, per_group, not_self).drop("also")
    keys = ["qid", "grp"] if per_group else ["qid"]
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    out = out.withColumn("distance", F.round("distance", digits) + 0.0)
    return out if per_group else out.drop("grp")


def coarse(queries: DataFrame, vectors: DataFrame, k: int, widen: int = 8, vec_id: str = "vec_id", vec: str = "embedding", digits: int = 4) -> DataFrame:
    """Two stages: k*widen by Hamming distance of sign bits, then the k nearest of those by L2."""
    by = Window.partitionBy("qid")
    first = _found(queries, vectors, k * widen, "hamming", vec_id, vec_id, vec, None, True, also="l2").withColumn("place", F.row_number().over(by.orderBy("distance", "vec_id"))).where(F.col("place") <= k * widen)
    best = first.select("qid", "vec_id", F.col("also").alias("distance")).withColumn("rank", F.row_number().over(by.orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return best.withColumn("distance", F.round("distance", digits))


def resolve(matches: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Matches (qid, vec_id, distance) as results: least distance of each chunk, k best, then by source the sum of 1/distance (0 counts as 1e-12)."""
    least = matches.join(chunks, "vec_id").groupBy("qid", "chunk_id", "source").agg(F.min("distance").alias("distance"))
    cut = least.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "chunk_id"))).where(F.col("rank") <= k)
    return cut.groupBy("qid", "source").agg(F.round(F.sum(1 / F.greatest("distance", F.lit(1e-12))), 4).alias("score"), F.count("*").alias("chunks"))


def ann_breadth(limit: int, factor: int = 2) -> int:
    """How many candidates an approximate index would look at; the scan here is exact."""
    return min(max(limit * factor, 40), 1000)


def chunk_windows(docs: DataFrame, size: int, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk): texts of up to `size` characters whole, longer ones in windows that overlap; blank ones have none."""
    step = size - overlap
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - overlap - 1, F.lit(step)))
    rows = docs.where(F.trim(text) != "").select(key, text, F.posexplode(starts).alias("chunk_index", "at"))
    return rows.select(key, "chunk_index", F.substring(F.col(text), F.col("at") + 1, F.lit(size)).alias("chunk"))


def embedding_batches(lengths: list[int], most: int = 100, tokens: int = 6000, per_token: int = 3) -> list[list[int]]:
    """Indexes of texts packed in order; a batch is closed at `most` texts or an estimate of `tokens`."""
    out: list[list[int]] = [[]]
    held = 0
    for i, n in enumerate(lengths):
        cost = -(-n // per_token)
        if out[-1] and (len(out[-1]) >= most or held + cost > tokens):
            out.append([])
            held = 0
        out[-1].append(i)
        held += cost
    return [b for b in out if b]


def cache_misses(texts: DataFrame, cache: DataFrame, namespace: str, dims: int) -> DataFrame:
    """Distinct texts, with their key, whose embedding isn't in the cache."""
    keyed = texts.select(F.sha2(F.concat_ws("\x00", F.lit(namespace), F.lit(str(dims)), "text"), 256).alias("key"), "text").distinct()
    return keyed.join(cache.select("key"), "key", "left_anti")

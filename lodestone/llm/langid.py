"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes one space, and its byte
1- to 4-grams are counted into DIMS hashed features.  Counts are damped by
log(1 + n), weighed by inverse document frequency over all documents, and
scaled to length 1.  Each language has several centroids, found by spherical
k-means among its labelled documents.  A text gets the language of the centroid
of greatest cosine, or none (`und`) if its distance is beyond what labelled
documents of about its length show.

Document frequencies are taken over all documents.  Only the clustering is
bounded: it sees at most `per_language` labelled rows a language (a parameter).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textgrams as G
from lodestone.llm.common import small_enough

DIMS = 1 << 12
GRAMS = (1, 2, 3, 4)
#: Rows that are counted at once.
ROWS = 512
#: Bands of length; one with fewer labelled rows than ENOUGH has the limit of the lowest row in it and its neighbours.
BANDS, ENOUGH = 16, 12
UNKNOWN = "und"

_rng = np.random.default_rng(7)
_MIXED = [_rng.integers(1, 2**32, 256, dtype=np.uint32) for _ in GRAMS]


def letters(text: Column) -> Column:
    """Lower-case letters and marks of `text`, all else as single spaces; padded with a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts, a row of DIMS a text; n-grams don't run over a text's end."""
    raw, offsets = G.buffers(texts)
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, G.PIECE):  # long texts piece by piece; pieces overlap by the longest n-gram
            part = raw[at : min(b, at + G.PIECE + len(GRAMS) - 1)]
            first = min(b - at, G.PIECE)
            h = np.zeros(len(part), np.uint32)
            for n, table in enumerate(_MIXED, 1):
                if len(part) < n:
                    break
                h = h[: len(part) - n + 1] * np.uint32(0x01000193) + table[part[n - 1 :]]
                spot = (h[:first] * np.uint32(0x9E3779B1)) >> np.uint32(20)
                out[k] += np.bincount(spot, minlength=DIMS)
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of up to ROWS rows, since every row has DIMS counts."""
    for piece in G.pieces(batch):
        for at in range(0, piece.num_rows, ROWS):
            yield piece.slice(at, ROWS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, scaled to length 1; a text without letters is all 0."""
    v = np.log1p(count) * idf
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def band(count: np.ndarray) -> np.ndarray:
    """Length of texts, from their n-gram counts, to powers of four."""
    return np.minimum(np.log2(np.maximum(count.sum(axis=1), 1)) // 2, BANDS - 1).astype(int)


@dataclass
class Model:
    """idf per feature; each centroid's direction and language; the least cosine accepted for each `band` of length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: pa.Array, blank: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and greatest cosine of each text; the first of equal centroids counts."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        count = counts(texts)
        sim = vectors(count, self.idf) @ self.centroids.T
        best = sim.argmax(axis=1)
        cos = sim[np.arange(len(best)), best].astype(float)
        ok = (cos >= self.least[band(count)]) & ~blank
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), ok.tolist())], np.where(blank, 0.0, cos)


def cluster(v: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, so it is the same each time."""
    seeds = [int(np.argmax(v @ v.mean(axis=0)))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        new = np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        length = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.divide(new, length, out=np.zeros_like(new), where=length > 0)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature is, and the number of documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for piece in _slices(batch):
                df += (counts(piece.column("norm")) > 0).sum(axis=0)
                n += piece.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "df": pa.array([df.tolist()], pa.list_(pa.int64()))})

    parts = docs.select(letters(F.col("text")).alias("norm")).mapInArrow(part, "n long, df array<long>")
    rows = parts.select("n", F.posexplode("df").alias("at", "df")).groupBy("at").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS)
    for r in rows:
        out[r["at"]] = r["df"]
    return out, (rows[0]["n"] if rows else 0)


def fit(docs: DataFrame, per_language: int = 400, centroids: int = 4, spread: float = 6.0, languages: int = 2000) -> Model:
    """Trains on rows whose column `lang` isn't null.

    Up to `per_language` rows of each language are taken, by a hash of id and
    text; two thirds are clustered, one task a language, and the limits of
    distance come from the third that wasn't.  More than `languages` different
    names fail, since the model is given to every task.  `spread` sets the distance at which texts are rejected (see `limits`).  A
    language whose name is empty, or all of whose rows are without letters,
    isn't learned.
    """
    df, n = document_frequency(docs)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    none = Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    rows = docs.where("lang is not null and lang != ''").select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    share = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), 1.3 * per_language / F.col("count")).alias("share"))
    share = F.broadcast(share) if small_enough(share, 100_000) else share
    picked = rows.join(share, "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                if piece.num_rows:
                    yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("h"), pa.array([x.tobytes() for x in counts(piece.column("norm"))], pa.binary())], ["lang", "h", "counts"])

    def learn(table: pa.Table) -> pa.Table:
        by = np.argsort(table["h"].to_numpy(), kind="stable")[:per_language]
        raw = np.frombuffer(b"".join(table["counts"][int(i)].as_py() for i in by), np.float32).reshape(len(by), DIMS)
        v, apart = vectors(raw, idf), np.arange(len(by)) % 3 == 2
        c = cluster(v[~apart], centroids)
        judged = apart if apart.any() else ~apart
        return pa.table({"lang": table["lang"].slice(0, 1), "centroids": pa.array([c.astype(np.float32).tobytes()]), "near": pa.array([(v[judged] @ c.T).max(axis=1).astype(float).tolist()]), "bands": pa.array([band(raw[judged]).tolist()])})

    got = picked.select("lang", "h", letters(F.col("text")).alias("norm")).where("norm rlike '\\\\S'").mapInArrow(vector, "lang string, h long, counts binary")
    found = got.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, near array<double>, bands array<long>").limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages in the column lang; raise `languages` (a language's centroids take {4 * DIMS * centroids} bytes), or clean the column")
    if not found:
        return none
    found = sorted(found, key=lambda r: r["lang"])
    directions = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in found]
    names = [r["lang"] for r, c in zip(found, directions) for _ in c]
    return Model(idf, np.concatenate(directions), names, limits(np.concatenate([r["near"] for r in found]), np.concatenate([r["bands"] for r in found]), spread))


def limits(near: np.ndarray, bands: np.ndarray, spread: float) -> np.ndarray:
    """The least cosine accepted in each band: `spread` times the median absolute deviation below the median, and never above what all but the lowest hundredth reach."""
    out = np.zeros(BANDS)
    for b in range(BANDS):
        own = near[bands == b]
        if len(own) >= ENOUGH:
            mid = np.median(own)
            out[b] = min(mid - spread * np.median(np.abs(own - mid)), np.quantile(own, 0.01))
        else:
            around = near[np.abs(bands - b) <= 1]
            out[b] = 0.8 * around.min() if len(around) else 0.0
    return out


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_found, cosine) for every row of `docs`.

    lang_found is `und` for texts without letters (null, empty, digits alone;
    cosine 0) and for those too far from every centroid; otherwise a language
    that was learned.  Whole texts are read.  Each row stands for itself: a
    null or repeated doc_id is passed through.  Of equally near centroids the
    first in order of language counts.  An empty table gives no rows; extra
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                if piece.num_rows:
                    raw = np.array([len(x) <= 2 for x in piece.column("norm").to_pylist()])
                    lang, cos = model.predict(piece.column("norm"), raw)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(cos, 6))], ["doc_id", "lang_found", "cosine"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), letters(F.col("text")).alias("norm")).mapInArrow(run, "doc_id long, lang_found string, cosine double")

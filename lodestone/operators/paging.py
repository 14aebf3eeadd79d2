"""Pages of ranked results with opaque cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CursorError(ValueError):
    pass


def encode(source: str, score: float, offset: int, fingerprint: str = "") -> str:
    raw = json.dumps({"s": source, "c": score, "o": offset, "f": fingerprint}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode(cursor: str, fingerprint: str = "") -> dict:
    """The cursor's fields; fails on a malformed one, a negative offset or another filter than it was made with."""
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        source, score, offset, made = str(got["s"]), float(got["c"]), int(got["o"]), str(got.get("f", ""))
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("malformed cursor") from e
    if offset < 0:
        raise CursorError("negative offset")
    if made != fingerprint:
        raise CursorError("the cursor belongs to another filter")
    return {"s": source, "c": score, "o": offset, "f": made}


def after(results: DataFrame, anchors: DataFrame, page: int) -> DataFrame:
    """The next `page` results of each query after its anchor (qid, anchor source), with has_more; nothing where the anchor isn't among them."""
    at = results.join(anchors.select("qid", F.col("anchor").alias("source")), ["qid", "source"]).select("qid", F.col("rank").alias("anchor_rank"))
    last = results.groupBy("qid").agg(F.max("rank").alias("last_rank"))
    rows = results.join(at, "qid").join(last, "qid").where((F.col("rank") > F.col("anchor_rank")) & (F.col("rank") <= F.col("anchor_rank") + page))
    return rows.withColumn("has_more", F.col("last_rank") > F.col("anchor_rank") + page).drop("anchor_rank", "last_rank")


def page(results: DataFrame, size: int, cursor: str | None = None, fingerprint: str = "") -> tuple[list, str | None]:
    """One query's page (rank, source, score), `size` rows, and the cursor of the next or None."""
    ordered = results.orderBy("rank")
    start, offset = 0, 0
    if cursor:
        c = decode(cursor, fingerprint)
        row = results.where(F.col("source") == c["s"]).agg(F.min("rank")).first()
        if row[0] is None:
            return [], None
        start, offset = row[0], c["o"]
    rows = ordered.where(F.col("rank") > start).limit(size + 1).collect()
    more, rows = len(rows) > size, rows[:size]
    return rows, encode(rows[-1]["source"], float(rows[-1]["score"]), offset + len(rows), fingerprint) if more else None

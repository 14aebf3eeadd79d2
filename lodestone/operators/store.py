"""The document store as relations: documents, collections, sections, metadata, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_actions(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, action): index what is new or has another etag, skip the same, delete what is gone."""
    both = listing.select("source", F.col("etag").alias("now")).join(stored.select("source", F.col("etag").alias("was")), "source", "full_outer")
    return both.select("source", F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("now") != F.col("was")), "index").otherwise("skip").alias("action"))


def digests(documents: DataFrame, prefix: str, page: int = 0, size: int = 500) -> DataFrame:
    """One page of (doc_id, source, etag) of sources with a prefix, by source."""
    return documents.where(F.col("source").startswith(prefix)).select("doc_id", "source", "etag").orderBy("source", "doc_id").offset(page * size).limit(size)


def listing(documents: DataFrame, bridge: DataFrame, source: str | None = None, pattern: str | None = None, orphaned: bool = False, collections: list[str] | None = None, order: str = "source", descending: bool = False, page: int = 0, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """A page of documents and the total of all pages; matching source, pattern, collections, or in no collection."""
    if order not in ("source", "created_at"):
        raise ValueError(f"can't sort by {order}")
    out = documents
    if source:
        out = out.where(F.col("source") == source)
    if pattern:
        out = out.where(F.col("source").contains(pattern))
    if orphaned:
        out = out.join(bridge.select("doc_id"), "doc_id", "left_anti")
    if collections:
        out = out.join(bridge.where(F.col("collection_id").isin(*collections)).select("doc_id"), "doc_id", "left_semi")
    by = F.col(order).desc() if descending else F.col(order).asc()
    return out.orderBy(by, "doc_id").offset(page * size).limit(size), out.agg(F.count("*").alias("total"))


def replaced(stored: DataFrame, incoming: DataFrame, key: str = "source") -> DataFrame:
    """Stored rows less those of sources that come in, and the incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def deleted(stored: DataFrame, gone: DataFrame, key: str = "source") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def looked_up(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the ids that are there."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def existing(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, found) for every id."""
    there = rows.select(key).distinct().withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(there, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def orphans(documents: DataFrame, bridge: DataFrame) -> DataFrame:
    return documents.join(bridge.select("doc_id"), "doc_id", "left_anti")


def obsolete(indexed: DataFrame, stored: DataFrame) -> DataFrame:
    """Indexed sections that the store hasn't."""
    return indexed.join(stored.select("section_id"), "section_id", "left_anti")


def language_histogram(documents: DataFrame, bridge: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """(lang, n): documents of each language, each counted once; without a language none."""
    own = bridge if collections is None else bridge.where(F.col("collection_id").isin(*collections))
    docs = documents.where("lang is not null and lang != ''").join(own.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang").distinct()
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


def collection_stats(documents: DataFrame, bridge: DataFrame) -> DataFrame:
    """(collection_id, total, languages) with a map of documents by language."""
    rows = documents.select("doc_id", "lang").join(bridge, "doc_id").select("collection_id", "doc_id", "lang").distinct()
    by = rows.groupBy("collection_id", "lang").agg(F.count("*").alias("n"))
    known = F.collect_list(F.when(F.coalesce("lang", F.lit("")) != "", F.struct("lang", "n")))
    return by.groupBy("collection_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(known)).alias("languages"))


def translation_targets(histogram: DataFrame, query_lang: str | None, most: int = 2) -> DataFrame:
    """The corpus' languages other than the query's, most documents first."""
    rows = histogram.where(F.col("lang") != query_lang) if query_lang else histogram
    return rows.orderBy(F.desc("n"), "lang").limit(most)


def blob_references(documents: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, hash): blobs that documents refer to, each once."""
    from lodestone.functions.text import blob_hashes

    return documents.select("doc_id", F.explode(blob_hashes(F.col(content))).alias("hash")).distinct()


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    return blobs.join(references.select("hash"), "hash", "left_anti")


def put_blobs(blobs: DataFrame, data: DataFrame, most: int = 10 << 20) -> DataFrame:
    """Blobs (hash, mime, size, data) with those of `data` (mime, data) that aren't there yet; larger ones fail."""
    new = data.select(F.sha2("data", 256).alias("hash"), "mime", F.length("data").cast("long").alias("size"), "data").dropDuplicates(["hash"])
    new = new.withColumn("size", F.when(F.col("size") <= most, F.col("size")).otherwise(F.raise_error(F.lit("a blob is too large")).cast("long")))
    return blobs.unionByName(new.join(blobs.select("hash"), "hash", "left_anti"))


def metadata_merged(base: Column, user: Column, lang: Column) -> Column:
    """Maps joined; the user's keys win over the parser's, the language over both."""
    extra = F.map_from_arrays(F.array(F.lit("lang")), F.array(lang))
    keep = lambda m, over: F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    user_lang = F.map_concat(keep(user, extra), extra)
    return F.map_concat(keep(base, user_lang), user_lang)


def encrypted(column: Column, key: Column) -> Column:
    """AES-256-GCM under a marker; base64."""
    return F.concat(F.lit("enc1:"), F.base64(F.aes_encrypt(column, key, F.lit("GCM"))))


def decrypted(column: Column, key: Column) -> Column:
    """What `encrypted` gave; text without the marker as it is."""
    plain = F.aes_decrypt(F.unbase64(F.substring(column, 6, 1 << 30)), key, F.lit("GCM")).cast("string")
    return F.when(column.startswith("enc1:"), plain).otherwise(column)

"""The queries of the ten training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, langid, licenses, lm, mixing, rules, sharding, urlfilter, warc
from lodestone.llm.common import saved
from lodestone.shared import deleted, new_path

ALLOW = ("tionble.example.org", "www.spam-farm.example.com/en", "blog.ththan.example.net", "example.com")
BLOCK = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org", "example.net", "tionble.example.org/de", "ththti.example.com/fr", "m.ththth.example.net")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), temperature=0.7).select("doc_id", "source", "mix_words", "mix_rate", "mix_copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), order=3)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), n=3, t=0.6)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"), shards=16, slack=0.02)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=13)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def page_records(pages: DataFrame) -> DataFrame:
    """A request and a response record for every page."""
    name = lambda kind: F.concat(F.lit(f"<urn:page:{kind}:"), F.col("page_id").cast("string"), F.lit(">"))
    record = lambda kind, status, payload: F.struct(F.lit(kind).alias("warc_type"), name(kind).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), F.lit(f"application/http; msgtype={kind}").alias("content_type"), status.alias("http_status"), F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("http_headers"), payload.cast("binary").alias("payload"))
    request = record("request", F.lit(None).cast("int"), F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    return pages.select(F.explode(F.array(request, record("response", F.lit(200), F.col("html")))).alias("r")).select("r.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC and read again: the responses alone, chosen by record type and content type."""
    path = new_path(spark, "warc")
    warc.write(page_records(table(spark, sf_dir, "pages")), path)
    records = warc.read(spark, path).where("warc_type = 'response' AND content_type LIKE 'application/http%'")
    page = F.regexp_extract("record_id", r"^<urn:page:response:(-?\d+)>$", 1).cast("bigint")
    out = saved(records.select(page.alias("page_id"), F.col("target_uri").alias("url"), "http_status", F.length("payload").cast("bigint").alias("n_bytes"), F.md5("payload").alias("html_md5")), "warc-pages")
    deleted(path)
    return out


OP10_SQL = "SELECT page_id, url, CAST(200 AS INTEGER) AS http_status, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS html_md5 FROM pages"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_mixing, op2_quality_rules, op3_lm_scores, op4_language_id, op5_jaccard_join, op6_url_filter, op7_sharding, op8_decontaminate, op9_license_scan, op10_warc)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": urlfilter.oracle(ALLOW, BLOCK), "op10_warc": OP10_SQL}

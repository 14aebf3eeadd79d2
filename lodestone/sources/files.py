"""Reading corpora, data sets and snapshots; writing snapshots."""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a snapshot by name; others are skipped on restoring.
PARTS = ("store-v1", "index-v1", "collections-v1", "blobs-v1")


def documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source, etag, size, extension, text) of every file below `path`; etag is hex(mtime)-hex(size)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    etag = F.concat_ws("-", F.lower(F.hex(F.unix_micros("modificationTime"))), F.lower(F.hex(F.col("length"))))
    return files.select(F.col("path").alias("source"), etag.alias("etag"), F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("content").cast("string").alias("text"))


def ignored(path: str, patterns: dict[str, list[str]]) -> bool:
    """Whether any folder's patterns (folder to lines, '' for the root) ignore a relative path; in one folder the last that matches counts."""
    out = False
    for folder, lines in patterns.items():
        if folder and not path.startswith(folder + "/"):
            continue
        inner, verdict = path[len(folder) + 1 if folder else 0 :], False
        parts = inner.split("/")
        for line in lines:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            keep, pattern = line.startswith("!"), line.lstrip("!").rstrip("/")
            if "/" in pattern:
                pattern = pattern.lstrip("/")
                hit = any(fnmatch.fnmatchcase("/".join(parts[: k + 1]), pattern) for k in range(len(parts)))
            else:
                hit = any(fnmatch.fnmatchcase(p, pattern) for p in parts)
            if hit:
                verdict = not keep
        out |= verdict
    return out


def squad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) of a SQuAD-like JSON: contexts once, under the first 16 digits of their SHA-1; questions that can be answered."""
    raw = spark.read.option("multiLine", "true").json(path)
    para = raw.select(F.explode("data").alias("d")).select(F.col("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
    para = para.select("title", F.col("p.context").alias("content"), F.substring(F.sha1("p.context"), 1, 16).alias("source"), F.col("p.qas").alias("qas"))
    corpus = para.select("source", "title", "content").dropDuplicates(["source"])
    q = para.select("source", F.explode("qas").alias("q"))
    possible = ~F.coalesce(F.col("q.is_impossible"), F.lit(False)) if "is_impossible" in q.selectExpr("q.*").columns else F.lit(True)
    return corpus, q.where(possible).select(F.col("q.id").alias("qid"), F.col("q.question").alias("query"), "source")


def beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels): qrels of positive scores, queries that have any; a header line isn't a row."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("source"), "title", F.col("text").alias("content"))
    lines = spark.read.schema("a string, b string, c string").option("sep", "\t").csv(f"{folder}/qrels/{split}.tsv")
    qrels = lines.select(F.col("a").alias("qid"), F.col("b").alias("source"), F.expr("try_cast(c as int)").alias("score")).where("score > 0")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), F.col("text").alias("query"))
    return corpus, queries.join(qrels.select("qid"), "qid", "left_semi"), qrels


def hotpot_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answers)."""
    return spark.read.option("multiLine", "true").schema("_id string, answer string").json(path).groupBy(F.col("_id").alias("qid")).agg(F.collect_list("answer").alias("answers"))


def strict_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of exactly this schema: unknown fields, broken lines and an empty file fail."""
    unknown = set(spark.read.json(path).columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if out.isEmpty():
        raise ValueError("no rows")
    return out


def backup(parts: dict[str, DataFrame], folder: str) -> None:
    """Writes each part as Parquet, and last the manifest that makes the snapshot valid."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = json.dumps(sorted(parts))
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The known parts of a snapshot."""
    names = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if n in PARTS}


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as `documents` writes the sources below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def publish(spark: SparkSession, legs: dict[str, Callable[[str], None]], folder: str) -> None:
    """All or nothing: each leg writes to a folder of this version; once all succeeded, one rename of the manifest makes it the current one.

    Readers take paths from `published`, so they see either version whole.  The
    version before stays for those who still read it; older ones are deleted.
    """
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    fs = path(folder).getFileSystem(conf)
    version = f"version-{uuid.uuid4().hex}"
    before = _manifest(spark, folder)
    try:
        for name, write in legs.items():
            write(f"{folder}/{version}/{name}")
        stream = fs.create(path(f"{folder}/{version}/manifest.json"))
        stream.write(bytearray(json.dumps({"version": version, "before": before.get("version"), "legs": sorted(legs)}).encode()))
        stream.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        at = fs.makeQualified(path(f"{folder}/manifest.json"))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(path(f"{folder}/{version}/manifest.json"), at, over)
    except BaseException:
        fs.delete(path(f"{folder}/{version}"), True)
        raise
    for found in fs.listStatus(path(folder)):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in (version, before.get("version")):
            fs.delete(found.getPath(), True)


def _manifest(spark: SparkSession, folder: str) -> dict:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where each leg of the current version is; empty before the first."""
    found = _manifest(spark, folder)
    return {name: f"{folder}/{found['version']}/{name}" for name in found.get("legs", [])}

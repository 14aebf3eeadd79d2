"""What the registered queries have in common: the relations they make of the test tables, here and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their collection (the table's column source) and a source of their own."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "n_chars", F.col("source").alias("collection_id"), F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"))


DOCS = "docs AS (SELECT doc_id, text, lang, n_chars, source AS collection_id, 'doc://' || source || '/' || doc_id AS source FROM documents)"


def bridge(docs: DataFrame) -> DataFrame:
    """(doc_id, collection_id); German documents are in the collection `german` too, those of src7 in none."""
    own = docs.where("collection_id != 'src7'").select("doc_id", "collection_id")
    return own.unionByName(docs.where("lang = 'de' and collection_id != 'src7'").select("doc_id", F.lit("german").alias("collection_id")))


BRIDGE = "bridge AS (SELECT doc_id, collection_id FROM docs WHERE collection_id <> 'src7' UNION ALL SELECT doc_id, 'german' FROM docs WHERE lang = 'de' AND collection_id <> 'src7')"


def with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metadata as VARIANT; quality and toxic are missing where there is no label."""
    labels = table(spark, sf_dir, "labels")
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.withColumn("metadata", F.expr("parse_json(to_json(struct(lang, collection_id, n_chars, quality, toxic)))"))


META = f"{DOCS}, meta AS (SELECT docs.*, quality, toxic FROM docs LEFT JOIN labels USING (doc_id))"


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, source, section_id, branch, place, level, content): the document, its lines, their sentences."""
    root = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    whole = docs.select("doc_id", "source", root.alias("section_id"), F.array(root).alias("branch"), F.lit(0).alias("level"), F.col("text").alias("content"))
    line = docs.select("doc_id", "source", root.alias("root"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    line = line.withColumn("section_id", F.concat("root", F.lit("/"), (F.col("i") + 1).cast("string")))
    sentence = line.select("doc_id", "source", "root", F.col("section_id").alias("parent"), F.posexplode(F.split("content", r"\. ")).alias("j", "content"))
    sentence = sentence.withColumn("section_id", F.concat("parent", F.lit("/"), (F.col("j") + 1).cast("string")))
    lines = line.select("doc_id", "source", "section_id", F.array("root", "section_id").alias("branch"), F.lit(1).alias("level"), "content")
    sentences = sentence.select("doc_id", "source", "section_id", F.array("root", "parent", "section_id").alias("branch"), F.lit(2).alias("level"), "content")
    return whole.unionByName(lines).unionByName(sentences).where("trim(content) != ''")


SECTIONS = r"""lines AS (SELECT doc_id, source, 's' || doc_id AS root, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS content FROM docs),
sentences AS (SELECT doc_id, source, root, root || '/' || i AS parent, generate_subscripts(string_split(content, '. '), 1) AS j, unnest(string_split(content, '. ')) AS content FROM lines),
sections AS (SELECT * FROM (
  SELECT doc_id, source, 's' || doc_id AS section_id, ['s' || doc_id] AS branch, 0 AS level, text AS content FROM docs
  UNION ALL SELECT doc_id, source, root || '/' || i, [root, root || '/' || i], 1, content FROM lines
  UNION ALL SELECT doc_id, source, parent || '/' || j, [root, parent, parent || '/' || j], 2, content FROM sentences) WHERE trim(content) <> '')"""


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nd}}]+')"


def bm25_sql(docs: str = "docs", queries: str = "benchmark", qid: str = "item_id", name: str = "scored", key: str = "doc_id", text: str = "text") -> str:
    """CTEs up to `name` (qid, key, len, terms, score)."""
    p = name
    return f"""{p}_d AS (SELECT {key}, {tok(text)} AS w FROM {docs}),
{p}_st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM {p}_d),
{p}_q AS (SELECT DISTINCT qid, term FROM (SELECT {qid} AS qid, unnest({tok("text")}) AS term FROM {queries})),
{p}_tf AS (SELECT {key}, l, term, count(*) AS tf FROM (SELECT {key}, len(w) AS l, unnest(w) AS term FROM {p}_d) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf WHERE term IN (SELECT term FROM {p}_q) GROUP BY term),
{p} AS (SELECT qid, {key}, any_value(l) AS len, count(*) AS terms,
  round(sum(greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM {p}_tf JOIN {p}_df USING (term) JOIN {p}_q USING (term), {p}_st GROUP BY qid, {key})"""


def top_sql(name: str, scored: str, k: int, order: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {scored}) WHERE rank <= {k})"

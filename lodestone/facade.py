"""The engine as one object over a store of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.functions import text as T
from lodestone.operators import filters, fusion, lexical, orchestrate, paging, parse, render, rerank, store, vector
from lodestone.shared import saved_table
from lodestone.sources import files

#: (id, text) -> (id, embedding)
Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    max_words: int = 250
    total_words: int = 8000
    page: int = 5
    min_grounding: float = orchestrate.MIN_SCORE
    rounds: int = orchestrate.MAX_ROUNDS
    sub_queries: int = orchestrate.SUB_QUERIES
    mode: str = "demote"
    weights: dict[str, float] = field(default_factory=lambda: dict(rerank.DEFAULT))
    #: Share of each leg in the fused score, where there is an embedder.
    legs: dict[str, float] = field(default_factory=lambda: {"lexical": 0.5, "vector": 0.5})
    rerank: bool = True
    #: Turns text into index terms; the same for sections and queries unless `query_analyzer` is set.
    analyzer: Callable = T.tokens
    #: (qid, text) -> (qid, text), before each leg that is named here.
    transformers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


PROFILES = {"fast": Config(rounds=0, rerank=False), "balanced": Config(), "precision": Config(rounds=1, mode="filter")}


class Engine:
    """Documents and sections as DataFrames; searches take one query or a table of them.

    A document is (doc_id, source, etag, text, lang, metadata as JSON); metadata
    is kept in the canonical form of `filters`.  Changes stay in memory as plans
    until `flush` writes all tables at once and reads them back; `opened` is an
    engine on what was flushed.  With `embed` searches have a vector leg as
    well, fused with the lexical one.
    """

    COLUMNS = "doc_id string, source string, etag string, text string, lang string, metadata string"
    TABLES = {
        "store-v1": ("documents", COLUMNS),
        "index-v1": ("bridge", "doc_id string, collection_id string"),
        "collections-v1": ("collections", "collection_id string, label string, description string"),
        "blobs-v1": ("blobs", "hash string, mime string, size long, data binary"),
        "sections-v1": ("_sections", parse.SECTIONS),
        "vectors-v1": ("_vectors", "section_id string, embedding array<double>"),
    }

    def __init__(self, spark: SparkSession, config: Config | None = None, embed: Embed | None = None):
        self.spark, self.config, self.embed = spark, config or Config(), embed
        for name, schema in self.TABLES.values():
            setattr(self, name, spark.createDataFrame([], schema))
        self._sections = self._vectors = None

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, config: Config | None = None, embed: Embed | None = None) -> Engine:
        out = cls(spark, config, embed)
        out._take(files.published(spark, folder))
        return out

    def _take(self, paths: dict[str, str]) -> None:
        self._sections = self._vectors = None
        for part, path in paths.items():
            if part in self.TABLES:
                name, schema = self.TABLES[part]
                setattr(self, name, self.spark.read.schema(schema).parquet(path))

    def _changed(self) -> None:
        self._sections = self._vectors = None

    def flush(self, folder: str) -> None:
        """Writes every table below `folder`, sections and vectors too, all or nothing, and goes on from what was written."""
        parts = {part: getattr(self, name) for part, (name, _) in self.TABLES.items() if name[0] != "_"}
        parts["sections-v1"] = self.sections
        if self.embed:
            parts["vectors-v1"] = self.vectors
        files.publish(self.spark, {part: df.write.parquet for part, df in parts.items()}, folder)
        self._take(files.published(self.spark, folder))

    def reindex(self, folder: str, config: Config | None = None) -> None:
        """Parses and embeds all documents anew, under another configuration if one is given, and flushes."""
        self.config = config or self.config
        self._changed()
        self.flush(folder)

    def create_collection(self, collection_id: str, label: str, description: str = "") -> None:
        new = self.spark.createDataFrame([(collection_id, label, description)], self.collections.schema)
        self.collections = store.replaced(self.collections, new, "collection_id")

    def delete_collection(self, collection_id: str) -> None:
        self.collections = self.collections.where(F.col("collection_id") != collection_id)
        self.bridge = self.bridge.where(F.col("collection_id") != collection_id)

    def index(self, docs: DataFrame, collections: list[str] | None = None) -> None:
        """Adds documents, in place of those of the same source."""
        new = docs.select(*self.documents.columns).withColumn("metadata", filters.canonical_json(F.col("metadata")))
        gone = store.looked_up(new.select("source"), self.documents, "source")
        self.bridge = self.bridge.join(gone.select("doc_id"), "doc_id", "left_anti").join(new.select("doc_id"), "doc_id", "left_anti")
        self.documents = store.replaced(self.documents, new)
        if collections:
            self.bridge = self.bridge.unionByName(new.select("doc_id", F.explode(F.array(*(F.lit(c) for c in collections))).alias("collection_id")))
        self._changed()

    def index_files(self, folder: str, glob: str | None = None, collections: list[str] | None = None, ignore: dict[str, list[str]] | None = None) -> DataFrame:
        """Takes in the files below `folder`: new and changed ones are indexed, those that are gone deleted.  Returns (source, action)."""
        found = files.documents(self.spark, folder, glob)
        if ignore:
            root = F.udf(lambda p: files.ignored(p.split(folder.rstrip("/") + "/", 1)[-1], ignore), BooleanType())
            found = found.where(~root("source"))
        below = self.documents.where(F.col("source").startswith(files.qualified(self.spark, folder)))
        actions = saved_table(store.sync_actions(found, below), "sync")
        new = found.join(actions.where("action = 'index'").select("source"), "source", "left_semi")
        meta, body = T.front_matter(F.col("text"))
        facts = F.map_from_arrays(F.array(F.lit("extension"), F.lit("size")), F.array(F.col("extension"), F.col("size").cast("string")))
        lang = F.coalesce(T.guess_language(body), F.lit(""))
        merged = store.metadata_merged(facts, F.coalesce(meta, F.create_map().cast("map<string,string>")), lang)
        self.delete_by_source(*(r["source"] for r in actions.where("action = 'delete'").select("source").toLocalIterator()))
        self.index(saved_table(new.select(F.substring(F.sha2("source", 256), 1, 16).alias("doc_id"), "source", "etag", body.alias("text"), lang.alias("lang"), F.to_json(merged).alias("metadata")), "files"), collections)
        return actions

    def put_blobs(self, data: DataFrame) -> None:
        """Stores (mime, data) under SHA-256."""
        self.blobs = store.put_blobs(self.blobs, data)

    def delete_by_source(self, *sources: str) -> None:
        gone = self.spark.createDataFrame([(s,) for s in sources], "source string")
        self.documents = store.deleted(self.documents, gone)
        self._changed()

    def cleanup(self) -> None:
        """Drops documents that are in no collection, bridges to documents that are gone, and blobs that no text refers to."""
        self.documents = self.documents.join(self.bridge.select("doc_id"), "doc_id", "left_semi")
        self.bridge = self.bridge.join(self.documents.select("doc_id"), "doc_id", "left_semi")
        self.blobs = self.blobs.join(store.blob_references(self.documents, "text"), "hash", "left_semi")
        self._changed()

    @property
    def sections(self) -> DataFrame:
        """Every document's section tree; parsed once, until documents change."""
        if self._sections is None:
            self._sections = saved_table(parse.sections(self.documents, "source", self.config.max_words), "sections")
        return self._sections

    @property
    def vectors(self) -> DataFrame:
        """Every section's embedding; made once, until documents change."""
        if self._vectors is None:
            made = self.embed(self.sections.select(F.col("section_id").alias("id"), F.col("content").alias("text")))
            self._vectors = saved_table(made.select(F.col("id").alias("section_id"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
        return self._vectors

    def _leg(self, name: str, queries: DataFrame) -> DataFrame:
        how = self.config.transformers.get(name)
        return how(queries) if how else queries

    def candidates(self, queries: DataFrame, most: int, collections: list[str] | None = None, conditions: list[filters.Condition] | None = None) -> DataFrame:
        """(qid, rank, source, section_id, score) of queries (qid, text): filters act before anything is ranked; sections that hold other hits are left out."""
        docs = lexical.restricted(self.documents, self.bridge, collections) if collections else self.documents
        if conditions:
            docs = docs.withColumn("meta", F.expr("try_parse_json(metadata)")).where(filters.compile_filter(conditions, "meta"))
        tree = self.sections.join(docs.select("doc_id", "source"), "doc_id")
        own = tree.select("section_id", F.col("content").alias("text")) if collections or conditions else self.sections.select("section_id", F.col("content").alias("text"))
        hits = lexical.best(own, self._leg("lexical", queries), "qid", fusion.leg_limit(most), "section_id", analyzer=self.config.analyzer)
        if self.embed:
            near = self._near(tree, self._leg("vector", queries), fusion.leg_limit(most))
            legs = [(hits, "lexical"), (near, "vector")]
            parts = [h.select("qid", "section_id", "rank").withColumn("weight", F.lit(float(self.config.legs[n]))) for h, n in legs]
            hits = fusion.rrf(parts[0].unionByName(parts[1]), "section_id", keep=fusion.leg_limit(most))
        known = saved_table(hits.join(tree.select("section_id", "source", "branch", "content"), "section_id").select("qid", "source", "section_id", "branch", "content", "score", "rank"), "hits")
        kept = fusion.without_ancestors(known)
        if self.config.rerank:
            pool = kept.select("qid", "section_id", F.col("score").alias("prior"), "content")
            scored = rerank.blended(rerank.features(pool, queries.select("qid", F.col("text").alias("query"))), self.config.weights)
            kept = kept.drop("score", "rank").join(scored.select("qid", "section_id", "score"), ["qid", "section_id"])
        return fusion.ranked(kept, F.desc("score"), "section_id", keep=most).select("qid", "rank", "source", "section_id", "score")

    def _near(self, tree: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        """(qid, section_id, rank) of the nearest sections; vectors have numbers for the search."""
        rows = self.vectors.join(tree.select("section_id"), "section_id", "left_semi")
        rows = saved_table(rows.select("section_id", "embedding", F.monotonically_increasing_id().alias("vec_id")), "numbered")
        asked = saved_table(self.embed(queries.select(F.col("qid").cast("string").alias("id"), "text")).select("id", "embedding", F.monotonically_increasing_id().alias("vec_id")), "asked")
        found = vector.knn(asked, rows, most, "cosine", not_self=False)
        names = asked.select(F.col("vec_id").alias("qid"), "id").join(queries.select(F.col("qid").alias("own"), F.col("qid").cast("string").alias("id")), "id")
        return found.join(names.select("qid", "own"), "qid").join(rows.select("vec_id", "section_id"), "vec_id").select(F.col("own").alias("qid"), "section_id", "rank")

    def search(self, query: str, most: int | None = None, collections: list[str] | None = None, conditions: list[filters.Condition] | None = None) -> DataFrame:
        queries = self.spark.createDataFrame([("q", query)], "qid string, text string")
        most = most or self.config.page
        hits = self.candidates(queries, fusion.target(0, most), collections, conditions)
        grouped = hits.groupBy("qid", "source").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list("section_id")).alias("sections"))
        return fusion.ranked(grouped, F.desc("score"), "source", keep=most)

    def search_where(self, query: str, keep: Callable[[DataFrame], DataFrame], most: int | None = None, **how) -> DataFrame:
        """Results that a filter on documents (doc_id, source, lang, metadata), applied after the ranking, lets through.

        The window begins at three times the results wanted and triples until
        enough have passed, it holds fusion.MOST, or there is nothing more.
        """
        most = most or self.config.page
        verdicts = None
        for window in fusion.postfilter_windows(most, fusion.MOST):
            hits = saved_table(self.search(query, window, **how), "window")
            new = hits.select("source") if verdicts is None else hits.select("source").join(verdicts.select("source"), "source", "left_anti")
            asked = self.documents.select("doc_id", "source", "lang", "metadata").join(new, "source", "left_semi")
            good = keep(asked).select("source").distinct().withColumn("good", F.lit(True))
            judged = saved_table(new.join(good, "source", "left").select("source", F.coalesce("good", F.lit(False)).alias("good")), "verdicts")
            verdicts = judged if verdicts is None else verdicts.unionByName(judged)
            passed = hits.join(verdicts.where("good").select("source"), "source", "left_semi")
            if passed.count() >= most or hits.count() < window:
                break
        return fusion.ranked(passed.drop("rank"), F.desc("score"), "source", keep=most)

    def search_page(self, query: str, size: int | None = None, cursor: str | None = None, **how) -> tuple[list, str | None]:
        mark = filters.fingerprint(how.get("conditions") or [])
        offset = paging.decode(cursor, mark)["o"] if cursor else 0
        size = size or self.config.page
        results = self.search(query, fusion.target(offset, size), **how)
        return paging.page(results, size, cursor, mark)

    def search_iterative(self, query: str, evaluate=None, reformulate=None, **how) -> DataFrame:
        ask = lambda q: self.candidates(q.withColumnRenamed("query", "text"), fusion.POOL, **how).select("qid", "rank", "source", "section_id")
        steps = orchestrate.Iterative(ask, evaluate, reformulate, self.config.mode, self.config.rounds, self.config.min_grounding)
        return steps.run(self.spark.createDataFrame([("q", query)], "qid string, query string"))

    def search_parts(self, query: str, parts: list[str], most: int | None = None, **how) -> DataFrame:
        """The query and up to `sub_queries` of its parts searched apart; each section counts for the first that found it."""
        asked = self.spark.createDataFrame([("q", query)], "qid string, query string")
        listed = self.spark.createDataFrame([("q", n, p) for n, p in enumerate(parts, 1)], "qid string, n int, part string")
        each = orchestrate.sub_queries(asked, listed, self.config.sub_queries).select(F.col("grp").cast("string").alias("qid"), F.col("query").alias("text"))
        hits = self.candidates(saved_table(each, "parts"), most or self.config.page, **how)
        return fusion.fuse_groups(hits.select(F.lit("q").alias("qid"), F.col("qid").cast("int").alias("grp"), "rank", "source", "section_id"))

    def check_grounding(self, query: str, evaluate, hits: DataFrame) -> DataFrame:
        """(qid, status, score) of hits (qid, rank, source, section_id) under an evaluator; without hits invalid and 0, if it fails partial and 0.5."""
        asked = self.spark.createDataFrame([("q", query)], "qid string, query string")
        hits = saved_table(hits.select("qid", "rank", "source", "section_id"), "evidence")
        return orchestrate.grounded(asked, hits, evaluate)

    def prompt(self, hits: DataFrame) -> DataFrame:
        """(qid, section_id, taken, content): the beginnings of hits' sections that a prompt of `total_words` has room for."""
        rows = hits.join(self.sections.select("section_id", "content"), "section_id").select("qid", F.col("rank").alias("place"), "section_id", "content", F.size(T.split_words(F.col("content"))).alias("words"))
        cut = render.prompt_words(rows, total=self.config.total_words).where("taken > 0")
        return cut.select("qid", "section_id", "taken", F.array_join(F.slice(F.filter(F.split("content", r"\s+"), lambda w: w != ""), F.lit(1), F.col("taken")), " ").alias("content"))

    def sections_by_id(self, *ids: str) -> DataFrame:
        return self.sections.where(F.col("section_id").isin(*ids))

    def backup(self, folder: str) -> None:
        """A snapshot of documents, collections, the bridge between them, and blobs."""
        files.backup({part: getattr(self, name) for part, (name, _) in self.TABLES.items() if name[0] != "_"}, folder)

    def restore(self, folder: str) -> None:
        """Takes over what a snapshot has; parts that it hasn't are left as they are."""
        for part, df in files.restore(self.spark, folder).items():
            setattr(self, self.TABLES[part][0], df)
        self._changed()

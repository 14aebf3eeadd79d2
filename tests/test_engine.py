import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone import shared
from lodestone.facade import PROFILES, Config, Engine
from lodestone.functions import text as T
from lodestone.operators import evaluate, filters, fusion, lexical, orchestrate, paging, parse, rerank, store, vector
from lodestone.operators.filters import Condition
from lodestone.plans import ranking as plans_ranking
from lodestone.plans import relations
from lodestone.sources import files
from lodestone.streaming import sync

META = [
    {"s": "abc", "n": 3, "f": 3.5, "b": True, "z": None, "a": [1], "o": {"x": 1}, "t": "2024-05-01T10:00:00Z", "k-1": "x"},
    {"s": "3", "n": "3", "f": 3, "b": "true", "t": "2024-05-01T12:00:00+02:00"},
    {"s": "Ünï", "n": -1e3, "b": False, "z": 0},
    {},
    None,
]
VALUES = ["abc", "3", 3, 3.0, 3.5, True, False, None, "2024-05-01T10:00:00Z", "", -1000, "zz", "Ünï"]


def test_filters_agree_with_python(spark):
    rows = [(i, None if m is None else json.dumps(filters.canonical_metadata(m))) for i, m in enumerate(META)]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("metadata", F.expr("try_parse_json(j)"))
    conditions = [Condition(k, op, v) for k in ("s", "n", "f", "b", "z", "a", "o", "t", "k-1", "missing") for op in filters.OPERATORS for v in ([["abc", 3, True], [], 3.0] if op == "in" else [None] if "exists" in op else VALUES)]
    for part in itertools.batched(conditions, 120):
        got = df.select("id", *(filters.compile_filter([c]).alias(str(i)) for i, c in enumerate(part))).collect()
        for r in got:
            for i, c in enumerate(part):
                assert r[str(i)] == filters.matches([c], META[r["id"]]), (c, META[r["id"]])


@pytest.mark.parametrize(
    ("text", "want"),
    [("a=1", Condition("a", "eq", 1.0)), ("a!=x", Condition("a", "ne", "x")), ("a>=2", Condition("a", "gte", 2.0)), ("a<=b=c", Condition("a", "lte", "b=c")), ("a>1", Condition("a", "gt", 1.0)), ("a<1", Condition("a", "lt", 1.0)), ("a?", Condition("a", "exists")), ("!a", Condition("a", "not_exists")), ("a=true", Condition("a", "eq", True)), ("a=", Condition("a", "eq", ""))],
)
def test_filter_grammar(text, want):
    assert filters.parse(text) == want


@pytest.mark.parametrize("text", ["a", "a b=1", "=1", "x" * 129 + "=1", "!a.b"])
def test_filter_grammar_errors(text):
    with pytest.raises(ValueError):
        filters.parse(text)


def test_fingerprint_ignores_order():
    a, b = Condition("a", "in", [1, 2]), Condition("b", "eq", "x")
    assert filters.fingerprint([a, b]) == filters.fingerprint([b, Condition("a", "in", [2, 1, 1])]) != filters.fingerprint([a])
    assert filters.fingerprint([Condition("a", "eq", 1)]) == filters.fingerprint([Condition("a", "eq", 1.0)]) != filters.fingerprint([Condition("a", "eq", True)])


def test_cursor(spark):
    results = spark.createDataFrame([(i, f"s{i}", 1.0 / i) for i in range(1, 8)], "rank int, source string, score double")
    seen, cursor = [], None
    while True:
        rows, cursor = paging.page(results, 3, cursor, "f")
        seen += [r["source"] for r in rows]
        if cursor is None:
            break
    assert seen == [f"s{i}" for i in range(1, 8)]
    assert paging.page(results, 3, paging.encode("gone", 1, 3)) == ([], None)
    for bad, mark in (("%%", ""), (paging.encode("a", 1, -1), ""), (paging.encode("a", 1, 1, "x"), "y"), ("e30", "")):
        with pytest.raises(paging.CursorError):
            paging.decode(bad, mark)


def test_candidate_windows():
    assert [fusion.target(0, 5), fusion.target(0, 200), fusion.target(400, 200), fusion.target(0, 5, 7), fusion.target(3, 2, filtered=True)] == [100, 201, 500, 7, 6]
    assert fusion.postfilter_windows(6, 1000) == [18, 54, 162, 486, 500] and fusion.leg_limit(0) == 6
    assert [vector.ann_breadth(x) for x in (1, 100, 10_000)] == [40, 200, 1000]


def test_ancestors(spark):
    rows = [("q", "d", b[-1], b) for b in (["r"], ["r", "a"], ["r", "a", "x"], ["r", "b", "y", "z"], ["r", "b"])]
    got = fusion.without_ancestors(spark.createDataFrame(rows, "qid string, source string, section_id string, branch array<string>"))
    assert {r["section_id"] for r in got.collect()} == {"b", "x"}


def test_knn_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    r = np.random.default_rng(0)
    v = r.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>").repartition(5)
    for metric in ("l2", "hamming"):
        got = {(x["qid"], x["rank"]): x["vec_id"] for x in vector.knn(df, df, 3, metric).collect()}
        for i in range(60):
            d = [np.linalg.norm(v[i] - v[j]) if metric == "l2" else ((v[i] > 0) != (v[j] > 0)).sum() for j in range(60)]
            want = sorted((round(float(d[j]), 4), j) for j in range(60) if j != i)[:3]
            assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in want]


def test_knn_orders_by_full_distance(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    v = spark.createDataFrame([(2, [0.50004, 0.0]), (3, [0.50001, 0.0]), (4, [0.7, 0.0]), (5, [None, 1.0]), (6, None)], q.schema)
    assert [(r["vec_id"], r["distance"]) for r in vector.knn(q, v, 2).orderBy("rank").collect()] == [(3, 0.5), (2, 0.5)]
    assert [r["vec_id"] for r in vector.coarse(q, v.where("vec_id < 5"), 2).orderBy("rank").collect()] == [3, 2]
    r = np.random.default_rng(4)
    rows = [(k, (np.ones(16) * 1e4 + r.normal(0, 1e-3, 16)).tolist()) for k in range(60)]
    far = spark.createDataFrame(rows, q.schema)
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {(x["qid"], x["rank"]): x["vec_id"] for x in vector.knn(far, far, 3).collect()}
    assert got == {(i, n + 1): int(j) for i in range(60) for n, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


@pytest.mark.parametrize("meetings", [50, 1 << 22])
def test_best_equals_bm25(spark, sf_dir, monkeypatch, meetings):
    monkeypatch.setattr(lexical, "MEETINGS", meetings)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "...")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, "zzzzqqq")], "item_id long, text string"))
    only = docs.where("doc_id % 3 = 0").select("doc_id")
    plain = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "len", "terms", "score", "rank").collect()))
    scored = lexical.bm25(docs, asked, "item_id")
    want, few = plain(lexical.top(scored, 7, "doc_id")), plain(lexical.top(scored.join(only, "doc_id", "left_semi"), 7, "doc_id"))
    assert plain(lexical.best(docs, asked, "item_id", 7)) == want and len(want) > 50
    assert plain(lexical.best(docs, asked, "item_id", 7, only=only)) == few
    assert lexical.best(docs, asked.where("item_id < 0"), "item_id", 7).count() == lexical.best(docs.limit(0), asked, "item_id", 7).count() == 0
    monkeypatch.setattr(lexical, "QUERY_TERMS", 3)
    assert plain(lexical.best(docs, asked, "item_id", 7, only=only)) == few


def test_analyzers(spark):
    en = lexical.analyzed(lambda w: F.regexp_replace(w, "(ing|s)$", ""))
    de = lexical.analyzed(lambda w: F.regexp_replace(w, "en$", ""), keep=False)
    rows = spark.createDataFrame([("the cats and the dog s",), ("die Katzen und der Hund",), ("zzz",)], "t string")
    got = rows.select(en(F.col("t")).alias("en"), lexical.by_language({"en": en, "de": de})(F.col("t")).alias("own"), lexical.by_languages({"en": en, "de": de})(F.col("t")).alias("all")).collect()
    assert got[0]["en"] == ["the", "cats", "and", "the", "dog", "s", "cat"] == got[0]["own"]
    assert got[1]["own"] == ["die", "katz", "und", "der", "hund"] and got[2]["own"] == ["zzz"]
    assert {"katzen", "de:katz", "en:katzen"} <= set(got[1]["all"])
    docs = spark.createDataFrame([(1, "cats purring"), (2, "a cat"), (3, "dogs")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "purr")], "q long, text string")
    found = lambda **k: {(r["qid"], r["doc_id"]) for r in lexical.best(docs, asked, "q", 5, **k).collect()}
    assert found() == {(1, 2)} and found(analyzer=en) == {(1, 1), (1, 2), (2, 1)}


def test_hyde_and_translations(spark):
    q = spark.createDataFrame([(1, "cats"), (2, "dogs"), (3, "owls")], "qid long, text string")
    made = orchestrate.hypothetical(q, lambda d: d.where("qid < 3").withColumn("text", F.when(F.col("qid") == 1, "they purr").otherwise(" ")))
    assert {r["qid"]: r["text"] for r in made.collect()} == {1: "cats\nthey purr", 2: "dogs", 3: "owls"}
    targets = spark.createDataFrame([("fr", 3), ("de", 2)], "lang string, n long")
    words = {("cats", "fr"): "chats", ("cats", "de"): "Katzen", ("dogs", "fr"): "dogs", ("dogs", "de"): "Hunde"}
    table = spark.createDataFrame([(*k, v) for k, v in words.items()], "text string, lang string, other string")
    wide = orchestrate.widened(q, targets, lambda d: d.join(table, ["text", "lang"]).select("qid", "lang", F.col("other").alias("text")))
    assert {r["qid"]: r["text"] for r in wide.collect()} == {1: "cats\nKatzen\nchats", 2: "dogs\nHunde", 3: "owls"}


def test_lazy_failures_of_the_judge(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x")], "qid int, rank int, source string, section_id string")
    broken = lambda h: (h.select("qid", F.raise_error(F.lit("model")).cast("string").alias("section_id")), h.select("qid", F.lit("valid").alias("status"), F.lit(1.0).alias("score")))
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "qid int, query string")
    with pytest.warns(UserWarning, match="without a verdict"):
        assert orchestrate.Iterative(lambda q: hits, broken).run(asked).count() == 1
    good = lambda h: (h.select("qid", "section_id"), h.select("qid", F.lit("VALID").alias("status"), F.lit(2.0).alias("score")))
    assert {tuple(r) for r in orchestrate.grounded(asked, hits, good).collect()} == {(1, "valid", 1.0), (2, "invalid", 0.0)}
    lazy = lambda h: (h, h.select("qid", F.raise_error(F.lit("model")).cast("string").alias("status"), F.lit(1.0).alias("score")))
    with pytest.warns(UserWarning, match="no verdict"):
        assert {tuple(r) for r in orchestrate.grounded(asked, hits, lazy).collect()} == {(1, "partial", 0.5), (2, "invalid", 0.0)}


def test_embedding_batches():
    assert vector.embedding_batches([3] * 250) == [list(range(100)), list(range(100, 200)), list(range(200, 250))]
    assert vector.embedding_batches([9000, 9000, 30, 60_000, 1]) == [[0, 1], [2], [3], [4]]


def test_proximity_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(1, f"s{i}", " ".join(r.choice("abcdxyz") for _ in range(r.randrange(1, 25))), 1.0) for i in range(60)]
    pool = spark.createDataFrame(rows, "qid int, section_id string, content string, prior double")
    asked = spark.createDataFrame([(1, "a b c d")], "qid int, query string")
    got = {x["section_id"]: x for x in rerank.features(pool, asked).collect()}
    for _, s, content, _ in rows:
        w = content.split()
        have = set(w) & set("abcd")
        width = min((j - i for i in range(len(w)) for j in range(i + 1, len(w) + 1) if have <= set(w[i:j])), default=0)
        want = 0 if not have else 0.25 if len(have) == 1 else len(have) / width * len(have) / 4
        assert got[s]["proximity"] == pytest.approx(want, abs=1e-6)
        assert got[s]["phrase"] == float("a b c d" in content)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "b")], "qid string, rank int, source string")
    qrels = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "a")], "qid string, source string")
    got = {(r["qid"], r["k"]): r for r in evaluate.per_query(run, qrels, [5, 0, 1, 5]).collect()}
    assert set(got) == {("q", 1), ("q", 5), ("r", 1), ("r", 5)}
    q = got["q", 5]
    assert (q["recall"], q["precision"], q["rr"], q["first_rank"]) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 0.5, 2)
    assert q["ndcg"] == pytest.approx((1 / np.log2(3) + 0.5) / (1 + 1 / np.log2(3) + 0.5), abs=1e-6)
    assert got["r", 5]["first_rank"] == -1 and got["r", 5]["ndcg"] == 0


def test_answers_by_hand(spark):
    rows = [(1, "The  cat!", ["cat", "dog"]), (2, "red big cat", ["a big cat sat"]), (3, "the", [""]), (4, "x", ["y"])]
    got = {r["id"]: (r["em"], r["f1"]) for r in evaluate.answers(spark.createDataFrame(rows, "id int, pred string, golds array<string>")).collect()}
    assert got == {1: (1, 1.0), 2: (0, pytest.approx(2 / 3, abs=1e-6)), 3: (1, 1.0), 4: (0, 0.0)}


MARKDOWN = "intro\n\n# One\ntext\n\n## Two\n```\n# not a heading\n```\n\nUnder\n=====\n### Deep ###\nend\n"


def test_section_tree():
    tree = parse.section_tree(MARKDOWN)
    assert [(n["level"], n["title"]) for n in tree] == [(0, ""), (1, "One"), (2, "Two"), (1, "Under"), (3, "Deep")]
    assert tree[2]["parent"] is tree[1] and tree[4]["parent"] is tree[3]
    assert MARKDOWN[tree[2]["start"] : tree[2]["end"]].startswith("## Two") and "not a heading" in MARKDOWN[tree[2]["start"] : tree[2]["end"]]
    whole = parse.section_tree("# All\nx\n")
    assert [(n["level"], n["title"]) for n in whole] == [(0, "All")]
    long = "\n\n".join(["word " * 100] * 9)
    forced = parse.section_tree(long)
    assert [n["level"] for n in forced] == [0, 1, 1] and forced[2]["parent"] is forced[0]
    assert parse.section_tree("") == [forced[0] | {"end": 0, "words": 0}]


def test_code_tree():
    py = "import x\n\n# about\n@dec\ndef a():\n    def b():\n        pass\n\nclass C:\n    def m(self): ...\n"
    tree = parse.code_tree("m.py", py)
    assert [(n["title"], n["level"]) for n in tree] == [("m.py", 0), ("a", 1), ("b", 2), ("C", 1), ("m", 2)]
    assert py[tree[1]["start"] :].startswith("# about")
    go = "package p\n\n// F does.\nfunc F() {\n\treturn\n}\n\ntype T struct {\n\ta int\n}\n"
    assert [n["title"] for n in parse.code_tree("a.go", go)] == ["a.go", "F", "T"]
    ts = "export async function run() {\n}\nclass K {\n}\n"
    assert [n["title"] for n in parse.code_tree("a.ts", ts)] == ["a.ts", "run", "K"]
    assert [n["title"] for n in parse.code_tree("a.yaml", "x: 1\ny:\n  z: 2\n")] == ["a.yaml", "x", "y"]
    assert len(parse.code_tree("a.py", "def broken(:\n")) == 1
    assert len(parse.code_tree("a.bin", "one two\n" * 400, 250)) == 5


def test_sections_rows(spark):
    docs = spark.createDataFrame([("d", MARKDOWN, "x.md"), ("e", None, None), ("p", "def f(): pass\n", "f.py"), (None, "x", "y")], "doc_id string, text string, name string")
    rows = parse.sections(docs, "name").collect()
    assert {r["doc_id"] for r in rows} == {"d", "e", "p"} and all(r["branch"][-1] == r["section_id"] for r in rows)
    assert all((r["parent_id"] is None) == (len(r["branch"]) == 1) for r in rows)
    images = spark.createDataFrame([(1, "![a](x.png) ![b](y.png 't') ![c](x.png)")], "doc_id int, text string")
    assert [r["destination"] for r in parse.image_references(images).collect()] == ["x.png", "y.png"]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.tokens(F.lit("Ab, c-1 É")).alias("tokens"), T.guess_language(F.lit("the cat and le chat")).alias("lang"), T.guess_language(F.lit("zzz")).alias("nolang"), T.seed(F.lit(" AbC ")).alias("seed"),
        T.middle_out(F.lit("a b c d e"), 3).alias("mid"), T.canonical_time(F.lit("2024-01-02 03:04:05.6").cast("timestamp")).alias("time"), T.html_text(F.lit("<p>a&amp;b<script>x</script> c</p><!-- n -->")).alias("html"), T.answer_normalised(F.lit("The $5, a Cat")).alias("answer"),
    ).first()
    import hashlib

    assert row["tokens"] == ["ab", "c", "1", "é"] and row["lang"] == "en" and row["nolang"] is None
    assert row["seed"] == int.from_bytes(hashlib.md5(b"abc").digest()[:4])
    assert row["mid"] == "a b [...] e" and row["time"] == "2024-01-02T03:04:05.600000000Z" and row["html"] == "a&b c" and row["answer"] == "5 cat"


def test_ignored():
    p = {"": ["*.log", "build/", "!keep.log", "/docs/*.md"], "sub": ["*.txt"]}
    got = [files.ignored(x, p) for x in ("a.log", "keep.log", "x/build/y", "docs/a.md", "x/docs/a.md", "a.txt", "sub/a.txt", "sub/keep.log")]
    assert got == [True, False, True, True, False, False, True, False]


def test_loaders(spark, tmp_path):
    data = {"data": [{"title": "t", "paragraphs": [{"context": "c one", "qas": [{"id": "1", "question": "q?", "is_impossible": False}, {"id": "2", "question": "r?", "is_impossible": True}]}, {"context": "c one", "qas": []}]}]}
    (tmp_path / "s.json").write_text(json.dumps(data))
    corpus, queries = files.squad(spark, str(tmp_path / "s.json"))
    assert corpus.count() == 1 and [r["qid"] for r in queries.collect()] == ["1"]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"d1","title":"","text":"x"}\n{"_id":"d2","title":"","text":"y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"a"}\n{"_id":"q2","text":"b"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\t0\n")
    c, q, rel = files.beir(spark, str(tmp_path))
    assert c.count() == 2 and [r["qid"] for r in q.collect()] == ["q1"] and rel.count() == 1
    schema = StructType([StructField("_id", StringType()), StructField("text", StringType())])
    assert files.strict_json(spark, str(tmp_path / "queries.jsonl"), schema).count() == 2
    with pytest.raises(ValueError):
        files.strict_json(spark, str(tmp_path / "queries.jsonl"), StructType([StructField("_id", StringType())]))
    (tmp_path / "h.json").write_text('[{"_id":"1","answer":"a"},{"_id":"1","answer":"b"}]')
    assert files.hotpot_answers(spark, str(tmp_path / "h.json")).first()["answers"] == ["a", "b"]
    assert files.documents(spark, str(tmp_path), "*.jsonl").count() == 2


def test_publish_is_all_or_nothing(spark, tmp_path):
    df, folder = spark.range(3), str(tmp_path / "i")
    assert files.published(spark, folder) == {}
    files.publish(spark, {"a": df.write.parquet, "b": df.write.parquet}, folder)
    read = lambda name: spark.read.parquet(files.published(spark, folder)[name]).count()
    assert read("b") == 3

    def fail(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.publish(spark, {"a": spark.range(5).write.parquet, "b": fail}, folder)
    assert (read("a"), read("b")) == (3, 3) and len(list((tmp_path / "i").glob("version-*"))) == 1
    for n in (5, 6, 7):
        files.publish(spark, {"a": spark.range(n).write.parquet, "b": spark.range(n).write.parquet}, folder)
        assert (read("a"), read("b")) == (n, n)
    assert len(list((tmp_path / "i").glob("version-*"))) == 2


def test_shared_folder(spark, monkeypatch):
    class Context:
        applicationId = "app"

        def __init__(self, master, at=None):
            self.master, self.at = master, at

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.at

    class Session:
        conf = {}

        def __init__(self, *how):
            self.sparkContext = Context(*how)

    monkeypatch.setattr(shared, "_OWN", {})
    assert shared.folder(Session("spark://x", "hdfs://n/c/")) == "hdfs://n/c"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]", "k8s://y"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.folder(Session(master))
    assert shared.folder(Session("local[4]")).startswith("file:///")
    own = Session("yarn", "hdfs://other")
    own.conf = {"spark.checkpoint.dir": "s3://named/"}
    assert shared.folder(own) == "s3://named"


def test_streaming_sync(spark, tmp_path):
    src, store_, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    put = lambda rows: spark.createDataFrame(rows, "source string, etag string, text string").write.mode("append").parquet(src)
    put([("a", "1", "x"), ("b", "1", "y")])
    sync.watch(spark, src, store_, check).awaitTermination()
    put([("a", "2", "z")])
    sync.watch(spark, src, store_, check).awaitTermination()
    assert {(r["source"], r["text"]) for r in sync.current(spark, store_).collect()} == {("a", "z"), ("b", "y")}


def test_windows_on_a_stream_equal_those_on_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = sync.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(sync.windowed(events).collect())


def test_iterative_rounds(spark):
    base = {"bad": ["x", "y"], "good": ["y", "z"]}

    def search(q):
        return q.select("qid", F.posexplode(F.when(F.col("query") == "bad", F.array(*map(F.lit, base["bad"]))).otherwise(F.array(*map(F.lit, base["good"])))).alias("i", "section_id")).select("qid", (F.col("i") + 1).alias("rank"), F.col("section_id").alias("source"), "section_id")

    def judge(hits):
        found = hits.where("section_id = 'z'").select("qid", "section_id")
        return found, hits.groupBy("qid").agg(F.max(F.when(F.col("section_id") == "z", 0.9).otherwise(0.1)).alias("score")).withColumn("status", F.lit("VALID"))

    asked = spark.createDataFrame([(1, "bad"), (2, "good")], "qid int, query string")
    reword = lambda q: q.withColumn("query", F.lit("good"))
    run = lambda **k: sorted((r["qid"], r["rank"], r["section_id"]) for r in orchestrate.Iterative(search, judge, reword, saved=lambda d: d, **k).run(asked).collect())
    assert run(mode="filter") == [(1, 3, "z"), (2, 2, "z")]
    assert run(rounds=0) == [(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (2, 2, "y")]
    assert orchestrate.Iterative(search, saved=lambda d: d).run(asked).count() == 4


def test_facade(spark, tmp_path):
    e = Engine(spark, Config(page=2))
    docs = [("1", "a.md", "1", "# Cats\ncats purr softly\n\n# Dogs\ndogs bark", "en", '{"year": 2024.0}'), ("2", "b.md", "1", "cats and dogs", "en", '{"year": 2019.0}'), ("3", "c.py", "1", "def cats():\n    pass\n", "en", None)]
    e.create_collection("pets", "Pets")
    e.index(spark.createDataFrame(docs[:2], Engine.COLUMNS), ["pets"])
    e.index(spark.createDataFrame(docs[2:], Engine.COLUMNS))
    sources = lambda df: [r["source"] for r in df.orderBy("rank").collect()]
    assert set(sources(e.search("cats", 5))) == {"a.md", "b.md", "c.py"}
    assert set(sources(e.search("cats", 5, collections=["pets"]))) == {"a.md", "b.md"}
    assert sources(e.search("cats", 5, conditions=[filters.parse("year>2020")])) == ["a.md"]
    first, cursor = e.search_page("cats")
    rest, end = e.search_page("cats", cursor=cursor)
    assert len(first) == 2 and len(rest) == 1 and end is None
    with pytest.raises(paging.CursorError):
        e.search_page("cats", cursor=cursor, conditions=[filters.parse("year>2020")])
    assert e.search_iterative("purr").count() >= 1 and PROFILES["fast"].rounds == 0
    e.backup(str(tmp_path / "b"))
    e.delete_by_source("a.md")
    assert set(sources(e.search("cats", 5))) == {"b.md", "c.py"}
    e.cleanup()
    assert e.documents.count() == 1
    e.restore(str(tmp_path / "b"))
    assert e.documents.count() == 3 and e.sections_by_id("1#0").count() == 1


def test_facade_dates_in_metadata(spark):
    """As users write them: through the engine, and on tables that weren't canonical before."""
    said = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2023-12-31T23:59:59.999999999Z", "2024-06-01t00:00:00.5z", "not a date", "2024-13-01T00:00:00Z"]
    rows = [(str(k), f"{k}.md", "1", "cats", "en", json.dumps({"d": d})) for k, d in enumerate(said)] + [("9", "9.md", "1", "cats", "en", "no json")]
    e = Engine(spark)
    e.index(spark.createDataFrame(rows, Engine.COLUMNS))
    raw = spark.createDataFrame(rows, Engine.COLUMNS).withColumn("meta", F.expr("try_parse_json(metadata)"))
    for op in ("eq", "ne", "gt", "gte", "lt", "lte"):
        for value in ("2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2023-12-31T23:59:59.9Z", "not a date"):
            c = [filters.Condition("d", op, value)]
            want = {f"{k}.md" for k, d in enumerate(said) if filters.matches(c, {"d": d})}
            assert {r["source"] for r in raw.where(filters.compile_filter(c, "meta")).collect()} == want, (op, value)
    c = [filters.Condition("d", "eq", said[0])]
    assert {r["source"] for r in e.search("cats", 9, conditions=c).collect()} == {"0.md", "1.md"}
    assert e.documents.where("doc_id = '1'").first()["metadata"] == '{"d": "2024-01-01T00:00:00.000000000Z"}'
    assert e.documents.where("doc_id = '9'").first()["metadata"] == "no json"


def test_facade_flush_backup_and_files(spark, tmp_path):
    for name, text in (("a.md", "# Cats\ncats purr"), ("b.md", "---\nowner: me\n---\ndogs bark"), ("skip.txt", "cats")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    embed = lambda d: d.select("id", F.array(F.col("text").contains("cats").cast("double"), F.col("text").contains("dogs").cast("double"), F.lit(0.1)).alias("embedding"))
    e = Engine(spark, Config(page=3), embed)
    actions = lambda **k: {r["source"].rsplit("/", 1)[-1]: r["action"] for r in e.index_files(str(tmp_path / "in"), **k).collect()}
    assert actions(ignore={"": ["*.txt"]}, collections=["pets"]) == {"a.md": "index", "b.md": "index"}
    e.create_collection("pets", "Pets")
    e.put_blobs(spark.createDataFrame([("a", bytearray(b"x"))], "mime string, data binary"))
    assert json.loads(e.documents.where("source like '%b.md'").first()["metadata"])["owner"] == "me"
    e.flush(str(tmp_path / "store"))
    names = lambda df: [r["source"].rsplit("/", 1)[-1] for r in df.orderBy("rank").collect()]
    other = Engine.opened(spark, str(tmp_path / "store"), embed=embed)
    assert names(other.search("cats"))[0] == "a.md" and names(other.search("dogs"))[0] == "b.md" and other.collections.count() == 1
    assert "MapInArrow" not in other.sections._jdf.queryExecution().toString()
    e.backup(str(tmp_path / "backup"))
    third = Engine(spark)
    third.restore(str(tmp_path / "backup"))
    assert (third.documents.count(), third.bridge.count(), third.collections.count(), third.blobs.count()) == (2, 2, 1, 1)
    (tmp_path / "in" / "a.md").write_text("owls hoot at night")
    (tmp_path / "in" / "b.md").unlink()
    assert actions(ignore={"": ["*.txt"]}) == {"a.md": "index", "b.md": "delete"}
    assert e.documents.count() == 1 and names(e.search("owls")) == ["a.md"]
    e.reindex(str(tmp_path / "store"), Config(max_words=2, page=3))
    assert files.published(spark, str(tmp_path / "store")).keys() >= {"vectors-v1", "sections-v1"}
    e.cleanup()
    assert e.blobs.count() == 0


def test_facade_windows_parts_and_prompt(spark):
    docs = [(str(k), f"d{k:03}", "1", "cats " * (k + 1), "fr" if k % 10 == 0 else "en", None) for k in range(100)]
    e = Engine(spark, Config(page=3, total_words=5, rerank=False))
    e.index(spark.createDataFrame(docs, Engine.COLUMNS))
    judged = []

    def french(d):
        judged.append(d.count())
        return d.where("lang = 'fr'")

    assert [r["source"] for r in e.search_where("cats", french, 3).orderBy("rank").collect()] == ["d090", "d080", "d070"]
    assert len(judged) >= 2 and sum(judged) <= 100
    assert e.search_where("cats", lambda d: d.where("false"), 3).count() == 0
    hits = e.search_parts("cats", ["dogs", "cats", "CATS"], 2)
    assert {r["position"] for r in hits.collect()} == {1, 2}
    asked = spark.createDataFrame([("q", "cats")], "qid string, text string")
    assert sum(r["taken"] for r in e.prompt(e.candidates(asked, 3)).collect()) == 5
    shout = Config(transformers={"lexical": lambda q: q.withColumn("text", F.lit("cats"))}, rerank=False)
    e.config = shout
    assert e.search("nothing", 2).count() == 2


def test_blob_limit_and_encryption(spark):
    empty = spark.createDataFrame([], "hash string, mime string, size long, data binary")
    data = spark.createDataFrame([("a", bytearray(b"x")), ("a", bytearray(b"x")), ("b", bytearray(b"yy"))], "mime string, data binary")
    assert store.put_blobs(empty, data).count() == 2
    with pytest.raises(Exception, match="too large"):
        store.put_blobs(empty, data, most=1).select("size").collect()
    key = F.lit(b"k" * 32)
    row = spark.range(1).select(store.decrypted(store.encrypted(F.lit("hä"), key), key).alias("a"), store.decrypted(F.lit("plain"), key).alias("b")).first()
    assert tuple(row) == ("hä", "plain")


def test_bm25_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x"), (2, None)], "qid long, text string")
    assert lexical.bm25(docs, asked, "qid").count() == 0
    assert LongType() == docs.schema["doc_id"].dataType


def test_language_of_most_text(spark):
    german, english = "der Hund und die Katze schlafen auf " + "x" * 200, "the cat and the dog of the man is to that it was for it and the"
    rows = [(0, f"{german}\n\n{english}", "de"), (1, english, "en"), (2, f"le\n\n{english}", "en"), (3, f"{'z' * 80}\n\nthe", "en"), (4, "le\n\n \n\nles", "fr"), (5, "zzz", None), (6, None, None), (7, "", None), (8, f"le {'q' * 70}\n\nel {'q' * 70}", "es")]
    got = spark.createDataFrame([r[:2] for r in rows], "i int, text string").select("i", T.guess_language(F.col("text")).alias("lang"), T.segments(F.col("text")).alias("s")).collect()
    assert {r["i"]: r["lang"] for r in got} == {i: lang for i, _, lang in rows}
    cut = {r["i"]: r["s"] for r in got}
    assert cut[0] == [german, english] and cut[2] == [f"le\n{english}"] and cut[3] == ["z" * 80] and cut[4] == ["le\nles"] and cut[7] == []


def test_postings_have_sentences(spark, tmp_path):
    text = "One two. Two three.\nThree."
    spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: (r["sections"], r["occurrences"]) for r in relations.postings_summary(spark, str(tmp_path)).collect()}
    assert got == {"one": (3, 3), "two": (4, 6), "three": (5, 6)}


def test_search_config_of_each_language(spark):
    """All codes and names, written out."""
    want = dict(x.split(":") for x in "ar:arabic da:danish nl:dutch en:english fi:finnish fr:french de:german el:greek hu:hungarian id:indonesian it:italian ga:irish lt:lithuanian ne:nepali nb:norwegian no:norwegian pt:portuguese ro:romanian ru:russian es:spanish sv:swedish ta:tamil tr:turkish".split())
    rows = spark.createDataFrame([(c,) for c in [*want, "xx", "", None]], "lang string").select("lang", T.search_config(F.col("lang")).alias("config")).collect()
    assert len(want) == 23 and {r["lang"]: r["config"] for r in rows} == want | {"xx": "simple", "": "simple", None: "simple"}


def exchanged(df):
    """What the plan of `df` shuffles by."""
    return {tuple(re.findall(r"(\w+)#", x)) for x in re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())}


def test_answers_shuffle_no_texts(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PAIRS", 3)
    rows = [(1, "a cat cat dog", ["The cat, cat!", "dog"]), (2, "", ["the"]), (3, "x", [""]), (4, None, ["x"]), (5, "x", [None, "x x"]), (6, "p q r", ["s"]), (6, "r q p", ["p r q z", "q"]), (7, "Q r", ["q R"])]
    got = evaluate.answers(spark.createDataFrame(rows, "id int, pred string, golds array<string>"))
    assert {r["id"]: (r["em"], r["f1"]) for r in got.collect()} == {1: (0, 0.8), 2: (1, 1.0), 3: (0, 0.0), 5: (0, 0.666667), 6: (0, 0.857143), 7: (1, 1.0)}
    assert exchanged(got) == {("id",)}


def test_postings_shuffle_terms_alone(spark, tmp_path):
    rows = [(1, "One two. Two three.\nThree.", "en", "a", 1), (2, "two two\n\nx", "en", "a", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = relations.postings_summary(spark, f"{tmp_path}/a")
    assert {r["term"]: (r["sections"], r["occurrences"]) for r in got.collect()} == {"one": (3, 3), "two": (7, 12), "three": (5, 6), "x": (3, 3)}
    assert exchanged(got) == {("term",)}
    spark.createDataFrame([*rows, (2, "two\nx\ny", "en", "a", 1), (None, "y", "en", "a", 1)], kind).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = relations.postings_summary(spark, f"{tmp_path}/b").collect()
    assert {r["term"]: (r["sections"], r["occurrences"]) for r in got} == {"one": (3, 3), "two": (7, 15), "three": (5, 6), "x": (5, 6), "y": (3, 6)}


def test_best_in_small_batches(spark, sf_dir, monkeypatch):
    docs, asked = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    name, seen, save = "spark.sql.execution.arrow.maxRecordsPerBatch", [], lexical.saved_table
    monkeypatch.setattr(lexical, "saved_table", lambda df, n: seen.append(int(spark.conf.get(name))) or save(df, n))
    before = spark.conf.get(name)
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(lexical.best(docs, asked, "item_id", 7))
    assert max(seen) <= 1000 and spark.conf.get(name) == before
    for kept in (0, 1 << 20):
        monkeypatch.setattr(lexical, "KEPT", kept)
        monkeypatch.setattr(lexical, "MEETINGS", 3000)
        monkeypatch.setattr(lexical, "WORDS", 500)
        assert plain(lexical.best(docs, asked, "item_id", 7)) == want


def test_filter_after_ranking(spark, sf_dir, monkeypatch):
    docs, asked = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    ok = docs.where("doc_id % 3 = 0").select("doc_id")
    plain = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "len", "terms", "score", "rank").collect()))
    ranked = lexical.ranking(docs, asked, "item_id")
    want = plain(ranked(5, only=ok))
    assert want and plain(ranked(5, after=ok.unionByName(ok))) == want
    monkeypatch.setattr(lexical, "QUERY_TERMS", 3)
    assert plain(lexical.ranking(docs, asked, "item_id")(5, after=ok)) == want


def test_parity_shuffles_no_postings(spark, sf_dir):
    got = plans_ranking.pushdown_parity(spark, sf_dir)
    assert {r["differing"] for r in got.collect()} == {0} and not any("term" in x for x in exchanged(got))


def test_qrels_once_and_without_texts(spark, sf_dir, monkeypatch):
    calls, qrels = [], plans_ranking._qrels
    monkeypatch.setattr(plans_ranking, "_qrels", lambda *a: calls.append(qrels(*a)) or calls[-1])
    assert plans_ranking.metrics_by_lang(spark, sf_dir).count() and len(calls) == 1
    assert "Generate" not in calls[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_knn_in_parts(spark, monkeypatch, kind):
    seen, save = [], vector.saved_table
    monkeypatch.setattr(vector, "saved_table", lambda df, n: seen.append((n, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))) or save(df, n))
    for name, n in (("BLOCK", 7), ("PART", 2), ("CUT", 2), ("PAIRS", 3)):
        monkeypatch.setattr(vector, name, n)
    r = np.random.default_rng(3)
    v = np.concatenate((r.integers(-2, 3, (50, 6)), r.normal(0, 1, (50, 6)), r.normal(1e4, 1e-2, (20, 6)), [[1e18] * 6, [np.nan, *[1.0] * 5]])).astype(np.float32 if kind == "float" else float).astype(float)
    v[(v == 0).all(1)] = 1
    df = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)] + [(200, None, 1)], f"vec_id long, embedding array<{kind}>, label int").repartition(4)
    sound, n = range(len(v) - 1), np.linalg.norm(v, axis=1)
    d = {"l2": np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), "hamming": ((v > 0)[:, None] != (v > 0)[None]).sum(-1), "cosine": 1 - (v @ v.T) / n[:, None] / n[None]}
    for metric, per_group in (("l2", None), ("hamming", None), ("l2", "label"), ("hamming", "label")):
        got = {}
        for x in vector.knn(df, df.where(f"vec_id != {len(v) - 1}"), 5, metric, per_group=per_group).collect():
            got.setdefault((x["qid"], x["grp"] if per_group else None), {})[x["rank"]] = x["vec_id"]
        for i in sound:
            for g in ("0", "1", "2") if per_group else (None,):
                want = sorted((float(d[metric][i, j]), j) for j in sound if j != i and g in (None, str(j % 3)))[:5]
                assert [got[i, g][k] for k in range(1, 6)] == [j for _, j in want], (metric, i, g)
    for x in vector.knn(df, df, 5, "cosine", digits=9).where(f"qid != {len(v) - 1}").collect():
        assert abs(x["distance"] - sorted(d["cosine"][x["qid"], j] for j in sound if j != x["qid"])[x["rank"] - 1]) < 1e-7
    assert all(rows <= (3 if n == "nearest" else 1 << 14) for n, rows in seen) and ("nearest", 3) in seen


def test_coarse_joins_no_vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = vector.coarse(e, e, 5)
    assert got.count() and "Join" not in got._jdf.queryExecution().executedPlan().toString() and exchanged(got) == {("qid",)}


def test_language_reads_words_once(spark):
    """The text's segments are split into words at one place, and the whole text at another."""
    df = spark.createDataFrame([("x",)], "t string").select(T.guess_language(F.col("t")).alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2

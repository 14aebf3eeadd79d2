import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard, rules, sharding
from tests.llm import brute


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = stage["quality_rules"](spark, docs, sf_dir)
    learned = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    covered = lambda x: any(all((x[c.feature] >= c.threshold) == c.above for c in rule) for rule in learned)
    assert ids(good) == sorted(r["doc_id"] for r in docs.collect() if not covered(brute.rule_features(r["text"]))) and good.columns == docs.columns

    once = stage["near_duplicates"](spark, good, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    group = {i: i for i in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in brute.jaccard_pairs(texts, 3, 0.6):
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    assert ids(once) == sorted(i for i in texts if root(i) == i) and once.columns == docs.columns

    clean = stage["decontamination"](spark, once, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {d for d, _ in brute.matches({r["doc_id"]: r["text"] for r in once.collect()}, {r["item_id"]: r["text"] for r in bench.collect()}, 13)}
    assert ids(clean) == [i for i in ids(once) if i not in hit] and hit
    items = [f" {' '.join(brute.words(r['text']))} " for r in bench.collect()]
    for r in clean.collect():
        text = f" {' '.join(brute.words(r['text']))} "
        assert not any(i in text for i in items)

    mixed = stage["mixing"](spark, clean, sf_dir)
    rows = clean.select("doc_id", "source", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)).alias("u")).collect()
    want = {r["doc_id"]: rate + r["u"] for r, rate in zip(rows, brute.mixture([(r["source"], r["text"]) for r in rows], 0.7)[0])}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got.keys() == want.keys() and all(n == math.floor(want[d]) or abs(want[d] - round(want[d])) < 1e-5 for d, n in got.items())

    sharded = stage["sharding"](spark, mixed, sf_dir)
    assert ids(sharded) == ids(mixed) and sharded.columns == [*docs.columns, "shard"]
    sizes = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.25 * sum(sizes) / 16


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_rows(spark, sf_dir, empty):
    docs = brute.clashing(spark.createDataFrame([] if empty else brute.awkward(), brute.SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert set(docs.columns) == set(out.columns), name
        rows = out.count()
        assert rows == 0 if empty else rows >= 1, name


def test_near_duplicates_awkward(spark, sf_dir):
    docs = spark.createDataFrame(brute.awkward(), brute.SCHEMA)
    kept = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 4, 5, 6, 7, 8, 10, 10, None, None]))
    assert jaccard.groups(jaccard.jaccard_join(docs)).count() == 5
    assert sharding.assignment(docs).count() == 10


def test_run_returns_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and out.columns[-1] == "shard"


@pytest.mark.parametrize("empty", [False, True])
def test_run_takes_awkward_tables(spark, sf_dir, tmp_path, empty):
    rows = [] if empty else brute.awkward()
    brute.clashing(spark.createDataFrame(rows, brute.SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty else [(1, 1, 0), (None, 0, 0), (4, None, None), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [] if empty else [(1, None), (None, ""), (2, " ".join(brute.word_list(60, 9)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"] for r in out.collect()}
    assert got == (set() if empty else {1, 4, 5, 6, 7, 8, 10, None}) and "shard" in out.columns

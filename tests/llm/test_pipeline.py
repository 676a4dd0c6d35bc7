"""The pipeline: each stage against a plain version on all that the one before kept."""

import random

import pytest
from brute import grams, groups, lines
from pyspark.sql import functions as F

from cairn.llm import toxicity

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs_of(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, data, tmp_path):
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        out = stage(spark, docs, data)
        if name != "best-fit packing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        docs = seen[name] = spark.read.parquet(str(tmp_path / str(i)))
        had = texts(before)
        if name == "toxicity":
            kept = texts(docs)
            assert all(had[d] == t for d, t in kept.items())
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
            gone = [labels[d] for d in had if d not in kept and d in labels]
            assert sum(x == 0 for x in gone) <= 0.05 * sum(x == 0 for x in labels.values())
            model = toxicity.fit(docs_of(spark, data), spark.read.parquet(f"{data}/labels.parquet"))
            rejected = {r["doc_id"] for r in toxicity.score(before, model).filter("score >= 0.5").collect()}
            assert set(had) - set(kept) == rejected  # decided by the score and by nothing else
        elif name == "line dedup":
            assert texts(docs) == {d: t for d, _, _, t in lines(list(had.items()))}
            assert docs.filter("n_chars <> length(text)").count() == 0
        elif name == "n-gram Jaccard join":
            assert texts(docs) == {d: had[d] for d, (_, c) in groups(list(had.items()), 5, 80, 100).items() if d == c}
        elif name == "benchmark decontamination":
            bench = set().union(*(grams(r["text"], 8) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()))
            assert set(texts(docs)) == {d for d, t in had.items() if not grams(t, 8) & bench}
    sizes = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert sizes[0] <= 1024 and sizes[1] <= 1.1 * sizes[2] / 1024 + 1
    assert docs.select("doc_id").distinct().count() == seen["benchmark decontamination"].count()


def test_odd_rows_pass_every_stage(spark, data, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 60_000), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (None, "no key here", "en", "s", 11)]
    df = spark.createDataFrame([(*r, "clash") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, score string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None}
    empty = tmp_path / "empty"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(str(empty / f"{t}.parquet"))
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    """Planted ones, on labels enough to learn from."""
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(600)]
    rows = [(i, t + (" you idiotic scumbag and wretched liar" if i % 4 == 0 else ""), "en", "s", len(t)) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in pipeline.toxic_documents_go(spark, docs, str(tmp_path)).collect()}
    assert len([i for i in range(600) if i % 4 == 0 and i in kept]) <= 8 and len([i for i in range(600) if i % 4 and i not in kept]) <= 4

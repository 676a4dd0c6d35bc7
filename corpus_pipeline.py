"""A training corpus from documents in five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all
but the last return the columns of documents, others are left out.  Rows without doc_id can't be judged by a stage that decides
by doc_id; they pass.  Null and empty texts pass every stage (after line dedup a null text is an empty one) and are packed as one end id; very long texts are judged,
cleaned and packed whole; rows with equal doc_id stay or go together; empty tables give an empty result, and a missing class of
labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, jaccard, lines, packing, toxicity
from cairn.llm.shared import discard, documents, sized, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those of the written ids."""
    return docs.join(sized(ids), "doc_id", "left_anti").select(*COLUMNS)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled documents of the corpus; documents with a score of 0.5 and more go."""
    model = toxicity.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = toxicity.score(docs, model).filter("score >= 0.5 and doc_id is not null").select("doc_id").distinct()
    return _without(docs, written(rejected, "pipeline-toxic"))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 and more characters in 3 and more documents stay in one of them; n_chars follows the text."""
    kept = lines.line_dedup(docs.select(*COLUMNS), min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a Jaccard similarity of 0.8: the smallest doc_id of each group stays."""
    groups = jaccard.jaccard_groups(docs, k=5, num=80, den=100)
    return _without(docs, written(groups.filter("doc_id > component_id").select("doc_id").distinct(), "pipeline-copies"))


def benchmark_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, as it is or with other names and values, go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, written(found.select("doc_id").filter("doc_id is not null").distinct(), "pipeline-leaks"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens of what is left: the columns are those of packing.pack()."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", repeated_lines_go),
    ("n-gram Jaccard join", near_copies_go),
    ("benchmark decontamination", benchmark_documents_go),
    ("best-fit packing", pack_sequences),
]

#: Fitted scores, tokens and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)  # one copy of the corpus at a time
        before = docs
    return docs

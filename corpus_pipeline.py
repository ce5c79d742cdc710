"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Null texts, empty tables and repeated rows pass as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, lines, near_dup, packing, quality
from weftline.llm.common import dropped, stored
from weftline.llm.queries import table, tokenizer_file

#: The stages call Python code that SQL has no words for; tests hold them against plain versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    scored = quality.scored(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; n_chars follows the text. A document may end up without text."""
    left = lines.without_matches(docs, percent=80)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    kept = near_dup.near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of ten words of a benchmark item, or a whole shorter item, go; rows without a doc_id each by their own text."""
    items = table(spark, sf_dir, "benchmark")

    def clean(rows: DataFrame, key: str) -> DataFrame:
        # Stored, so that its size is known: where it is small, no document is shuffled to be left out.
        hit = stored(decontam.contamination(rows, items, key, span=10, gram=5).where("size(runs) > 0").select(key).distinct(), "hits")
        return rows.join(hit, key, "left_anti").select(*docs.columns)

    unnamed = stored(docs.where("doc_id is null").withColumn("unnamed", F.monotonically_increasing_id()), "unnamed")
    return clean(docs.where("doc_id is not null"), "doc_id").unionByName(clean(unnamed, "unnamed"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs, tokenizer_file(), size=2048, end=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = last = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), docs
        if before is not last:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, quality classifier, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. run() writes each stage's result to the shared folder and reads it
back as the next stage's docs, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import packing, quality_classifier, quality_rules, secret_scans, simhash
from tidebook.llm.common import released, stored, table

#: The columns of documents; stages take and return these, whatever else a table has.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Verdicts are joined by id and text hash, so
    rows that share an id are judged on their own texts; null ids join as equal."""
    docs = docs.select(*COLUMNS)
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), "text", "lang", "source")
    kept = quality_rules.quality_rules(keyed, id_col="k").filter("kept").select(F.col("doc_id.doc_id").alias("_i"), F.col("doc_id.h").alias("_h")).distinct()
    return docs.join(stored(kept, "kept-rules"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h")), "left_semi").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the score is made beside the row, without
    a join. Training reads labelled rows of the whole table: most bad examples are gone from docs."""
    docs = docs.select(*COLUMNS)
    weights = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, weights, keep=("text", "lang", "source", "n_chars"))
    return scored.filter("score >= 0.3").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: groups by
    five-word shingles and a similarity of 0.8, candidates by SimHash and MinHash bands. Verdicts
    are joined by id and text hash: of rows equal in both, one stays, and rows that share an id
    only are judged on their own texts. Rows without id name no group and stay."""
    docs = docs.select(*COLUMNS)
    heads = simhash.similar_documents(docs).filter("head").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    keyed = docs.filter("doc_id is not null").withColumn("_k", F.xxhash64("text"))
    first = keyed.join(stored(heads, "kept-simhash"), (F.col("doc_id") == F.col("_i")) & (F.col("_k") == F.col("_h")), "left_semi")
    return first.dropDuplicates(["doc_id", "_k"]).select(*COLUMNS).unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    clean = secret_scans.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see packing.pack_documents()."""
    docs = docs.select(*COLUMNS)
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: The classifier is trained with floating point and tokens come from a vocabulary file: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's own intermediate tables are deleted once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

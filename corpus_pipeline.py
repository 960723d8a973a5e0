"""The corpus pipeline: each stage works on the documents its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tally.llm import benchmark_suffixes, best_fit, quality_cascade, simhash_lsh, suffix_dedup
from tally.session import ensure_checkpoint_dir
from tally.sources.tables import load_table

#: Best-fit packing and suffix arrays have no SQL form.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents no quality rule rejects."""
    return quality_cascade.quality_filter(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document, that of the least doc_id, of each group of near-duplicates."""
    return simhash_lsh.keep_one(docs, shingle=4, radius=4)


def suffix_array_dedup(spark, docs, sf_dir):
    """Texts without the byte strings that an earlier document has; documents left without text go."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).where(F.coalesce(F.length("text"), F.lit(0)) > 0)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark window."""
    return benchmark_suffixes.clean(docs, load_table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of the documents packed into training sequences."""
    return best_fit.pack(docs, "byte_bpe_50k.json", end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]


def run(spark, sf_dir):
    """All stages over ``documents``; each one's rows are written as Parquet and read again."""
    docs = load_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

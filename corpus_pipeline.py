"""A corpus pipeline of five stages: quality, exact copies, near-copies, source mix, packing.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last returns
packed pieces. Every stage takes tables of no rows (and gives none), null or empty texts, null and repeated ids,
repeated rows, very long texts, and other columns of any name and value, which it hands on unread.
"""

from __future__ import annotations

import public_tokenizers
from chromaloom.llm import exact_dedup, mixing, packing, quality, simhash
from pyspark.sql import DataFrame, SparkSession


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; the labels come from the labels table.

    Null and empty texts score 0 and go; equal texts score alike; ids play no part but to find a text's label."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (A-Z lower-cased) the one with the largest doc_id: one row of each group.

    A null text equals an empty one; a null id wins only where all are null; of repeated rows one stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the one with the least doc_id: one row of each group.

    Null, empty and blank texts are one group, as their fingerprint is zero; a null id stays only where all are
    null; of one id on several texts the least digest stays, and of repeated rows one."""
    return simhash.drop_near_copies(docs)


def _mix(docs: DataFrame, weights: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """docs in the mix, under other names meanwhile, as documents may have columns called like the mix's own."""
    names = docs.columns
    own = docs.toDF(*(f"column{i}" for i in range(len(names))))
    if weights is not None:
        weights = weights.withColumnRenamed("source", f"column{names.index('source')}")
    return mixing.mix_sources(own, weights, source_col=f"column{names.index('source')}", id_col=f"column{names.index('doc_id')}"), names


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """The documents of the mix at target weights (source, weight); default: as many as each source has, but no
    source above a third of the mix. What a source has beyond its weight when the other sources have run dry is left
    out: left_out returns those rows, mix_report counts them.

    Repeated rows and null ids are rows like any others; a null source is a source of its own."""
    mix, names = _mix(docs, weights)
    return mix.filter("in_mix").select(*(c for c in mix.columns if c.startswith("column"))).toDF(*names)


def left_out(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """The rows that ``mixed`` leaves out: the two together are docs."""
    mix, names = _mix(docs, weights)
    return mix.filter("not in_mix").select(*(c for c in mix.columns if c.startswith("column"))).toDF(*names)


def mix_report(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """(source, docs, in_mix, left_out): how many of each source ``mixed`` keeps and leaves out."""
    mix, names = _mix(docs, weights)
    source = f"column{names.index('source')}"
    return mixing.mix_report(mix, source).withColumnRenamed(source, "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens.

    A null or empty text is its end id alone; longer documents than a sequence are cut; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies), ("SimHash near-dedup", without_near_copies), ("source mix", mixed), ("best-fit packing", packed)]

#: A learned classifier and a genetic algorithm are not SQL; tests use a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's rows are stored in the shared folder first."""
    from chromaloom.llm._common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i + 1 < len(STAGES) else docs
    return docs

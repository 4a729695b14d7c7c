"""A training corpus from the table ``documents``: five stages, each an operator of
``lexspan.llm``. Every stage's rows are written as Parquet in the shared folder and read
again as the next one's input; all but the last have the columns of ``documents``.

Nulls, empty texts, ties and repeated rows go through as the operators define them; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import jaccard, line_dedup, mixing, packing, quality_model
from lexspan.llm.common import read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labelled rows outside the
    held-out fold."""
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"), ~quality_model.held_out(F.col("doc_id")))
    return quality_model.classify(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; one that had nothing else goes."""
    d = line_dedup.line_dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    changed = F.col("n_removed") > 0
    return d.select(*[F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.keep_one(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source take it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixed", mixed), ("packed", packed)]

#: The classifier, the MinHash join and the tokenizer have no SQL form; tests hold the
#: pipeline against a plain version of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: quality, near duplicates, mixture, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lockstep.llm import mixing, packing, quality, simhash
from lockstep.llm.queries import RANKS, VOCABULARY, table
from lockstep.sources.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled ones among them that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("predicted = 1").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of smallest id."""
    return simhash.without_near_duplicates(docs)


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 1024."""
    return packing.pack_documents(docs, RANKS, VOCABULARY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_to_target_weights", mixing_to_target_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Boosted tables, components and balanced sampling have no SQL form. tests/llm compares the fit and the scores, near copies, mixing and packing with
#: plain versions, the first two stages of the given tables with the plain decisions, and all stages together by what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

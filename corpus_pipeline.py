"""A training corpus from the table ``documents``: five stages of the subpackage llm, each on all that the one before kept.

The stages up to the last return the columns of documents; the last returns the blocks of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, mixing, quality_rules, repeats, simhash_vp
from siltstone.llm.shared import dropped, stored
from siltstone.llm.substring_dedup import substring_dedup
from siltstone.ship import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; so do documents without words (null, empty or blank text).

    Null ids don't matter; documents given twice are judged alike; an empty table stays empty; other columns are passed on.
    """
    return quality_rules.good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id (null first; ties by the text's hash).

    Documents given twice are near duplicates; documents without words (null, empty or blank text) all stay.
    """
    ship(spark)
    return simhash_vp.without_near_duplicates(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier place are cut; n_chars follows; documents of which nothing is left go.

    Null and empty texts stay as they are; a document given twice isn't a repeat of itself, and both rows are cut alike.
    """
    ship(spark)
    return repeats.what_is_left(substring_dedup(docs), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go: 13 words of an item, or the whole of a shorter one.

    Null, empty and blank texts match nothing and stay; so does all where the benchmark is empty; documents given twice go
    or stay together; null ids of documents or items don't matter; other columns are passed on.
    """
    return decontaminate.decontaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of all that is left, mixed to the sources' target weights.

    Null, empty and blank texts pack nothing; a null source is a source; null ids come first, ties go by the words;
    documents given twice are packed twice; an empty table gives no blocks.
    """
    ship(spark)
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The classifier is trained and fingerprints are 128-bit hashes, so SQL can't express run(); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            dropped(before)  # the next stage reads the new table only
    return docs

"""From raw documents to packed sequences: the stages of the corpus pipeline, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirspan.llm import decontaminate, line_dedup, packing, shingles, simhash, toxicity
from weirspan.llm.common import cut_lineage, stored, table


#: Lines of one or two words go if they stand on this share of all sites; op10 leaves them, as its SQL does.
SHORT_SHARE = 0.25


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, fitted on the labels, do not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites or documents share; a first occurrence stays."""
    found = line_dedup.remove_repeated_lines(docs, short_share=SHORT_SHARE)
    return found.select(*[F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: SimHash fingerprints within four bits (op7) or five-word shingles at a Jaccard similarity of 0.8 or more."""
    return shingles.keep_one(docs, also=simhash.near_duplicates(cut_lineage(simhash.fingerprints(docs))))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of fixed length."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: Hashes, trained trees and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

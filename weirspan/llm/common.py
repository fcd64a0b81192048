"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirspan.session import CHECKPOINT_KEY, cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "doc_key", "lower_ascii", "stored", "table", "words_of"]

#: Bytes of A-Z to a-z for Python code that works on UTF-8; white space is found by ``bytes.split``.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage cut, compressed, with a known size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two key columns ``k1, k2`` that stand for a document in joins.

    Rows with equal id and equal text share a key: they are the same document and get the same result.
    NULL ids and texts are told apart from all values.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("k2"),
    ]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and no other letter; pure ASCII takes the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) UTF-8 words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []

"""Removal of lines that many sites share, by distinct-site spread.

A line is known by two hashes of its trimmed text. HyperLogLog sketches of its sites are merged by aggregation; a line
whose estimate lies near the threshold has its sites counted exactly. A line of ``long_words`` words or more does not
recur by chance, so each document counts as a site of its own for it, and two are enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import doc_key, stored

#: Sites from which on a line is boilerplate.
MIN_SITES = 3
#: A line of fewer words recurs by chance: it stays, or with a ``short_share`` needs that share of all sites.
MIN_WORDS = 3
#: A line with this many words counts documents as sites, and this many of them make it repeated text.
LONG_WORDS = 50
MIN_DOCUMENTS = 2
#: Sketches have 2**LG_K registers; estimates within this share of the threshold are counted exactly.
LG_K = 10
NEAR = 0.5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _occurrences(docs: DataFrame, site: str, long_words: int, min_words: int, all_lines: bool) -> DataFrame:
    """One row per line of ``min_words`` words or more, or per line: its document, place, hashes, whether it is long or short, and its site."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), F.col(site).cast("string").alias("name"), F.posexplode(_lines(F.col("text"))).alias("place", "raw"))
    line = F.trim("raw", F.lit(" \t\r\u000b\f"))
    rows = rows.select("doc_id", "k1", "k2", "place", "name", line.alias("line")).where("line <> ''")
    rows = rows.withColumn("words", F.size(F.split("line", "[ \\t\\u000b\\f\\r]+")))
    short = F.col("words") < min_words
    if not all_lines:
        rows = rows.where(~short)
    is_long = F.col("words") >= long_words
    spot = F.when(is_long, F.xxhash64("k1", "k2")).otherwise(F.xxhash64(F.col("name").isNull(), "name"))
    return rows.select("doc_id", "k1", "k2", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), is_long.alias("long"), short.alias("short"), spot.alias("spot"))


def _spread(rows: DataFrame, least: Column) -> DataFrame:
    """Keys of the lines whose sites reach ``least``, with the first place of each."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "place"))
    sketches = rows.groupBy("h1", "h2", "long", "short").agg(F.hll_sketch_agg("spot", F.lit(LG_K)).alias("sketch"), first.alias("first"))
    rated = stored(sketches.select("h1", "h2", "long", "first", F.hll_sketch_estimate("sketch").alias("sites"), least.alias("least")).where(F.col("sites") >= F.col("least") * (1 - NEAR)))
    sure = rated.where(F.col("sites") > F.col("least") * (1 + NEAR))
    near = rated.where(F.col("sites") <= F.col("least") * (1 + NEAR))
    # Dealt by site as well after the join, so the rows of a very common line, which are not near, need not meet in one task.
    spots = rows.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "spot").repartition("h1", "h2", "spot").distinct()
    exact = spots.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    confirmed = near.join(exact, ["h1", "h2"]).where("exact >= least")
    return sure.select("h1", "h2", "sites", "first").unionByName(confirmed.select("h1", "h2", F.col("exact").alias("sites"), "first"))


def repeated_places(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, min_documents: int = MIN_DOCUMENTS, min_words: int = MIN_WORDS, short_share: float | None = None) -> DataFrame:
    """``k1, k2, places``: per document (see ``doc_key``) the numbers of its lines to remove.

    The first occurrence (smallest doc_id, then smallest place) stays. A repeated row is one document.
    """
    rows = stored(_occurrences(docs, site, long_words, min_words, short_share is not None))
    least = F.when(F.col("long"), F.lit(min_documents)).otherwise(F.lit(min_sites))
    if short_share is not None:
        sites = docs.select(F.col(site).cast("string")).distinct().count()
        least = F.when(F.col("short"), F.lit(max(min_sites, math.ceil(short_share * sites)))).otherwise(least)
    spread = _spread(rows, least)
    hit = rows.join(spread.select("h1", "h2", "first"), ["h1", "h2"])
    kept = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.place") == F.col("place"))
    return hit.where(~kept).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))


def remove_repeated_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, min_documents: int = MIN_DOCUMENTS, min_words: int = MIN_WORDS, short_share: float | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed`` per row.

    Lines are compared without the blanks around them; blank lines stay, and so do those of fewer words than ``min_words``
    unless they stand on a ``short_share`` of all sites and on ``min_sites``. NULL and empty texts stay as they are.
    A NULL site is one site. Other columns are kept; ``n_lines`` and ``n_removed`` of the input are replaced.
    """
    places = repeated_places(docs, site, min_sites, long_words, min_documents, min_words, short_share)
    k1, k2 = doc_key()
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumns({"__k1": k1, "__k2": k2})
    marked = keyed.join(places.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("places").alias("__places")).hint("merge"), ["__k1", "__k2"], "left")
    lines = _lines(F.col("text"))
    places_left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__places"))
    kept = F.array_join(F.transform(places_left, lambda i: F.get(lines, i)), "\n")
    return marked.select(
        *[F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(F.array_size("__places"), F.lit(0)).alias("n_removed"),
    )

"""Filters, keyed joins, crosswalks and upserts over the project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirspan.functions import text as tx


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fields of ``schema``, in order: unknown columns dropped, missing ones NULL."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def normalise_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trimmed lower-case column names, with known aliases replaced."""
    aliases = aliases or {}
    return df.toDF(*[aliases.get(c.strip().lower(), c.strip().lower()) for c in df.columns])


def rows_of(df: DataFrame, ids: DataFrame, key: str = "site_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def not_removed(df: DataFrame, comments: str = "comments") -> DataFrame:
    return df.where(~tx.is_removed(F.col(comments)))


def without_comments(df: DataFrame, values: Sequence[str], comments: str = "comments") -> DataFrame:
    """Rows whose comment is none of ``values``; rows without a comment stay."""
    return df.where(~F.coalesce(F.col(comments).isin(list(values)), F.lit(False)))


def within(col: Column, low: float | None, high: float | None, open_low: bool = True) -> Column:
    """Plausibility range; the lower end is open unless told otherwise."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((col > low) if open_low else (col >= low))
    if high is not None:
        ok = ok & (col <= high)
    return ok


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the stated order, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return first.select(*keys, "__row.*").select(*df.columns)


def rekey(stats: DataFrame, crosswalk: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """Replace ``key`` (an ``old`` id) by the ``new`` id of the crosswalk; ids without a partner drop out."""
    pairs = crosswalk.select(F.col(old).alias(key), F.col(new).alias("__new"))
    return stats.join(pairs, key).withColumn(key, F.col("__new")).drop("__new")


def one_per_target(crosswalk: DataFrame, order: str = "hydroseq") -> DataFrame:
    """One NHD id per TDX reach: the lowest in network order."""
    return crosswalk.groupBy("linkno").agg(F.min_by("nhdplusid", F.struct(order, "nhdplusid")).alias("nhdplusid"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str, order: str, default=None) -> DataFrame:
    """Map ``key`` through a table; of repeated keys the last in ``order`` counts, of equal ones there the largest value."""
    pairs = table.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(out))
    joined = df.join(pairs, key, "left")
    return joined if default is None else joined.withColumn(out, F.coalesce(out, F.lit(default)))


def roughness(ids: DataFrame, geometry: DataFrame, key: str, fallback: float) -> DataFrame:
    """First positive of the two channel roughness columns, four decimals, else the fallback."""
    value = F.round(tx.positive(F.col("owp_roughness_bathy"), F.col("owp_roughness_no_bathy")), 4)
    table = geometry.select(F.col("feature_id").alias(key), value.alias("n"))
    return ids.join(table, key, "left").withColumn("n", F.coalesce("n", F.lit(fallback)))


def with_upstream(sections: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each section next to its site's upstream section: the labelled one, else the first by index."""
    rank = F.struct(F.when(F.col("xs_index") == 0, 0).otherwise(1).alias("a"), F.col("xs_index").alias("b"), *[F.col(c) for c in columns])
    up = sections.groupBy("site_id").agg(F.min(rank).alias("__up"))
    return sections.join(up.select("site_id", *[F.col(f"__up.{c}").alias(f"{c}_up") for c in columns]), "site_id")


def expand_duplicates(df: DataFrame, on: Sequence[str], work) -> DataFrame:
    """Run ``work`` once per distinct ``on`` and give its columns to every row."""
    return df.join(work(df.select(*on).distinct()), list(on), "left")


def replace_keys(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys present in ``fresh`` are replaced by its rows; all-NULL rows are not inserted."""
    values = [c for c in fresh.columns if c not in keys]
    kept = target.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh.dropna(how="all", subset=values), allowMissingColumns=True)


def upsert(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update or insert by key; only known columns, and a NULL does not overwrite a value."""
    known = [c for c in fresh.columns if c in target.columns and c not in keys]
    new = fresh.select(*keys, *[F.col(c).alias(f"__{c}") for c in known])
    merged = target.join(new, list(keys), "full")
    return merged.select(*[F.coalesce(f"__{c}", c).alias(c) if c in known else F.col(c) for c in target.columns])


def extent(points: DataFrame, key: str, buffer: float = 0.002) -> DataFrame:
    return points.groupBy(key).agg(
        (F.min("x") - buffer).alias("xmin"), (F.min("y") - buffer).alias("ymin"),
        (F.max("x") + buffer).alias("xmax"), (F.max("y") + buffer).alias("ymax"),
    )


def joined_set(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sorted distinct values of a key as one text; the values are de-duplicated before they meet."""
    once = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    return once.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), "; ").alias(out))


def reindex_large(df: DataFrame, columns: Sequence[str], by: str, group: str, limit: int = 1_000_000_000) -> DataFrame:
    """Shift ids of a group down to start at 1 when its smallest ``by`` lies above ``limit``."""
    lows = df.groupBy(group).agg(F.min(by).alias("__low"))
    joined = df.join(lows, group)
    shift = F.when(F.col("__low") > limit, F.col("__low") - 1).otherwise(F.lit(0))
    state = F.when(F.col("__low") > limit, "FIXED").when(F.col("__low").isNull(), "WARNING").otherwise("OK")
    return joined.withColumns({**{c: F.col(c) - shift for c in columns}, "state": state}).drop("__low")


def run_status(sites: DataFrame, log: DataFrame) -> DataFrame:
    """Status text of each site's last run."""
    text = F.when(F.col("outcome") == "ok", "Success").when(F.col("outcome").isNotNull(), F.concat(F.lit("Failed: "), "message"))
    return sites.join(log, "site_id", "left").withColumn("status", F.coalesce(text, F.lit("Not Run")))

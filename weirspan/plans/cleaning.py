"""Database cleaning, source slices, the publication table and base-flow resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.functions import text as tx
from weirspan.operators import flow, keyed

# Coverage of the two flow models, and the cross-section published for a site.
NWM_FROM, NWM_TO = "1979-02-01", "2023-01-31"
GEO_FROM = "1940-01-01"
PUBLISHED_SECTION = 3


def in_nwm(date: str) -> Column:
    return F.col(date).between(F.lit(NWM_FROM).cast("date"), F.lit(NWM_TO).cast("date"))


def in_geo(date: str) -> Column:
    return F.col(date) >= F.lit(GEO_FROM).cast("date")


def by_source(source: Column, nwm: Column, geo: Column) -> Column:
    return F.when(source == "National Water Model", nwm).otherwise(geo)


def if_absent(value: Column, computed: Column) -> Column:
    """Computed value only where there is none yet (NULL or 0)."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, computed).otherwise(value)


def source_slices(incidents: DataFrame) -> DataFrame:
    """Kept incidents with a valid date, once for each model that covers the date."""
    kept = keyed.not_removed(incidents).withColumn("date", tx.parse_date(F.col("date_text"))).where("date IS NOT NULL")
    covered = F.array_compact(F.array(F.when(in_nwm("date"), F.lit("NWM")), F.when(in_geo("date"), F.lit("GEO"))))
    return kept.withColumn("slice", F.explode(covered))


def publication_table(sites: DataFrame, incidents: DataFrame, sections: DataFrame) -> DataFrame:
    """Sites with their number of incidents and the dangerous range at the published section."""
    counts = incidents.groupBy("site_id").agg(F.count(F.lit(1)).alias("incidents"))
    ranges = sections.where(F.col("xs_index") == PUBLISHED_SECTION).groupBy("site_id").agg(
        F.min("qmin").alias("qmin"), F.max("qmax").alias("qmax")
    )
    out = sites.select("site_id", "name").join(counts, "site_id", "left").join(ranges, "site_id", "left")
    return out.withColumn("incidents", F.coalesce("incidents", F.lit(0)))


def resolve_baseflow(sites: DataFrame, record: DataFrame) -> DataFrame:
    """Scan date from GPS time or the project name; base flow on that date, else the median, if not set."""
    dated = sites.withColumn("scan_date", tx.scan_date(tx.gps_date(F.col("gps")), F.col("project")))
    found = flow.flow_on_or_median(dated, record, "scan_date", "found")
    return found.withColumn("baseflow", if_absent(F.col("baseflow"), F.col("found"))).drop("found")

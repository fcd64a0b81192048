"""Flow observations as they arrive: daily means, and flows inside a section's dangerous range."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirspan.operators.flow import known_flow
from weirspan.session import ensure_checkpoint_dir

LATENESS = "1 day"


def daily_mean_stream(obs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row per reach and UTC day, emitted once the day is over and ``lateness`` has passed."""
    days = obs.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "reach_id").agg(F.avg(known_flow()).alias("streamflow"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return days.select("reach_id", day.alias("date"), "streamflow")


def dangerous_flows(obs: DataFrame, sections: DataFrame) -> DataFrame:
    """Arriving flows within the dangerous range of a section on their reach; ``sections``: reach_id, xs_key, qmin, qmax."""
    inside = F.col("streamflow").between(F.col("qmin"), F.col("qmax"))
    return obs.join(sections, "reach_id").where(inside)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, append it to the Parquet table ``path`` and return the table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

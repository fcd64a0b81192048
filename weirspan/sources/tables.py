"""Reading and writing: project tables, text files, flow stores, layers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirspan.functions import geo
from weirspan.functions.steps import let
from weirspan.operators import flow, keyed
from weirspan.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_project(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All project tables under ``root``; a table that is not there yet is empty."""
    out = {}
    for name, schema in schemas.PROJECT.items():
        path = f"{root}/{name}"
        out[name] = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return out


def write_project(tables: dict[str, DataFrame], root: str) -> None:
    """Write tables; of paired tables only the source pairs present in the data are replaced."""
    for name, df in tables.items():
        out = keyed.enforce_schema(df, schemas.PROJECT[name])
        if name in schemas.PAIRED:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*schemas.PAIR).parquet(f"{root}/{name}")
        else:
            out.write.mode("overwrite").parquet(f"{root}/{name}")


def with_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL hydraulics as the marker value, for tools that expect it."""
    return df.withColumns({c: F.coalesce(c, F.lit(schemas.SENTINEL)) for c in columns})


def without_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != schemas.SENTINEL, F.col(c)) for c in columns})


def read_codes_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """CSV with declared types: codes with leading zeros stay text, unreadable numbers become NULL."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_any_encoding(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose text is UTF-8 or ISO-8859-1, decided value by value, so files of both kinds may lie in one folder.

    Every byte is first read as one character; values whose bytes are valid UTF-8 are then read as that.
    """
    raw = read_codes_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]), "ISO-8859-1")

    def value(f: T.StructField) -> Column:
        data = F.encode(F.col(f.name), "ISO-8859-1")
        text = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.col(f.name))
        return text.try_cast(f.dataType).alias(f.name)

    return raw.select(*[value(f) for f in schema.fields])


def read_simulator(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Simulator output with padded headers; every value is read as text unless a schema is given."""
    raw = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named if schema is None else keyed.enforce_schema(named, schema)


def write_stats_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV with a fixed column order; absent columns and values are 0.0."""
    cols = [F.coalesce(F.col(c), F.lit(0.0).cast(df.schema[c].dataType)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_rows_of(spark: SparkSession, path: str, columns: Sequence[str], ids: DataFrame, key: str) -> DataFrame:
    """Chosen columns of the rows whose key is asked for."""
    return spark.read.parquet(path).select(*columns).join(ids.select(key).distinct(), key, "left_semi")


def daily_means_to_append(obs: DataFrame, ids: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Daily means of the asked reaches that the store does not hold yet."""
    wanted = ids.select("reach_id").distinct()
    if stored is not None:
        wanted = wanted.join(stored.select("reach_id").distinct(), "reach_id", "left_anti")
    return flow.daily_mean(obs.join(wanted, "reach_id", "left_semi"))


def read_daily_store(spark: SparkSession, store: str) -> DataFrame:
    """Daily means of all batches committed so far; a store that is not there yet is empty."""
    if not exists(spark, store):
        return spark.createDataFrame([], schemas.FLOW_DAILY)
    return spark.read.schema(schemas.FLOW_DAILY).parquet(store).select(*schemas.FLOW_DAILY.names)


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder as its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the entries of a folder that begin with it."""
    files, target = _files(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def _last_batch(spark: SparkSession, store: str) -> int:
    return max((int(n) for n in _names(spark, store, "batch=")), default=0)


def _rename_if_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there; one step on file systems that rename folders in one step."""
    fs = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(getattr(fs.Options, "Rename"), 0)
    context = fs.FileContext.getFileContext(fs.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.Path(source), fs.Path(target), plain)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def append_reaches(obs: DataFrame, ids: DataFrame, store: str) -> int:
    """Add the asked reaches that the store lacks as its next batch, and return the batch's number.

    The rows are written to a folder that readers pass over, and renaming it to ``batch=n`` commits them. A run that
    fails leaves nothing to be seen and may simply be repeated; a repeated run finds its reaches stored and commits
    an empty batch. If another run has taken the number, its reaches are looked at and left out, and the next
    number is tried. So no reach is ever stored twice, given a file system on which renaming a folder is one step.
    """
    spark = obs.sparkSession
    while True:
        last = _last_batch(spark, store)
        attempt = f"{store}/_attempt-{uuid.uuid4().hex}"
        daily_means_to_append(obs, ids, read_daily_store(spark, store) if last else None).write.parquet(attempt)
        if _rename_if_new(spark, attempt, f"{store}/batch={last + 1}"):
            return last + 1


def write_flow_store(obs: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Flow rows clustered by reach and time, so a reach touches few files and row groups.

    Ranges of (reach, time) rather than hashes of the reach: a reach with very many rows spans several files.
    """
    obs.repartitionByRange("reach_id", "ts").sortWithinPartitions("reach_id", "ts").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_daily_table(daily: DataFrame, name: str, path: str, buckets: int | None = None, mode: str = "error") -> DataFrame:
    """Daily flows as the catalogue table ``name``, bucketed by reach and day; ``mode`` "append" adds rows to it.

    Look-ups by reach and day (``flow.flow_on``) are then aggregated and joined bucket by bucket: only the questions are
    shuffled, never the record. The day is part of the bucket, so a reach with very many rows is in all of them; rows of
    a bucket are sorted by reach, so the statistics of row groups serve reads of one reach. ``buckets``: the session's
    shuffle partitions if not given; with fewer than those Spark prefers a shuffle, and so wins nothing.
    """
    spark = daily.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = daily.select(*schemas.FLOW_DAILY.names).repartition(buckets, "reach_id", "date")
    rows.write.format("parquet").mode(mode).option("path", path).bucketBy(buckets, "reach_id", "date").sortBy("reach_id", "date").saveAsTable(name)
    return spark.table(name)


def _part(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("key_part")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], parts: int = 64) -> None:
    """A table in ``parts`` folders by the hash of its keys, to be changed by ``merge_keyed``."""
    whole = f"{path}/parts={parts}"
    df.withColumn("key_part", _part(keys, parts)).hint("rebalance", "key_part").write.partitionBy("key_part").parquet(whole)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def merge_keyed(fresh: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]) -> int:
    """Change a table of ``write_keyed`` by ``merge`` (``keyed.replace_keys`` or ``keyed.upsert``); the number of parts rewritten.

    Only parts that hold a key of ``fresh`` are read and written; all other files stay as they are. The new parts are
    written to a folder that readers pass over. Renaming it commits the merge, then its parts take the place of the old
    ones. A run that fails before the commit changes nothing; what one that fails behind it has left is put in place by
    the next merge, or by ``finish_merges``. One merge at a time; a reader during the exchange may miss a part.
    """
    spark = fresh.sparkSession
    finish_merges(spark, path)
    parts = int(_names(spark, path, "parts=")[0])
    whole, attempt = f"{path}/parts={parts}", f"{path}/_attempt-{uuid.uuid4().hex}"
    # At most ``parts`` numbers.
    touched = sorted(r[0] for r in fresh.select(_part(keys, parts)).distinct().collect())
    if not touched:
        return 0
    stored = T.StructType([*schema.fields, T.StructField("key_part", T.IntegerType())])  # named, as no folder may hold a file
    old = spark.read.schema(stored).parquet(whole).where(F.col("key_part").isin(touched)).select(*schema.names)
    merged = merge(old, fresh, keys).select(*schema.names)
    merged.withColumn("key_part", _part(keys, parts)).hint("rebalance", "key_part").write.partitionBy("key_part").parquet(attempt)
    for part in touched:  # a part that has lost all its rows is an empty folder
        files, target = _files(spark, f"{attempt}/key_part={part}")
        files.mkdirs(target)
    _rename_if_new(spark, attempt, f"{path}/_commit-{uuid.uuid4().hex}")
    finish_merges(spark, path)
    return len(touched)


def finish_merges(spark: SparkSession, path: str) -> None:
    """Put the parts of committed merges in place; may be repeated."""
    for commit in _names(spark, path, "_commit-"):
        folder, whole = f"{path}/_commit-{commit}", f"{path}/parts={_names(spark, path, 'parts=')[0]}"
        for part in _names(spark, folder, "key_part="):
            files, target = _files(spark, f"{whole}/key_part={part}")
            files.delete(target, True)
            _rename_if_new(spark, f"{folder}/key_part={part}", f"{whole}/key_part={part}")
        files, target = _files(spark, folder)
        files.delete(target, True)


def flow_at(store: DataFrame, reach_id: int, date: str) -> DataFrame:
    """One reach on one day; both conditions reach the Parquet row groups."""
    start = F.to_timestamp(F.lit(date))
    return store.where((F.col("reach_id") == reach_id) & (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))


def union_of_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several Parquet paths as one table by column name, with the file each row came from.

    One scan, however many paths there are: their schemas are merged by a job. A column that is in several files must
    be of one type.
    """
    return spark.read.option("mergeSchema", True).parquet(*paths).select("*", F.col("_metadata.file_path").alias("source_file"))


def union_in_one_system(spark: SparkSession, systems: Mapping[str, int | None], target: int = geo.DEGREES) -> DataFrame:
    """Layers of points or vertices ``x, y`` in several reference systems as one table in the system ``target``.

    ``systems`` names the code of every path; None stands for degrees. Paths of one system are one scan, so the plan
    grows with the number of systems and not with that of the files. Coordinates that are in the target already stay as
    they are. ``source_system`` is the code the row was stored in.
    """
    out = None
    for code in sorted({geo.DEGREES if c is None else c for c in systems.values()}):
        paths = [p for p, c in systems.items() if (geo.DEGREES if c is None else c) == code]
        one = union_of_files(spark, paths)
        if code != target:
            # A step of its own: beside a new x, an old x inside a lambda would be read as the new one.
            one = one.withColumn("__at", _projected(code, target, F.col("x"), F.col("y"))).withColumns({"x": F.col("__at.x"), "y": F.col("__at.y")}).drop("__at")
        one = one.withColumn("source_system", F.lit(code))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _projected(code: int, target: int, x: Column, y: Column) -> Column:
    def there(p: Column) -> Column:
        to = geo.from_degrees(target, p["lat"], p["lon"])
        return F.struct(to[0].alias("x"), to[1].alias("y"))

    lat, lon = geo.to_degrees(code, x, y)
    return let(F.struct(lat.alias("lat"), lon.alias("lon")), there)


def sites_with_output(sites: DataFrame, stage: DataFrame) -> DataFrame:
    return sites.join(stage.select("site_id").distinct(), "site_id", "left_semi")


def files_lacking(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """Files in which the column is absent or empty throughout."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)
    value = F.col(column) if column in df.columns else F.lit(None)
    files = df.select(F.col("_metadata.file_path").alias("file"), value.isNotNull().alias("has"))
    return files.groupBy("file").agg(F.bool_or("has").alias("has")).where(~F.col("has")).select("file")


def write_layers(layers: dict[str, DataFrame], root: str) -> None:
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_per_site(df: DataFrame, path: str) -> None:
    """Extracted rows clustered by site: a reader of one site skips all other row groups."""
    df.repartitionByRange("site_id").sortWithinPartitions("site_id").write.mode("overwrite").parquet(path)

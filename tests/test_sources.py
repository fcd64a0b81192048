"""Readers and writers round trip."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirspan.functions import geo
from weirspan.operators import flow, keyed
from weirspan.sources import schemas, tables
from weirspan.streaming import flow_stream


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_project_round_trip_replaces_only_the_pairs_written(spark, root):
    empty = tables.read_project(spark, root)
    assert all(df.isEmpty() for df in empty.values())
    sites = spark.createDataFrame([(1, "a", "junk")], "site_id long, name string, unknown string")
    xs = spark.createDataFrame([(1, 1, 2.0, "NHD", "NWM"), (1, 1, 3.0, "TDX", "GEO")], "site_id long, xs_index int, p_height double, flowline string, streamflow string")
    tables.write_project({"sites": sites, "xsections": xs}, root)
    tables.write_project({"xsections": xs.where("flowline = 'TDX'").withColumn("p_height", F.lit(7.0))}, root)
    back = tables.read_project(spark, root)
    assert back["sites"].columns == schemas.SITES.names
    assert sorted((r.flowline, r.p_height) for r in back["xsections"].collect()) == [("NHD", 2.0), ("TDX", 7.0)]


def test_sentinel(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "y double")
    marked = tables.with_sentinel(df, ["y"])
    assert sorted(r.y for r in marked.collect()) == [-9999.0, 1.0]
    assert tables.without_sentinel(marked, ["y"]).where("y IS NULL").count() == 1


def test_codes_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "c.csv").write_text("huc4,n\n0301,5\n0107,x\n")
    schema = T.StructType([T.StructField("huc4", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(map(tuple, tables.read_codes_csv(spark, str(tmp_path / "c.csv"), schema).collect())) == [("0107", None), ("0301", 5)]


def test_encoding_fallback(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType())])
    for name, enc in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes("name\nRivière\n".encode(enc))
        assert tables.read_any_encoding(spark, str(tmp_path / name), schema).first().name == "Rivière"


def test_simulator_text_has_padded_headers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("COMID ,  Row\t\n".replace("\t", "") + "7 , 3\n")
    df = tables.read_simulator(spark, str(tmp_path / "s.txt"), schema=T.StructType([T.StructField("COMID", T.LongType()), T.StructField("Row", T.IntegerType())]))
    assert tuple(df.first()) == (7, 3)


def test_stats_csv_has_fixed_columns(spark, root):
    df = spark.createDataFrame([(1, None)], "comid long, b double")
    tables.write_stats_csv(df, ["comid", "a", "b"], f"{root}/s")
    assert tuple(spark.read.option("header", True).csv(f"{root}/s").first()) == ("1", "0.0", "0.0")


def obs(spark, reaches):
    rows = [(k, dt.datetime(2024, 1, d, h), float(k + h)) for k in reaches for d in (1, 2) for h in (0, 12)]
    return spark.createDataFrame(rows, schemas.FLOW_OBS)


def test_append_fetches_only_missing_reaches(spark, root):
    ids = spark.createDataFrame([(1,), (2,), (9,)], "reach_id long")
    tables.append_reaches(obs(spark, [1]), ids, f"{root}/store")
    tables.append_reaches(obs(spark, [1, 2, 3]), ids, f"{root}/store")
    assert days_of(spark, f"{root}/store") == [(1, 1, 7.0), (1, 2, 7.0), (2, 1, 8.0), (2, 2, 8.0)]


def days_of(spark, store):
    return sorted((r.reach_id, r.date.day, r.streamflow) for r in tables.read_daily_store(spark, store).collect())


def test_repeated_and_interrupted_appends(spark, root, monkeypatch):
    store, ids = f"{root}/store", spark.createDataFrame([(1,), (2,)], "reach_id long")
    assert days_of(spark, store) == []
    commit = tables._rename_if_new

    def lost(*_):
        raise RuntimeError("driver lost before the commit")

    monkeypatch.setattr(tables, "_rename_if_new", lost)
    with pytest.raises(RuntimeError):
        tables.append_reaches(obs(spark, [1, 2]), ids, store)
    assert days_of(spark, store) == []
    monkeypatch.setattr(tables, "_rename_if_new", commit)
    once = [(1, 1, 7.0), (1, 2, 7.0), (2, 1, 8.0), (2, 2, 8.0)]
    for batch in (1, 2):  # repeated after the loss, and once more
        assert tables.append_reaches(obs(spark, [1, 2]), ids, store) == batch
        assert days_of(spark, store) == once


def test_two_appends_at_once(spark, root, monkeypatch):
    """The other run commits between our look at the store and our commit."""
    store, commit, late = f"{root}/store", tables._rename_if_new, []

    def overtaken(*args):
        if not late:
            late.append(True)
            tables.append_reaches(obs(spark, [1]), spark.createDataFrame([(1,)], "reach_id long"), store)
        return commit(*args)

    monkeypatch.setattr(tables, "_rename_if_new", overtaken)
    assert tables.append_reaches(obs(spark, [1, 2]), spark.createDataFrame([(1,), (2,)], "reach_id long"), store) == 2
    assert days_of(spark, store) == [(1, 1, 7.0), (1, 2, 7.0), (2, 1, 8.0), (2, 2, 8.0)]


def test_layers_in_several_systems(spark, root):
    points = [(i, -120.0 + 0.9 * i, 30.0 + 0.3 * i) for i in range(50)]
    systems = {}
    for k, code in enumerate((4326, 5070, 3857, 32614, 26914, None)):
        rows = [p for p in points if p[0] % 6 == k and (code is None or code < 20000 or -102 <= p[1] < -96)]
        df = spark.createDataFrame(rows, "i int, lon double, lat double")
        x, y = geo.from_degrees(code or 4326, F.col("lat"), F.col("lon"))
        df = df.select("i", "lon", "lat", x.alias("x"), y.alias("y"))
        df = df if code else df.withColumn("extra", F.lit(1))
        for part in range(3):  # many files of one system are one scan
            path = f"{root}/{code}-{part}"
            df.where(F.floor(F.col("i") % 18 / 6) == part).write.parquet(path)
            systems[path] = code
    out = tables.union_in_one_system(spark, systems)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 5
    got = out.collect()
    assert len(got) == len({r.i for r in got}) > 30 and {r.source_system for r in got} == {4326, 5070, 3857, 32614, 26914}
    assert all(abs(r.x - r.lon) < 1e-8 and abs(r.y - r.lat) < 1e-8 for r in got)
    assert all((r.x, r.y) == (r.lon, r.lat) for r in got if r.source_system == 4326)
    assert all(r.extra == (1 if r.i % 6 == 5 else None) for r in got)
    back = tables.union_in_one_system(spark, systems, 5070).join(out.select("i", F.col("x").alias("lon2"), F.col("y").alias("lat2")), "i")
    x, y = geo.albers(F.col("lat2"), F.col("lon2"))
    assert back.where((F.abs(x - F.col("x")) > 1e-3) | (F.abs(y - F.col("y")) > 1e-3)).isEmpty()
    with pytest.raises(ValueError):
        tables.union_in_one_system(spark, {next(iter(systems)): 2154})


def test_daily_table_is_joined_without_moving_it(spark, root):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(d), float(k + d)) for k in range(40) for d in range(30)]
    rows += [(7, dt.date(2000, 1, 1) + dt.timedelta(d), 1.0) for d in range(3000)]  # a reach with most of the rows
    daily = spark.createDataFrame(rows, schemas.FLOW_DAILY)
    store = tables.write_daily_table(daily.where("date < '2024-01-15'"), "daily_test", f"{root}/daily", 8)
    store = tables.write_daily_table(daily.where("date >= '2024-01-15'"), "daily_test", f"{root}/daily", 8, "append")
    assert store.count() == len(rows)
    asked = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k % 40)) for k in range(30)], "reach_id long, day date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = flow.flow_on(asked, store, "day", "q")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan  # that of the questions
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(map(tuple, flow.flow_on(asked, daily, "day", "q").collect()))
    per_bucket = [r[0] for r in store.groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(per_bucket) < len(rows) / 4


def keyed_files(path):
    return {str(f) for f in (path / "parts=16").rglob("*.parquet")}


def test_merges_rewrite_touched_parts_only(spark, tmp_path, monkeypatch):
    path, schema = tmp_path / "keyed", schemas.schema("k BIGINT, a DOUBLE, b STRING")
    df = spark.createDataFrame([(k, float(k), "x") for k in range(200) for _ in range(1 + (k == 3) * 500)], schema)
    tables.write_keyed(df, str(path), ["k"], 16)
    before = keyed_files(path)
    fresh = spark.createDataFrame([(5, -5.0, None), (999, 1.0, "new")], schema)
    touched = tables.merge_keyed(fresh, str(path), schema, ["k"], keyed.upsert)
    after = keyed_files(path)
    parts = lambda files: {f.split("key_part=")[1].split("/")[0] for f in files}
    assert touched <= 2 and len(parts(before - after)) <= 2 and parts(after - before) == parts(before - after) | parts(after - before) and len(before & after) >= 14
    want = {(k, float(k), "x") for k in range(200) if k != 5} | {(5, -5.0, "x"), (999, 1.0, "new")}
    back = tables.read_keyed(spark, str(path), schema)
    assert set(map(tuple, back.collect())) == want and back.count() == 701
    # Keys replaced by nothing: all rows of every part go.
    nothing = spark.createDataFrame([(k, None, None) for k in [*range(200), 999]], schema)
    commit = tables._rename_if_new

    def lost(spark_, source, target):
        if "key_part=" in target and target.endswith("=4"):
            raise RuntimeError("driver lost while parts are exchanged")
        return commit(spark_, source, target)

    monkeypatch.setattr(tables, "_rename_if_new", lost)
    with pytest.raises(RuntimeError):
        tables.merge_keyed(nothing, str(path), schema, ["k"], keyed.replace_keys)
    monkeypatch.setattr(tables, "_rename_if_new", commit)
    # The next merge finishes the last one first.
    assert tables.merge_keyed(spark.createDataFrame([(1, 2.0, "y")], schema), str(path), schema, ["k"], keyed.replace_keys) == 1
    assert list(map(tuple, tables.read_keyed(spark, str(path), schema).collect())) == [(1, 2.0, "y")]
    assert tables.merge_keyed(nothing.limit(0), str(path), schema, ["k"], keyed.upsert) == 0


def test_flow_store_point_read(spark, root):
    tables.write_flow_store(obs(spark, range(20)), f"{root}/flow")
    hit = tables.flow_at(spark.read.parquet(f"{root}/flow"), 4, "2024-01-02")
    assert sorted(r.streamflow for r in hit.collect()) == [4.0, 16.0]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(reach_id,4)" in plan


def test_union_and_files_lacking_a_column(spark, root):
    spark.range(3).withColumn("label", F.lit("x")).write.parquet(f"{root}/a/one")
    spark.range(2).write.parquet(f"{root}/a/two")
    both = tables.union_of_files(spark, [f"{root}/a/one", f"{root}/a/two"])
    assert both.count() == 5 and both.where("label IS NULL").count() == 2
    lacking = [r.file for r in tables.files_lacking(spark, [f"{root}/a"], "label").collect()]
    assert lacking and all("/two/" in f for f in lacking)


def test_layers_and_per_site_tables(spark, root):
    df = spark.range(10).selectExpr("id % 3 AS site_id", "id")
    tables.write_layers({"dams": df, "lines": df.limit(1)}, f"{root}/out")
    tables.write_per_site(df, f"{root}/sites")
    assert spark.read.parquet(f"{root}/out/dams").count() == 10 and spark.read.parquet(f"{root}/sites").count() == 10


def test_late_rows_count_until_the_watermark(spark, root):
    obs(spark, [1]).coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(schemas.FLOW_OBS).parquet(f"{root}/in")
    daily = flow_stream.daily_mean_stream(stream, "1 hour")
    first = flow_stream.run_available(daily, f"{root}/t", f"{root}/cp").collect()
    assert [(r.date.day, r.streamflow) for r in first] == [(1, 7.0)]
    later = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 18), 4.0), (1, dt.datetime(2024, 1, 1, 3), 99.0), (1, dt.datetime(2024, 1, 4), 0.0)], schemas.FLOW_OBS)
    later.coalesce(1).write.mode("append").parquet(f"{root}/in")
    second = flow_stream.run_available(daily, f"{root}/t", f"{root}/cp").collect()
    assert sorted((r.date.day, round(r.streamflow, 6)) for r in second) == [(1, 7.0), (2, 6.0)]

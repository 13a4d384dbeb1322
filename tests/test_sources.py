import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.operators import windows
from fleetgauge.operators.splits import grouped_split, split_integrity
from fleetgauge.settings import WindowSpec
from fleetgauge.sources import archive, uploads
from fleetgauge.streaming import history, ingest


def test_mixed_headers_bind_by_name(spark, tmp_path):
    (tmp_path / "q1").mkdir()
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "q1" / "2020-01-01.csv").write_text("date,serial_number,failure,smart_5_raw\n2020-01-01,A,0,7\n2020-01-01,B,,x\n")
    (tmp_path / "q1" / "2020-01-02.csv").write_text("serial_number,smart_9_raw,date,other\nA,11,2020-01-02,z\nC,NaN,bad,z\n")
    (tmp_path / "q1" / "._2020-01-02.csv").write_text("junk")
    (tmp_path / "__MACOSX" / "2020-01-03.csv").write_text("junk\n1\n")
    (tmp_path / "q1" / "notes.txt").write_text("junk")
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("serial_number", T.StringType()),
                           T.StructField("failure", T.ByteType()), T.StructField("smart_5_raw", T.FloatType()),
                           T.StructField("smart_9_raw", T.DoubleType()), T.StructField("pod_id", T.StringType())])
    raw = archive.read_daily_csvs(spark, str(tmp_path), [f.name for f in schema.fields])
    df = archive.to_schema(raw, schema)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
    got = {(r.serial_number, r.date, r.failure, r.smart_5_raw, r.smart_9_raw) for r in df.collect()}
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    assert got == {("A", d1, 0, 7.0, None), ("B", d1, 0, None, None), ("A", d2, 0, None, 11.0), ("C", None, 0, None, None)}
    assert archive.drop_keyless(df).count() == 3


def test_archive_rerun_replaces_only_its_shard(spark, tmp_path):
    rows = [("2019_Q4", 1, 0), ("2020_Q1", 1, 0), ("2020_Q1", 2, 1)]
    df = spark.createDataFrame(rows, "archive string, drive bigint, failure int")
    path = str(tmp_path / "a")
    archive.write_archive(df, path)
    archive.write_archive(df.where("archive = '2020_Q1'").where("drive = 2"), path)
    got = {(r.archive, r.drive) for r in archive.read_archive(spark, path).collect()}
    assert got == {("2019_Q4", 1), ("2020_Q1", 2)}
    recent = archive.read_archive(spark, path, since_year=2020)
    assert {r.archive for r in recent.collect()} == {"2020_Q1"}
    assert "PartitionFilters: [isnotnull" in recent._jdf.queryExecution().toString() or "regexp_extract" in recent._jdf.queryExecution().toString()


def test_header_aliases(spark):
    df = spark.createDataFrame([(1, "x", 3, 4)], [" ID ", "Time", "serial", "failure"])
    out, notes = uploads.canonical_headers(df)
    assert out.columns == ["id", "date", "serial_number", "failure"] and notes == ["serial -> serial_number", "time -> date"]


def test_log_conversion_rules(spark):
    rows = [("2024-01-01 01:00", " s1 ", 1, 10.0, "5", 0), ("2024-01-01 05:00", "s1", 2, None, "7", 1), ("bad", "s1", 3, 1.0, "1", 0)]
    df = spark.createDataFrame(rows, "timestamp string, Serial string, seq int, `Power-On Hours` double, Reallocated_Sector_Ct string, failure int")
    got = uploads.convert_log(df, ["seq"]).collect()
    assert [(r.serial_number, r.date, r.failure, r.smart_5_raw, r.smart_9_raw) for r in got] == [("s1", dt.date(2024, 1, 1), 1, 7.0, 10.0)]
    assert uploads.convert_log(df, ["seq"], aggregate="mean").first().smart_5_raw == 6.0
    with pytest.raises(ValueError):
        uploads.convert_log(df.select("Serial"), ["Serial"])


def test_tool_json(spark):
    def doc(serial, table, name="M"):
        return json.dumps({"serial_number": serial, "model_name": name, "ata_smart_attributes": {"table": table} if table else None})

    good = doc(" A ", [{"id": 5, "raw": {"value": 3, "string": "3"}}, {"id": 194, "raw": {"value": None}}, {"id": 999, "raw": {"value": 1}}])
    docs = spark.createDataFrame([(good,), (doc("", [{"id": 5, "raw": {"value": 1}}]),), (doc("B", None),), ("not json",)], "value string")
    rows = uploads.parse_tool_json(docs).collect()
    assert [(r.serial_number, r.model, r.smart_5_raw, r.smart_194_raw) for r in rows] == [("A", "M", 3, None)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "drive int, day int, v int")
    new = spark.createDataFrame([(1, 2, 9), (2, 1, 1)], "drive int, day int, v int")
    once = uploads.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, uploads.upsert(once, new).collect())) == [(1, 1, 5), (1, 2, 9), (2, 1, 1)]


def test_grouped_split_sizes(spark):
    drives = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(203)], "drive bigint, has_failure int")
    got = grouped_split(drives).groupBy("has_failure", "split").count().collect()
    sizes = {(r.has_failure, r.split): r["count"] for r in got}
    assert sizes[(1, "test")] == 4 and sizes[(1, "val")] == 3 and sizes[(0, "test")] == 36 and sizes[(0, "val")] == 22
    assert sum(sizes.values()) == 203
    assert all(r.shared == 0 for r in split_integrity(grouped_split(drives)).collect())


SCHEMA = "drive bigint, day date, seq bigint, a double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_ingest_takes_each_file_once(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for i in range(2):
        spark.createDataFrame([(i, day, 0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_new_files(spark, src, schema, sink, ck)
    assert sorted(r.drive for r in spark.read.parquet(sink).collect()) == [0, 1]


def test_upsert_stream_resend_and_late_days(spark, tmp_path):
    d = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    rows = lambda *r: spark.createDataFrame([(*x, 0) for x in r], "drive bigint, day date, a double, failure int")
    table = str(tmp_path / "t")
    ingest.upsert_days(rows((1, d[1], 1.0), (1, d[2], 2.0)), table)
    ingest.upsert_days(rows((1, d[2], 5.0), (1, d[0], 9.0), (2, d[2], 7.0)), table)
    ingest.upsert_days(rows((1, d[2], 5.0), (1, d[0], 9.0), (2, d[2], 7.0)), table)
    got = {(r.drive, r.day, r.a) for r in spark.read.parquet(table).collect()}
    assert got == {(1, d[0], 9.0), (1, d[1], 1.0), (1, d[2], 5.0), (2, d[2], 7.0)}


def test_history_state_over_batches(spark, tmp_path):
    d0 = dt.date(2024, 1, 1)
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [[(1, d0, 0, 10.0)], [(1, d0, 1, 12.0), (1, d0 + dt.timedelta(days=8), 0, 20.0)],
               [(1, d0 + dt.timedelta(days=9), 0, 30.0), (1, d0 + dt.timedelta(days=7), 1, 50.0)],
               [(None, d0 + dt.timedelta(days=90), None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        out = history.history_deltas(spark.readStream.schema(schema).parquet(src), ["a"])
        ingest.run_available(out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck))
    got = {((r.day - d0).days, r.a): r.a_delta7 for r in spark.read.parquet(sink).collect()}
    # Days 7 and 8 meet the day-0 value that was sent last; day 9 has nothing within a day of day 2.
    assert got == {(0, 12.0): None, (7, 50.0): 38.0, (8, 20.0): 8.0, (9, 30.0): None}


def test_history_keeps_sixty_days(spark, tmp_path):
    d0 = dt.date(2024, 1, 1)
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([(1, d0 + dt.timedelta(days=i), 0, float(i)) for i in range(80)], [(1, d0 + dt.timedelta(days=21), 1, 500.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        out = history.history_deltas(spark.readStream.schema(schema).parquet(src), ["a"])
        ingest.run_available(out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck))
    late = spark.read.parquet(sink).where(F.col("a") == 500.0).first()
    assert late.a_delta7 is None          # days 13 to 15 had been forgotten


def test_schema_survives_bad_values(spark):
    df = spark.createDataFrame([("1e30", "300", "9007199254740993", "x"), ("5.0", "1", "12", "7")], "capacity_bytes string, failure string, pod_id string, smart_1 string")
    got = archive.to_schema(df, archive.export_schema(["smart_1"])).select("capacity_bytes", "failure", "pod_id", "smart_1").collect()
    assert [tuple(r) for r in got] == [(None, 0, 9007199254740993, None), (5, 1, 12, 7.0)]
    assert len(archive.SHARD_SMART_IDS) == 23 and {189, 242} <= set(archive.SHARD_SMART_IDS)
    assert archive.to_schema(df, archive.shard_schema()).count() == 2


def test_daily_files_long_header_latin_and_stray(spark, tmp_path):
    filler = ",".join(f"extra_{i:05d}" for i in range(9000))
    (tmp_path / "a.csv").write_bytes(("date,serial_number,model," + filler + ",last\n2024-01-01,Z1,Modèle," + "," * 8999 + ",9\n").encode("latin-1"))
    (tmp_path / "b.csv").write_text("date,serial_number,model\n2024-01-02,Z2,M\n")
    (tmp_path / "notes.csv").write_text("what,ever\n1,2\n")
    got = archive.read_daily_csvs(spark, str(tmp_path), ["serial_number", "model", "last"]).collect()
    assert sorted(map(tuple, got), key=str) == [("Z1", "Modèle", "9"), ("Z2", "M", None)]


def test_a_one_day_batch_is_written_by_several_tasks(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        batch = spark.range(20_000).select(F.col("id").alias("drive"), F.lit(day).alias("day"), F.rand(1).alias("a"), F.lit(0).alias("failure"))
        ingest.upsert_days(batch, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "day=2024-01-01").glob("*.parquet"))) > 1


def test_tiles_of_text_drives(spark):
    drives = spark.createDataFrame([("ZA1", 70, []), ("ZB2", 45, [40]), ("ZC3", 30, [])], "drive string, n_days int, fail_pos array<int>")
    got = windows.shuffled_tiles(drives, WindowSpec(attrs=("a",)), epoch=1).collect()
    assert sorted(r.seq for r in got) == list(range(len(got))) and {r.drive for r in got} == {"ZA1", "ZB2", "ZC3"}


def test_shard_states_merge_to_the_whole(spark, tmp_path):
    """Shards summed up one by one, one of them twice, give the census and quantiles of all readings; a drive in two shards counts once."""
    import datetime as dt
    import random

    from fleetgauge.operators.calendar import census
    from fleetgauge.sources import shard_stats
    r = random.Random(1)
    rows = [(f"s{i % 3}", r.randrange(40) if i % 50 else None, dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(90)), int(r.random() < 0.02),
             None if i % 7 == 0 else float("nan") if i % 11 == 0 else r.random() ** 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "archive string, drive int, day date, failure int, v double")
    for shard in ("s0", "s1", "s2", "s1"):
        shard_stats.add_shards(df.where(F.col("archive") == shard), str(tmp_path), ["v"])
    key = sorted(census(df.where("drive IS NOT NULL")).columns)
    assert sorted(map(str, shard_stats.merged_census(spark, str(tmp_path)).select(*key).collect())) == \
        sorted(map(str, census(df.where("drive IS NOT NULL")).select(*key).collect()))
    assert tuple(shard_stats.distinct_drives(spark, str(tmp_path)).first()) == (3, len({d for _, d, *_ in rows if d is not None}))
    both = {d for a, d, *_ in rows if a == "s0" and d is not None} & {d for a, d, *_ in rows if a == "s2" and d is not None}
    assert shard_stats.shared_drives(spark, str(tmp_path), "s0", "s2").first()[0] == len(both)
    seen = sorted(v for *_, v in rows if v is not None and v == v)
    for q in shard_stats.merged_quantiles(spark, str(tmp_path), [0.1, 0.5, 0.99]).collect():
        assert q.n == len(seen) and abs(sum(v <= q["value"] for v in seen) / len(seen) - q.prob) <= 2 * shard_stats.rank_error()
    ranks = shard_stats.ranks_of(df, shard_stats.merged_quantiles(spark, str(tmp_path), [0.5]), ["v"]).first()
    assert ranks.below < ranks.upto and abs(ranks.upto - 0.5) < 0.02

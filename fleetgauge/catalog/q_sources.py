"""Ingest, conversion and streaming queries. Files are written from the supplied tables to a work folder first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import calendar as cal
from ..sources import archive, cohorts, shard_stats, sinks, uploads
from ..streaming import history, ingest
from ..streaming import windows as stream_windows
from ..session import settle, work_folder
from .base import query
from .views import EVENTS_SQL, SUPPLY_SPEC, SUPPLY_SQL, census_sql, events_days, label_sql, supply_days, table, tiles_sql

WITH = f"WITH {EVENTS_SQL}"


def write_daily_csvs(spark, d) -> str:
    """Two generations of daily files: the second drops columns, adds one and changes the order."""
    folder = work_folder(spark)
    days = events_days(spark, d).select(
        F.col("day").alias("date"), F.col("drive").alias("serial_number"), "model", "failure",
        F.col("n_click").alias("smart_5_raw"), F.col("m_view").alias("smart_9_raw"), F.col("m_error").alias("smart_194_raw"))
    (days.where("serial_number % 2 = 0").select("date", "serial_number", "model", "failure", "smart_5_raw", "smart_9_raw")
     .write.csv(f"{folder}/old", header=True))
    (days.where("serial_number % 2 = 1").select("smart_9_raw", "serial_number", "date", "failure", "smart_194_raw",
                                                F.lit("x").alias("extra")).write.csv(f"{folder}/new", header=True))
    return folder


_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("serial_number", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("failure", T.ByteType()), T.StructField("smart_5_raw", T.DoubleType()), T.StructField("smart_9_raw", T.DoubleType()),
    T.StructField("smart_194_raw", T.DoubleType()), T.StructField("capacity_bytes", T.DoubleType())])


@query("s1_daily_csvs", "date:d serial_number:s model:s failure:i smart_5_raw:r smart_9_raw:r smart_194_raw:r capacity_bytes:r",
       f"""{WITH} SELECT day AS date, drive AS serial_number, CASE WHEN drive % 2 = 0 THEN model END AS model, failure,
       CASE WHEN drive % 2 = 0 THEN n_click END AS smart_5_raw, m_view AS smart_9_raw,
       CASE WHEN drive % 2 = 1 THEN m_error END AS smart_194_raw, NULL AS capacity_bytes FROM dd""")
def _(spark, d):
    raw = archive.read_daily_csvs(spark, write_daily_csvs(spark, d), [f.name for f in _CSV_SCHEMA.fields])
    return archive.to_schema(raw, _CSV_SCHEMA)


@query("s2_pinned_schema", "date:d serial_number:s failure:i smart_9_raw:r datacenter:s",
       """SELECT CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date, CAST(user_id AS VARCHAR) AS serial_number,
       CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure,
       CASE WHEN event_id % 17 IN (0, 1) THEN NULL ELSE value END AS smart_9_raw, NULL AS datacenter FROM events""")
def _(spark, d):
    e = F.col("event_id")
    raw = table(spark, d, "events").select(
        F.when(e % 19 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("user_id").cast("string").alias("serial_number"),
        F.when(e % 7 == 0, F.lit(None)).when(F.col("event_type") == "error", "1").otherwise("0").alias("failure"),
        F.when(e % 17 == 0, "n/a").when(e % 17 == 1, "NaN").otherwise(F.col("value").cast("string")).alias("smart_9_raw"))
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("serial_number", T.StringType()),
                           T.StructField("failure", T.ByteType()), T.StructField("smart_9_raw", T.DoubleType()),
                           T.StructField("datacenter", T.StringType())])
    return archive.to_schema(raw, schema)


@query("s3_daily_file_filter", "folder:s", f"{WITH} SELECT DISTINCT 'model=' || model AS folder FROM dd")
def _(spark, d):
    folder = work_folder(spark)
    days = events_days(spark, d)
    days.write.partitionBy("model").csv(f"{folder}/data", header=True)
    days.where("drive % 2 = 0").write.csv(f"{folder}/__MACOSX/model=junk", header=True)
    days.where("drive % 2 = 0").write.parquet(f"{folder}/model=parquet")
    files = archive.list_daily_files(spark, folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


_ARCHIVE_SQL = f"""WITH {SUPPLY_SQL}, ar AS (SELECT *, 'data_' || year(day) || '_Q' || quarter(day) AS archive FROM dd)"""


def built_archive(spark, d) -> str:
    folder = work_folder(spark)
    name = F.concat(F.lit("data_"), F.year("day"), F.lit("_Q"), F.quarter("day"))
    archive.write_archive(supply_days(spark, d).withColumn("archive", name), f"{folder}/archive")
    return f"{folder}/archive"


@query("s4_archive_build", "archive:s rows:i drives:i failures:i",
       f"{_ARCHIVE_SQL} SELECT archive, count(*) AS rows, count(DISTINCT drive) AS drives, sum(failure) AS failures FROM ar GROUP BY archive")
def _(spark, d):
    return archive.archive_summary(archive.read_archive(spark, built_archive(spark, d)))


def summed_shards(spark, d) -> tuple[str, str]:
    """An archive and the states of its shards: all up to 1994 first, then the later ones, then one shard once more."""
    path, folder = built_archive(spark, d), work_folder(spark)
    name = F.col("archive").cast("string")
    shards = archive.read_archive(spark, path)
    for some in (name < "data_1995", name >= "data_1995", name == "data_1996_Q2"):
        shard_stats.add_shards(shards.where(some), folder, ("q", "n", "p"))
    return path, folder


@query("s4_merged_census", "drive:i first_day:d last_day:d n_days:i n_obs:i n_fail:i has_failure:i",
       f"WITH {SUPPLY_SQL}, {census_sql()} SELECT * FROM cal")
def _(spark, d):
    return shard_stats.merged_census(spark, summed_shards(spark, d)[1])


@query("s4_distinct_drives", "shards:i drives:i", f"{_ARCHIVE_SQL} SELECT count(DISTINCT archive) AS shards, count(DISTINCT drive) AS drives FROM ar")
def _(spark, d):
    return shard_stats.distinct_drives(spark, summed_shards(spark, d)[1])


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("x4_merged_quantiles", "column:s n:i prob:r within:i",
       f"""{_ARCHIVE_SQL}, v AS (SELECT unnest(['q', 'n', 'p']) AS "column", unnest([CAST(q AS DOUBLE), CAST(n AS DOUBLE), CAST(p AS DOUBLE)]) AS v FROM ar)
       SELECT "column", count(v) AS n, unnest([{", ".join(map(str, _PROBS))}]) AS prob, 1 AS within FROM v GROUP BY "column" """)
def _(spark, d):
    """Quantiles from the stored sketches: their rank in all rows is right to twice the error that 99 of 100 keep."""
    path, folder = summed_shards(spark, d)
    quantiles = settle(shard_stats.merged_quantiles(spark, folder, _PROBS))
    ranks = shard_stats.ranks_of(archive.read_archive(spark, path), quantiles, ("q", "n", "p"))
    error = 2 * shard_stats.rank_error()
    inside = (F.col("below") - error <= F.col("prob")) & (F.col("prob") <= F.col("upto") + error)
    return quantiles.join(ranks.drop("value"), ["column", "prob"]).withColumn("within", inside.cast("int"))


@query("s5_archive_since_year", "drive:i day:d q:r", f"{_ARCHIVE_SQL} SELECT drive, day, q FROM ar WHERE year(day) >= 1996")
def _(spark, d):
    return archive.read_archive(spark, built_archive(spark, d), since_year=1996, columns=("drive", "day", "q"))


@query("s6_export_by_model", "model:s rows:i drives:i",
       f"{WITH} SELECT model, count(*) AS rows, count(DISTINCT drive) AS drives FROM dd GROUP BY model")
def _(spark, d):
    path = f"{work_folder(spark)}/by_model"
    archive.write_by_model(events_days(spark, d), path)
    per = spark.read.parquet(path).groupBy("model", "drive").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("model").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("drives"))


_CHUNKS = """ck AS (SELECT day, CAST(floor((row_number() OVER (ORDER BY day) - 1) / 10) AS INTEGER) AS chunk,
  datediff('day', lag(day) OVER (ORDER BY day), day) - 1 AS gap FROM (SELECT DISTINCT day FROM dd) x)"""


@query("s7_day_chunks", "day:d chunk:i gap:i", f"{WITH}, {_CHUNKS} SELECT * FROM ck")
def _(spark, d):
    return archive.day_chunks(events_days(spark, d), 10)


@query("s7_chunk_summary", "chunk:i days:i first_day:d last_day:d rows:i drives:i failures:i full_drives:i",
       f"""{WITH}, {_CHUNKS}, per AS (SELECT chunk, drive, count(*) AS n FROM dd JOIN ck ON ck.day = dd.day GROUP BY chunk, drive)
       SELECT ck.chunk, count(DISTINCT dd.day) AS days, min(dd.day) AS first_day, max(dd.day) AS last_day, count(*) AS rows,
              count(DISTINCT drive) AS drives, sum(failure) AS failures,
              (SELECT count(*) FROM per WHERE per.chunk = ck.chunk AND n >= 8) AS full_drives
       FROM dd JOIN ck ON ck.day = dd.day GROUP BY ck.chunk""")
def _(spark, d):
    return archive.chunk_summary(events_days(spark, d), 10, full_days=8)


@query("s9_load_cohort", "drive:i day:d model:s failure:i n_view:i",
       f"{WITH} SELECT drive, day, model, failure, n_view FROM dd WHERE model LIKE 'M1%'")
def _(spark, d):
    path = f"{work_folder(spark)}/quarter"
    events_days(spark, d).write.parquet(path)
    return cohorts.load_cohort(spark, [path], "M1", ["n_view"])


@query("s10_renamed_load", "id:i time:d quantity:r", "SELECT l_suppkey AS id, l_shipdate AS time, l_quantity AS quantity FROM lineitem")
def _(spark, d):
    return cohorts.load_renamed(spark, f"{d}/lineitem.parquet", {"l_suppkey": "id", "l_shipdate": "time", "l_quantity": "quantity"})


@query("s11_s12_upload_headers", "serial_number:s date:d model:s failure:i smart_5_raw:r",
       f"{WITH} SELECT CAST(drive AS VARCHAR) AS serial_number, day AS date, model, failure, n_click AS smart_5_raw FROM dd")
def _(spark, d):
    path = f"{work_folder(spark)}/upload.csv"
    events_days(spark, d).select(
        F.col("drive").alias("Serial"), F.col("day").alias(" Timestamp "), F.col("model").alias("Drive_Model"),
        F.col("failure").alias("FAILED"), F.col("n_click").alias("SMART_5_raw")).write.csv(path, header=True)
    df, _ = uploads.canonical_headers(uploads.read_upload(spark, path))
    return archive.to_schema(df, T.StructType([
        T.StructField("serial_number", T.StringType()), T.StructField("date", T.DateType()), T.StructField("model", T.StringType()),
        T.StructField("failure", T.ByteType()), T.StructField("smart_5_raw", T.DoubleType())]))


@query("s13_tool_json", "event_id:i serial_number:s model:s smart_5_raw:i smart_9_raw:i smart_194_raw:i",
       """SELECT event_id, CAST(user_id AS VARCHAR) AS serial_number, event_type AS model,
       CAST(json_extract(props, '$.k') AS BIGINT) AS smart_5_raw,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS smart_9_raw, NULL AS smart_194_raw
       FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def _(spark, d):
    ev = table(spark, d, "events")
    e = F.col("event_id")

    def entry(i, value):
        return F.struct(F.lit(i).alias("id"), F.struct(value.cast("bigint").alias("value"), F.lit("text").alias("string")).alias("raw"))

    attrs = F.array(entry(5, F.get_json_object("props", "$.k")), entry(9, F.when(e % 5 != 0, F.floor("value"))), entry(231, e))
    doc = F.to_json(F.struct(
        F.when(e % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("serial_number"),
        F.when(e % 2 == 0, F.col("event_type")).otherwise("").alias("model_name"), F.col("event_type").alias("model_family"),
        F.when(e % 11 != 0, F.struct(attrs.alias("table"))).alias("ata_smart_attributes")))
    return uploads.parse_tool_json(ev.select("event_id", doc.alias("value")))


@query("s14_daily_upsert", "drive:i day:d n_click:i",
       f"""{WITH}, fresh AS (SELECT drive, day, n_click + 100 AS n_click FROM dd WHERE day >= (SELECT max(day) - 5 FROM dd) AND drive % 3 <> 0
         UNION ALL SELECT drive, max(day) + 1, 7 FROM dd GROUP BY drive)
       SELECT drive, day, n_click FROM dd WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.drive = dd.drive AND f.day = dd.day)
       UNION ALL SELECT * FROM fresh""")
def _(spark, d):
    days = events_days(spark, d).select("drive", "day", "n_click")
    newest = days.agg(F.max("day").alias("_m"))
    changed = (days.join(F.broadcast(newest), F.col("day") >= F.date_sub("_m", 5)).where("drive % 3 <> 0")
               .select("drive", "day", (F.col("n_click") + 100).alias("n_click")))
    added = days.groupBy("drive").agg(F.date_add(F.max("day"), 1).alias("day")).withColumn("n_click", F.lit(7).cast("bigint"))
    return uploads.upsert(days, changed.unionByName(added))


def _log(spark, d):
    ev = table(spark, d, "events")
    v = F.col("value")
    return ev.select(
        F.col("ts").alias("Collected At"), F.col("user_id").alias("serial"), F.lit("bay").alias("device"), "event_id",
        F.when(F.col("event_type") == "error", v).alias("Temperature_Celsius"),
        F.when(F.col("event_type") == "view", v.cast("string")).otherwise("-").alias("power on hours"),
        F.when(F.col("event_type") == "click", v).alias("SMART_5_RAW"),
        F.when(F.col("event_type") == "signup", F.lit(1)).alias("Failure"))


def _log_sql(kind: str) -> str:
    def agg(cond: str) -> str:
        return {"last": f"arg_max(value, event_id) FILTER (WHERE {cond})", "max": f"max(value) FILTER (WHERE {cond})",
                "mean": f"avg(value) FILTER (WHERE {cond})"}[kind]
    return f"""SELECT CAST(user_id AS VARCHAR) AS serial_number, CAST(ts AS DATE) AS date,
      {agg("event_type = 'click'")} AS smart_5_raw, {agg("event_type = 'view'")} AS smart_9_raw,
      {agg("event_type = 'error'")} AS smart_194_raw, max(CASE WHEN event_type = 'signup' THEN 1 END) AS failure
      FROM events GROUP BY 1, 2"""


for _kind in ("last", "max", "mean"):
    def _convert(spark, d, kind=_kind):
        return uploads.convert_log(_log(spark, d), ["event_id"], aggregate=kind)

    query(f"s15_convert_log_{_kind}", "serial_number:s date:d smart_5_raw:h smart_9_raw:h smart_194_raw:h failure:i", _log_sql(_kind))(_convert)


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("s16_pivot_long", "day:d serial:i " + " ".join(f"{t}:r" for t in _TYPES),
       "SELECT CAST(ts AS DATE) AS day, user_id AS serial, " + ", ".join(
           f"arg_max(value, ts) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1, 2")
def _(spark, d):
    long = table(spark, d, "events").select("ts", F.col("user_id").alias("serial"), F.col("event_type").alias("attribute"), "value")
    return uploads.pivot_long(long)


@query("s18_manifest_pick", "model:s file:s failures:i size_mb:r",
       f"""WITH {SUPPLY_SQL}, {census_sql()}, m AS (SELECT 'L' || (drive % 9) AS model, 'f' || drive AS file, n_days, n_fail AS failures, n_obs / 10.0::DOUBLE AS size_mb FROM cal),
       r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY size_mb, file) AS rn FROM m WHERE n_days >= 365)
       SELECT model, file, failures, size_mb FROM r WHERE rn = 1 ORDER BY CASE WHEN failures = 0 THEN 1 ELSE 0 END, size_mb, model LIMIT 6""")
def _(spark, d):
    per = cal.census(supply_days(spark, d), single_pass=True)
    manifest = per.select(F.concat(F.lit("L"), F.col("drive") % 9).alias("model"), F.concat(F.lit("f"), F.col("drive")).alias("file"),
                          F.col("first_day").alias("window_start"), F.col("last_day").alias("window_end"),
                          F.col("n_fail").alias("failures"), (F.col("n_obs") / 10.0).alias("size_mb"))
    return cohorts.pick_exports(manifest, 365)


@query("s19_result_sinks", "sink:s rows:i",
       f"{WITH} SELECT 'verdicts' AS sink, count(*) AS rows FROM dd UNION ALL SELECT 'summary', 1 UNION ALL "
       "SELECT 'by_model', count(DISTINCT model) FROM dd UNION ALL SELECT 'verdicts_csv', count(*) FROM dd")
def _(spark, d):
    folder = work_folder(spark)
    days = events_days(spark, d)
    sinks.write_results(folder, days.agg(F.count(F.lit(1)).alias("n")), days,
                        {"by_model": days.groupBy("model").agg(F.sum("failure").alias("failures"))}, verdict_csv=True)
    one = F.count(F.lit(1)).alias("rows")
    parts = [spark.read.parquet(f"{folder}/verdicts").agg(one).withColumn("sink", F.lit("verdicts")),
             spark.read.json(f"{folder}/summary").agg(one).withColumn("sink", F.lit("summary"))]
    parts += [spark.read.csv(f"{folder}/{n}", header=True).agg(one).withColumn("sink", F.lit(n)) for n in ("by_model", "verdicts_csv")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s21_drop_keyless", "serial_number:s date:d value:r",
       """SELECT CAST(o_custkey AS VARCHAR) AS serial_number, o_orderdate AS date, o_totalprice AS value FROM orders
       WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def _(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("serial_number"),
                   F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("date"), F.col("o_totalprice").alias("value"))
    return archive.drop_keyless(raw)


# ---- streaming -----------------------------------------------------------------------------------

def events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("t1_incremental_ingest", "event_type:s n:i total:r",
       "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def _(spark, d):
    folder = work_folder(spark)
    schema = table(spark, d, "events").schema
    for _ in range(2):                      # the second run finds nothing new
        ingest.ingest_new_files(spark, d, schema, f"{folder}/table", f"{folder}/checkpoint", glob="events.parquet")
    return spark.read.parquet(f"{folder}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("t2_upsert_stream", "drive:i day:d failure:i event_id:i value:r",
       """SELECT drive, day, failure, event_id, value FROM (
            SELECT user_id AS drive, CAST(ts AS DATE) AS day, event_id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure,
                   row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
                     ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1""")
def _(spark, d):
    folder = work_folder(spark)
    for run in ("first", "again"):          # sending everything again changes nothing
        readings = events_stream(spark, d).select(
            F.col("user_id").alias("drive"), F.to_date("ts").alias("day"),
            (F.col("event_type") == "error").cast("int").alias("failure"), "event_id", "value")
        ingest.upsert_stream(readings, f"{folder}/table", f"{folder}/{run}", ["event_id"])
    return spark.read.parquet(f"{folder}/table")


_T3 = f"""{WITH}, c AS (SELECT a.drive, a.day, b.day AS prior_day, a.n_click, a.n_click - b.n_click AS n_click_delta7, a.m_view - b.m_view AS m_view_delta7,
            row_number() OVER (PARTITION BY a.drive, a.day ORDER BY abs(datediff('day', b.day, a.day) - 7), b.day) AS rn
            FROM dd a LEFT JOIN dd b ON b.drive = a.drive AND datediff('day', b.day, a.day) BETWEEN 6 AND 8)"""


FILE_ROWS = 1 << 18       # about, in a file of a replayed stream


def replay(spark, days, shuffled: F.Column, batches: int = 6, beat: int = 400):
    """The drive-days as a stream of a few spans of arrival, each with its days in no order in as many files as the others have, and a heartbeat
    long after all of them."""
    folder = work_folder(spark)
    hashed = settle(days.withColumn("_arrival", F.unix_date("day") + shuffled).withColumn("_mixed", F.crc32(F.concat_ws(":", "drive", "day"))))
    low, high, n = hashed.agg(F.min("_arrival"), F.max("_arrival"), F.count(F.lit(1))).first()
    files = -(-n // (batches * FILE_ROWS))
    part = F.floor((F.col("_arrival") - low) * batches / (high - low + 1)).cast("int")
    end = spark.createDataFrame([(None,)], days.select("drive").schema).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), high + beat))
    rows = hashed.withColumn("_part", part).unionByName(end.withColumn("_part", F.lit(batches)), allowMissingColumns=True)
    for i in range(batches + 1):          # one span after the other, so that the order of the files' times is the spans'
        span = rows.where(F.col("_part") == i).repartition(files, "_mixed").sortWithinPartitions("_mixed").select(*days.columns)
        span.write.mode("append").parquet(f"{folder}/in")
        if i < batches:
            for _ in range((i + 1) * files - len(spark.read.schema(days.schema).parquet(f"{folder}/in").inputFiles())):          # a part without a day has no file
                span.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(days.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


def kept(spark, out, folder):
    ingest.run_available(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


def hashed_days(n: int):
    """0 to n - 1 days, by drive and day."""
    return (F.crc32(F.concat_ws(":", "drive", "day")) % n).cast("int")


def drive_history(spark, d, shape=lambda df: df):
    """The drive-days, each up to three days late, replayed through per-drive history state."""
    days = settle(events_days(spark, d).withColumn("seq", F.lit(0).cast("bigint")).select("drive", "day", "seq", "n_click", "m_view"))
    stream, folder = replay(spark, days, hashed_days(4))
    return kept(spark, shape(history.history_deltas(stream, ["n_click", "m_view"], late="4 days")), folder)


@query("t3_drive_history", "drive:i day:d prior_day:d n_click:r n_click_delta7:r m_view_delta7:r", f"{_T3} SELECT * FROM c WHERE rn = 1")
def _(spark, d):
    return drive_history(spark, d)


@query("t3_drive_history_risk", "drive:i day:d score:r risk:s action:s",
       f"""{_T3}, s AS (SELECT drive, day, round(1 / (1 + exp(-(n_click + coalesce(n_click_delta7, 0)))), 6) AS score FROM c WHERE rn = 1),
       b AS (SELECT *, CASE WHEN score < 0.6 THEN 'LOW' WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM s)
       SELECT *, CASE risk WHEN 'CRITICAL' THEN 'inspect or replace now' WHEN 'HIGH' THEN 'schedule inspection soon'
                 WHEN 'MEDIUM' THEN 'monitor closely' ELSE 'none' END AS action FROM b""")
def _(spark, d):
    # A delta that is not known yet is filled as at serving: with the training median, here 0.
    z = F.col("n_click") + F.coalesce("n_click_delta7", F.lit(0.0))
    return drive_history(spark, d, lambda df: history.with_band(
        df.withColumn("score", F.round(1 / (1 + F.exp(-z)), 6)), "score", 0.6))


def _windowed(spark, d, **kw):
    folder = work_folder(spark)
    readings = events_stream(spark, d).select(F.col("user_id").alias("drive"), "ts", "value")
    out = stream_windows.event_time_windows(readings, **kw)
    ingest.run_available(out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
                         .option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


_E = "datediff('day', DATE '1970-01-01', CAST(ts AS DATE))"
_CLOSED = """SELECT drive, DATE '1970-01-01' + CAST(s AS INTEGER) AS start, DATE '1970-01-01' + CAST(s + 7 AS INTEGER) AS "end",
   count(*) AS n, sum(value) AS total, max(value) AS peak FROM x
   WHERE CAST(DATE '1970-01-01' + CAST(s + 7 AS INTEGER) AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY drive, s"""


@query("t4_tumbling_windows", "drive:i start:d end:d n:i total:r peak:r",
       f"WITH x AS (SELECT user_id AS drive, value, {_E} // 7 * 7 AS s FROM events) {_CLOSED}")
def _(spark, d):
    return _windowed(spark, d, days=7)


@query("t4_sliding_windows", "drive:i start:d end:d n:i total:r peak:r",
       f"WITH x AS (SELECT user_id AS drive, value, unnest([{_E} // 2 * 2 - 6, {_E} // 2 * 2 - 4, {_E} // 2 * 2 - 2, {_E} // 2 * 2]) AS s, {_E} AS e FROM events), "
       f"y AS (SELECT * FROM x WHERE s + 7 > e) {_CLOSED.replace('FROM x', 'FROM y')}")
def _(spark, d):
    return _windowed(spark, d, days=7, stride=2)


# Windows from each drive's first day. Readings are up to three days late, and some of them up to 200 days, long after their windows were sent.
_READ = """SELECT w.drive, w.start, {label} AS label, count(dd.drive) AS n, sum(dd.q) AS total, max(dd.q) AS peak
   FROM {wins} w LEFT JOIN dd ON dd.drive = w.drive AND datediff('day', w.first_day, dd.day) BETWEEN w.start AND w.start + 29 GROUP BY w.drive, w.start"""


def anchored(spark, d, stride=None):
    days = settle(supply_days(spark, d).select("drive", "day", F.lit(0).cast("bigint").alias("seq"), "failure", F.col("q").alias("value")))
    late = hashed_days(4) + F.when(hashed_days(37) == 0, 200).otherwise(0)
    stream, folder = replay(spark, days, late)
    return stream_windows.current_windows(kept(spark, stream_windows.anchored_windows(stream, SUPPLY_SPEC, stride, late="4 days"), folder))


@query("t4_anchored_tiles", "drive:i start:i label:i n:i total:r peak:r",
       f"WITH {SUPPLY_SQL}, {census_sql(30)}, {tiles_sql(SUPPLY_SPEC)} {_READ.format(label=f'max({label_sql(SUPPLY_SPEC, chr(119))})', wins='tiles')}")
def _(spark, d):
    return anchored(spark, d)


@query("t4_anchored_strided", "drive:i start:i label:i n:i total:r peak:r",
       f"""WITH {SUPPLY_SQL}, {census_sql(30)}, wins AS (SELECT drive, first_day, unnest(generate_series(0, n_days - 30, 15)) AS start FROM cal)
       {_READ.format(label=f'max({label_sql(SUPPLY_SPEC, chr(119))})', wins='wins')}""")
def _(spark, d):
    return anchored(spark, d, stride=15)

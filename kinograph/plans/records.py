"""Documents, keys, listings, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.plans.jobs import _J, _jobs
from kinograph.sources.records import MANIFEST, MANIFEST_VERSION, PRESET, PRESET_VERSION, incomplete_parts, parsed, read_parts, read_records, write_parts, write_records
from kinograph.sources.scratch import scratch
from kinograph.sources.tables import frames, table


def preset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets written as JSON and read back; every seventh is damaged or of another version, and null."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    doc = F.to_json(F.struct(F.when(F.col("p_partkey") % 7 == 1, 2).otherwise(PRESET_VERSION).alias("version"), F.array(F.col("s") / 100.0, F.lit(0.5)).alias("box"), F.col("s").cast("int").alias("dilate_px")))
    doc = F.when(F.col("p_partkey") % 7 == 0, F.substring(doc, 1, 20)).otherwise(doc)
    back = p.select("p_partkey", parsed(doc, PRESET, PRESET_VERSION).alias("d"))
    return back.select("p_partkey", F.col("d").isNotNull().alias("readable"), F.col("d.dilate_px").cast("long").alias("dilate"), F.round(F.col("d.box")[0], 4).alias("x"))


def manifest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of orders: what can be resumed is of the same fingerprint, null-safe."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    text = F.to_json(F.struct(F.lit(MANIFEST_VERSION).alias("version"), F.col("o_orderpriority").alias("fingerprint"), F.array(F.col("o_custkey")).alias("cuts"), F.col("o_orderkey").alias("frames")))
    wanted = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("5-LOW"))
    back = o.select("o_orderkey", parsed(text, MANIFEST, MANIFEST_VERSION).alias("d"), wanted.alias("wanted"))
    return back.select("o_orderkey", F.col("d.fingerprint").eqNullSafe(F.col("wanted")).alias("resumes"), F.element_at("d.cuts", 1).alias("cut"))


def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of events as documents; those that cannot be read are left out."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("props"))
    return e.select("event_id", F.from_json("props", "k long").alias("d")).where("d.k IS NOT NULL").select("event_id", "d.k")


def records_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each supplier in a file of its own, read back; files that cannot be read are left out."""
    path, k = scratch(spark, "records"), F.col("s_suppkey")
    doc = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    files = table(spark, sf_dir, "supplier").select(F.coalesce(k.cast("string"), F.lit("none")).alias("name"), F.when(k % 7 != 0, doc).otherwise(F.lit("{broken")).alias("value"))
    write_records(files, path)
    back = read_records(spark, path, "name string, nation long", "file_name")
    return back.select(F.regexp_extract("file_name", r"^(-?\d+)", 1).cast("long").alias("key"), "name", "nation")


def probe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream data with its fallbacks: rate, then average rate; stream, then container duration; frames, then their product."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    k = F.col("p_partkey")
    doc = F.to_json(F.struct(
        F.when(k % 4 == 0, F.lit("0/0")).otherwise(F.concat(F.col("s") * 1000, F.lit("/1001"))).alias("r_frame_rate"),
        F.when(k % 8 == 0, F.lit("0/0")).otherwise(F.lit("30000/1001")).alias("avg_frame_rate"),
        F.when(k % 3 == 0, F.col("s") * 1.5).alias("duration"),
        F.when(k % 5 == 0, F.col("s").cast("string")).alias("nb_frames"),
    ))
    d = F.from_json(doc, "r_frame_rate string, avg_frame_rate string, duration double, nb_frames string")
    rows = p.select(k, F.col("s"), d.alias("d"))
    ratio = lambda c: F.struct(F.split(c, "/")[0].try_cast("long").alias("n"), F.split(c, "/")[1].try_cast("long").alias("d"))
    good = lambda c: F.when((ratio(c)["n"] > 0) & (ratio(c)["d"] > 0), ratio(c))
    rate = F.coalesce(good(F.col("d.r_frame_rate")), good(F.col("d.avg_frame_rate")))
    rows = rows.select("p_partkey", rate.alias("rate"), F.coalesce("d.duration", F.col("s") * 2.0).alias("duration"), F.col("d.nb_frames").try_cast("long").alias("counted"))
    rows = rows.where("rate IS NOT NULL")
    return rows.select("p_partkey", F.col("rate.n").alias("fps_num"), F.col("rate.d").alias("fps_den"), "duration", F.coalesce("counted", F.round(F.col("duration") * F.col("rate.n") / F.col("rate.d")).cast("long")).alias("nframes"))


def parse_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and keys of r2:// and s3:// addresses and of bare keys."""
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("rest"))
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("r2://"), "rest")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("s3://"), "rest")).otherwise(F.col("rest"))
    d = d.select("page_id", uri.alias("uri"))
    has = F.col("uri").rlike("^(r2|s3)://")
    bucket = F.when(has, F.regexp_extract("uri", r"^(?:r2|s3)://([^/]*)", 1))
    key = F.when(has, F.regexp_extract("uri", r"^(?:r2|s3)://[^/]*/?(.*)$", 1)).otherwise(F.col("uri"))
    return d.select("page_id", bucket.alias("bucket"), key.alias("key"))


def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten keys under a prefix, by name."""
    keys = parse_uri(spark, sf_dir).where(F.col("key").startswith("th") | F.col("key").startswith("en"))
    return keys.orderBy("key", "page_id").limit(10).select("page_id", "key")


def newest_open_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, its newest upload that is not closed, and how many are open."""
    opened = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    row = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return opened.groupBy("l_partkey").agg(F.max(row).alias("m"), F.count("*").alias("open_uploads")).select("l_partkey", F.col("m.l_orderkey").alias("upload"), "open_uploads")


def first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's report is the first one that was written."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("written"))
    return first.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("outcome"), "written")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user, the newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    return e.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 3").select("user_id", "n", "event_id", "event_type")


def notification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message for each ended job, without what is secret, cut to 60 characters."""
    j = _jobs(spark, sf_dir).where("state IN ('succeeded', 'interrupted')")
    icon = F.when(F.col("state") == "succeeded", "ok").otherwise("!!")
    text = F.concat_ws(" | ", icon, F.concat(F.lit("job "), F.col("job")), F.col("state"), F.col("outcome"), F.concat(F.col("bytes"), F.lit(" bytes")))
    return j.select("job", F.left(text, F.lit(60)).alias("text"))


def status_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a status answer shows: host part of links only, nothing else of them."""
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.lit(None).cast("string").alias("token"))


def parts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written in parts of 12 and read back: frames, sums and gaps of each part."""
    path = scratch(spark, "parts")
    own = frames(spark, sf_dir)
    write_parts(own, path, 12, 8)
    back = read_parts(spark, path)
    total = (own.agg(F.max("t")).first()[0] or -1) + 1
    bad = incomplete_parts(back, 12, total).select("part", F.lit(True).alias("bad"))
    out = back.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("counted"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.join(bad, "part", "left").select("part", "counted", "first", "last", F.coalesce("bad", F.lit(False)).alias("incomplete"))


def upload_resume_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of interrupted transfers fit if all five fields agree, nulls with nulls."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").cast("long").alias("size"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("etag"))
    kept = o.select("o_orderkey", *[F.col(c).alias(f"k_{c}") for c in ("o_custkey", "o_orderpriority", "size", "o_orderstatus")], F.when(F.col("o_orderkey") % 8 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("k_etag"))
    same = F.lit(True)
    for c in ("o_custkey", "o_orderpriority", "size", "o_orderstatus", "etag"):
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return o.join(kept, "o_orderkey").select("o_orderkey", same.alias("fits"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports: what an engine does not fill stays null rather than zero."""
    j = _jobs(spark, sf_dir)
    coverage = F.when(F.col("job") % 2 == 0, F.struct(F.round(F.col("bytes") / 1000000, 4).alias("fraction"), (F.col("job") % 3 == 0).alias("ok")))
    doc = F.struct(F.col("job"), F.col("outcome"), coverage.alias("coverage"))
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    return j.select("job", F.get_json_object(text, "$.outcome").alias("outcome"), F.get_json_object(text, "$.coverage.ok").alias("ok"), F.get_json_object(text, "$.coverage").isNull().alias("absent"))


QUERIES = {f.__name__: f for f in (preset_documents, manifest_resume, record_scan, records_read, probe_metadata, parse_uri, list_objects, newest_open_upload, first_report, log_tail, notification_text, status_public, parts_round_trip, upload_resume_match, report_json)}

_URI = """u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'r2://' WHEN 1 THEN 's3://' ELSE '' END || regexp_replace(url, '^https?://', '') AS uri FROM pages),
  k AS (SELECT page_id, CASE WHEN page_id % 3 < 2 THEN regexp_extract(uri, '^(?:r2|s3)://([^/]*)', 1) END AS bucket,
    CASE WHEN page_id % 3 < 2 THEN regexp_extract(uri, '^(?:r2|s3)://[^/]*/?(.*)$', 1) ELSE uri END AS key FROM u)"""
ORACLES = {
    "preset_documents": """SELECT p_partkey, p_partkey % 7 > 1 AS readable, CASE WHEN p_partkey % 7 > 1 THEN p_size::BIGINT END AS dilate, CASE WHEN p_partkey % 7 > 1 THEN round(p_size / 100, 4) END AS x FROM part""",
    "manifest_resume": """SELECT o_orderkey, o_orderpriority IS NOT DISTINCT FROM CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '5-LOW' END AS resumes, o_custkey AS cut FROM orders""",
    "record_scan": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 9 <> 0",
    "records_read": "SELECT s_suppkey AS key, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier WHERE s_suppkey % 7 <> 0",
    "probe_metadata": """WITH p AS (SELECT p_partkey, p_size::BIGINT AS s, CASE WHEN p_partkey % 4 <> 0 AND p_size > 0 THEN p_size::BIGINT * 1000 WHEN p_partkey % 8 <> 0 THEN 30000 END AS n FROM part),
      d AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN s * 1.5 ELSE s * 2.0 END::DOUBLE AS duration FROM p WHERE n IS NOT NULL)
      SELECT p_partkey, n AS fps_num, 1001::BIGINT AS fps_den, duration, CASE WHEN p_partkey % 5 = 0 THEN s ELSE round(duration * n / 1001)::BIGINT END AS nframes FROM d""",
    "parse_uri": f"WITH {_URI} SELECT * FROM k",
    "list_objects": f"WITH {_URI} SELECT page_id, key FROM k WHERE starts_with(key, 'th') OR starts_with(key, 'en') ORDER BY key COLLATE C, page_id LIMIT 10",
    "newest_open_upload": "SELECT l_partkey, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS upload, count(*) AS open_uploads FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey",
    "first_report": "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min_by(event_type, (ts, event_id)) AS outcome, count(*) AS written FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "log_tail": "SELECT user_id, n, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n <= 3",
    "notification_text": f"WITH {_J} SELECT job, left(concat_ws(' | ', CASE state WHEN 'succeeded' THEN 'ok' ELSE '!!' END, 'job ' || job, state, outcome, bytes || ' bytes'), 60) AS text FROM j WHERE state IN ('succeeded', 'interrupted')",
    "status_public": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, NULL::VARCHAR AS token FROM pages",
    "parts_round_trip": "SELECT vec_id // 12 AS part, count(*) AS counted, min(vec_id) AS first, max(vec_id) AS last, count(*) <> least(12, (SELECT max(vec_id) + 1 FROM embeddings) - vec_id // 12 * 12) AS incomplete FROM embeddings WHERE len(embedding) = 64 GROUP BY vec_id // 12",
    "upload_resume_match": "SELECT o_orderkey, o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0 OR o_orderstatus IS NULL AS fits FROM orders",
    "report_json": f"WITH {_J} SELECT job, outcome, CASE WHEN job % 2 = 0 THEN CASE WHEN job % 3 = 0 THEN 'true' ELSE 'false' END END AS ok, job % 2 <> 0 AS absent FROM j",
}

"""Box, key and text queries over rows that stand in for boxes and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.functions.geometry import clamp, clock, human_bytes, parse_box, snap
from kinograph.sources.tables import table

FRAME_W, FRAME_H = 320, 180
BOX = {"x": "CAST(p_partkey % 400 - 20 AS BIGINT)", "y": "CAST(p_partkey % 230 - 20 AS BIGINT)", "w": "CAST(p_size * 3 AS BIGINT)", "h": "CAST(p_size AS BIGINT)"}
#: Knobs of a preset (dilate, feather, margin), their least values, and the scale that changes nothing.
KNOBS, LEAST_KNOBS, SAME_SCALE = (5, 12, 64), (1, 1, 8), 0.02
#: Options that take a value, and those that switch something off.
VALUE_FLAGS = {"click": "--crf", "view": "--device", "purchase": "--samples"}
OFF_FLAGS = {"signup": "--no-resume"}


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size IS NOT NULL").selectExpr("p_partkey AS box", *[f"{v} AS {k}" for k, v in BOX.items()])


def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = clamp(*[F.col(c) for c in "xywh"], FRAME_W, FRAME_H)
    return _boxes(spark, sf_dir).select("box", *[v.alias(k) for k, v in inside.items()]).withColumn("area", F.col("w") * F.col("h"))


def tile_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles around boxes with a margin of 16, on multiples of 8."""
    b = box_clamp(spark, sf_dir)
    spans = {}
    for lo, size, limit in (("x", "w", FRAME_W), ("y", "h", FRAME_H)):
        a, z = snap(F.greatest(F.col(lo) - 16, F.lit(0)), F.least(F.col(lo) + F.col(size) + 16, F.lit(limit)), limit)
        spans |= {f"{lo}0": a, f"{lo}1": z}
    return b.select("box", *[v.cast("long").alias(k) for k, v in spans.items()])


def preset_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes normalised by one frame and put into another twice as wide, with half-even rounding; knobs follow the mean scale."""
    b = box_clamp(spark, sf_dir)
    norm = {"x": F.col("x") / FRAME_W, "y": F.col("y") / FRAME_H, "w": F.col("w") / FRAME_W, "h": F.col("h") / FRAME_H}
    to_w, to_h = 640, 270
    out = {k: F.bround(v * (to_w if k in "xw" else to_h)).cast("long") for k, v in norm.items()}
    out = clamp(out["x"], out["y"], F.greatest(out["w"], F.lit(1)), F.greatest(out["h"], F.lit(1)), to_w, to_h)
    scale = (to_w / FRAME_W + to_h / FRAME_H) / 2
    knobs = [k if abs(scale - 1) < SAME_SCALE else max(least, round(k * scale)) for k, least in zip(KNOBS, LEAST_KNOBS, strict=True)]
    return b.select("box", *[v.cast("long").alias(k) for k, v in out.items()], *[F.lit(k).cast("long").alias(n) for n, k in zip(("dilate", "feather", "margin"), knobs, strict=True)])


def corner_search_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search regions in the four corners, 16 pixels at least, for several shares of the frame; whether each holds the box."""
    roi = spark.createDataFrame([(c, f) for c in ("tl", "tr", "bl", "br") for f in (0.03, 0.3, 0.5)], "corner string, share double")
    w, h = F.greatest(F.lit(16), F.floor(FRAME_W * F.col("share"))), F.greatest(F.lit(16), F.floor(FRAME_H * F.col("share")))
    rx = F.when(F.col("corner").isin("tr", "br"), FRAME_W - w).otherwise(0)
    ry = F.when(F.col("corner").isin("bl", "br"), FRAME_H - h).otherwise(0)
    met = box_clamp(spark, sf_dir).crossJoin(F.broadcast(roi.select("corner", "share", rx.alias("rx"), ry.alias("ry"), w.alias("rw"), h.alias("rh"))))
    inside = (F.col("x") >= F.col("rx")) & (F.col("y") >= F.col("ry")) & (F.col("x") + F.col("w") <= F.col("rx") + F.col("rw")) & (F.col("y") + F.col("h") <= F.col("ry") + F.col("rh"))
    return met.groupBy("corner", "share", "rx", "ry", "rw", "rh").agg(F.sum(inside.cast("long")).alias("holds")).select("corner", "share", *[F.col(c).cast("long").alias(c) for c in ("rx", "ry", "rw", "rh")], "holds")


def parse_box_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("box") % 5 == 0, F.concat_ws(" ", "x", "y", "w")).when(F.col("box") % 5 == 1, F.concat_ws(" ", "x", "y", "w", "h")).otherwise(F.concat_ws(",", "x", "y", "w", "h"))
    b = _boxes(spark, sf_dir).select("box", text.alias("text")).withColumn("b", parse_box(F.col("text")))
    return b.select("box", "text", "b.x", "b.y", "b.w", "b.h")


def parse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, stem and default output name of each url."""
    url = table(spark, sf_dir, "pages").select("page_id", F.col("url"))
    host = F.regexp_extract("url", r"^[a-z0-9]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-z0-9]+://[^/?#]*/([^?#]*)", 1)
    stem = F.regexp_extract(path, r"([^/]*)$", 1)
    return url.select("page_id", host.alias("host"), path.alias("path"), F.concat(F.lit("output/"), F.col("page_id").cast("string"), F.lit("/"), stem, F.lit("-clean.mp4")).alias("key"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's settings as JSON with sorted keys and no spaces, and its digest."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    text = F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    return e.select("event_id", text.alias("json"), F.sha2(text.cast("binary"), 256).alias("fingerprint"))


def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings changed between each user's last two events."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = e.withColumn("place", place).where("place <= 2")  # cut down to two a user before the shuffle
    top = last.groupBy("user_id").agg(*[F.max(F.when(F.col("place") == n, F.struct("k", "event_type"))).alias(c) for n, c in ((1, "new"), (2, "old"))])
    new, old = F.col("new"), F.col("old")
    changed = F.array_compact(F.array(F.when(~new["k"].eqNullSafe(old["k"]), F.lit("k")), F.when(~new["event_type"].eqNullSafe(old["event_type"]), F.lit("type"))))
    return top.select("user_id", F.array_join(changed, ",").alias("changed"))


def flag_argv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of each event as arguments: values by name, switches when off, unknown names dropped."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    value = F.element_at(F.create_map(*[F.lit(x) for p in VALUE_FLAGS.items() for x in p]), F.col("event_type"))
    off = F.element_at(F.create_map(*[F.lit(x) for p in OFF_FLAGS.items() for x in p]), F.col("event_type"))
    argv = F.when(value.isNotNull() & F.col("k").isNotNull(), F.concat_ws(" ", value, F.col("k").cast("string"))).when(off.isNotNull() & (F.col("k") % 2 == 0), off).otherwise("")
    return e.select("event_id", argv.alias("argv"))


def size_and_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 6)).cast("long").alias("n"))
    return o.select("o_orderkey", human_bytes(F.col("n")).alias("size"), clock(F.col("n") % 100000).alias("time"))


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path ends in a number below 100 stand for the wanted suffixes; results are left out."""
    keys = parse_keys(spark, sf_dir)
    return keys.where(F.col("path").rlike(r"/\d{1,2}$") & ~F.col("path").contains("-clean")).select("page_id", "path")


def frame_exact_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds half a frame before each start, at 30000/1001 frames a second, and the least time base of 10,000."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5000).alias("start"))
    seconds = F.round(F.greatest((F.col("start") - 0.5) * 1001 / 30000, F.lit(0.0)), 6)
    return o.select("o_orderkey", "start", seconds.alias("seek"))


QUERIES = {f.__name__: f for f in (box_clamp, tile_align, preset_rescale, corner_search_roi, parse_box_strings, parse_keys, canonical_json, fingerprint_diff, flag_argv, size_and_time_text, extension_filter, frame_exact_seek)}

_B = f"bx AS (SELECT p_partkey AS box, {', '.join(f'{v} AS {k}' for k, v in BOX.items())} FROM part WHERE p_size IS NOT NULL)"


def _cl(w: int, h: int, source: str) -> str:
    x, y = f"least(greatest(x, 0), {w - 1})", f"least(greatest(y, 0), {h - 1})"
    return f"SELECT box, {x} AS x, {y} AS y, greatest(1, least(w, {w} - {x})) AS w, greatest(1, least(h, {h} - {y})) AS h FROM {source}"


_C = f"{_B}, cl AS ({_cl(FRAME_W, FRAME_H, 'bx')})"


def _snapped(lo: str, size: str, limit: int) -> str:
    a, z = f"greatest({lo} - 16, 0)", f"least({lo} + {size} + 16, {limit})"
    return f"({a}) - ({a}) % 8 AS {lo}0, greatest(least(({z}) + (8 - ({z}) % 8) % 8, {limit}), {z}) AS {lo}1"


ORACLES = {
    "box_clamp": f"WITH {_C} SELECT *, w * h AS area FROM cl",
    "tile_align": f"WITH {_C} SELECT box, {_snapped('x', 'w', FRAME_W)}, {_snapped('y', 'h', FRAME_H)} FROM cl",
    "preset_rescale": f"""WITH {_C}, n AS (SELECT box, round_even(x / {FRAME_W} * 640, 0)::BIGINT AS x, round_even(y / {FRAME_H} * 270, 0)::BIGINT AS y,
      greatest(round_even(w / {FRAME_W} * 640, 0), 1)::BIGINT AS w, greatest(round_even(h / {FRAME_H} * 270, 0), 1)::BIGINT AS h FROM cl), o AS ({_cl(640, 270, 'n')})
      SELECT *, 9::BIGINT AS dilate, 21::BIGINT AS feather, 112::BIGINT AS margin FROM o""",
    "corner_search_roi": f"""WITH {_C}, r0 AS (SELECT corner, share::DOUBLE AS share, greatest(16, floor({FRAME_W} * share))::BIGINT AS rw, greatest(16, floor({FRAME_H} * share))::BIGINT AS rh
        FROM (VALUES ('tl'), ('tr'), ('bl'), ('br')) c(corner), (VALUES (0.03::DOUBLE), (0.3), (0.5)) f(share)),
      r AS (SELECT *, CASE WHEN corner IN ('tr', 'br') THEN {FRAME_W} - rw ELSE 0 END AS rx, CASE WHEN corner IN ('bl', 'br') THEN {FRAME_H} - rh ELSE 0 END AS ry FROM r0)
      SELECT corner, share, rx, ry, rw, rh, count(*) FILTER (x >= rx AND y >= ry AND x + w <= rx + rw AND y + h <= ry + rh) AS holds FROM r, cl GROUP BY ALL""",
    "parse_box_strings": f"""WITH {_B}, t AS (SELECT box, x, y, w, h, CASE WHEN box % 5 = 0 THEN concat_ws(' ', x, y, w) WHEN box % 5 = 1 THEN concat_ws(' ', x, y, w, h) ELSE concat_ws(',', x, y, w, h) END AS text,
      box % 5 <> 0 AND x >= 0 AND y >= 0 AND w > 0 AND h > 0 AS fine FROM bx)
      SELECT box, text, CASE WHEN fine THEN x END AS x, CASE WHEN fine THEN y END AS y, CASE WHEN fine THEN w END AS w, CASE WHEN fine THEN h END AS h FROM t""",
    "parse_keys": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z0-9]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z0-9]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages)
      SELECT page_id, host, path, 'output/' || page_id || '/' || regexp_extract(path, '([^/]*)$', 1) || '-clean.mp4' AS key FROM p""",
    "canonical_json": """WITH e AS (SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS json FROM events) SELECT event_id, json, sha256(json) AS fingerprint FROM e""",
    "fingerprint_diff": """WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL)
      SELECT a.user_id, concat_ws(',', CASE WHEN a.k IS DISTINCT FROM b.k THEN 'k' END, CASE WHEN a.t IS DISTINCT FROM b.t THEN 'type' END) AS changed FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.n = 2 WHERE a.n = 1""",
    "flag_argv": f"""WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT event_id, CASE
      {' '.join(f"WHEN t = '{a}' AND k IS NOT NULL THEN '{f} ' || k" for a, f in VALUE_FLAGS.items())} {' '.join(f"WHEN t = '{a}' AND k % 2 = 0 THEN '{f}'" for a, f in OFF_FLAGS.items())} ELSE '' END AS argv FROM e""",
    "size_and_time_text": """WITH o AS (SELECT o_orderkey, floor(o_totalprice * pow(10, o_orderkey % 6))::BIGINT AS n FROM orders)
      SELECT o_orderkey, CASE WHEN n >= 1024::BIGINT ** 4 THEN format('{:.1f} TiB', round(n / 1024 ** 4, 1)) WHEN n >= 1024 ** 3 THEN format('{:.1f} GiB', round(n / 1024 ** 3, 1)) WHEN n >= 1024 ** 2 THEN format('{:.1f} MiB', round(n / 1024 ** 2, 1))
        WHEN n >= 1024 THEN format('{:.1f} KiB', round(n / 1024, 1)) ELSE n || ' B' END AS size,
        (n % 100000 // 3600) || ':' || lpad((n % 100000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((n % 100000 % 60)::VARCHAR, 2, '0') AS time FROM o""",
    "extension_filter": r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z0-9]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages) SELECT * FROM p WHERE regexp_matches(path, '/\d{1,2}$') AND NOT contains(path, '-clean')",
    "frame_exact_seek": "SELECT o_orderkey, o_orderkey % 5000 AS start, round(greatest((o_orderkey % 5000 - 0.5::DOUBLE) * 1001 / 30000, 0), 6) AS seek FROM orders",
}

"""Shot and segment queries over each user's events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.operators.shots import islands, segments, shot_starts, thinned
from kinograph.sources.tables import table

CUT, BLACK = "purchase", "view"
LEAST, SEGMENT, OVERLAP, LEAST_BLACK, STAMPS = 4, 9, 2, 2, 40
ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return _events(spark, sf_dir).withColumn("i", F.row_number().over(w).cast("long") - 1)


def sample_grid_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of 40 even stamps over the span, the first event at or after it; one pass, combined before the shuffle."""
    events = _events(spark, sf_dir).select("event_id", "us")
    low, high = events.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return spark.createDataFrame([], "stamp long, begins long, event_id long")
    stamps = [low + int((high - low) * (0.04 + 0.92 * k / (STAMPS - 1))) for k in range(STAMPS)]
    grid = F.array(*[F.struct(F.lit(k).cast("long").alias("stamp"), F.lit(s).alias("begins"), F.col(f"m{k}").alias("m")) for k, s in enumerate(stamps)])
    firsts = events.agg(*[F.min(F.when(F.col("us") >= s, F.struct("us", "event_id"))).alias(f"m{k}") for k, s in enumerate(stamps)])
    return firsts.select(F.explode(grid).alias("g")).where("g.m IS NOT NULL").select("g.stamp", "g.begins", "g.m.event_id")


def shot_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's shots: number, first event and length."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    shots = _numbered(spark, sf_dir).withColumn("shot", F.sum((F.col("event_type") == CUT).cast("long")).over(w))
    return shots.groupBy("user_id", "shot").agg(F.min("i").alias("first"), F.count("*").alias("length"))


def black_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of black frames that last long enough."""
    runs = islands(_events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == BLACK)
    return runs.where(F.col("length") >= LEAST_BLACK)


def boundary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and ends of black runs of each user, each once."""
    cuts = _numbered(spark, sf_dir).where(F.col("event_type") == CUT).select("user_id", F.col("i").alias("bound"))
    return cuts.union(black_runs(spark, sf_dir).select("user_id", F.col("until").alias("bound"))).distinct()


def shot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and ends of black runs of each user, by one table function over the events in order."""
    marks = _events(spark, sf_dir).select("user_id", *ORDER, F.coalesce(F.col("event_type") == CUT, F.lit(False)).alias("cut"), F.coalesce(F.col("event_type") == BLACK, F.lit(False)).alias("black"))
    return shot_starts(marks, "user_id", ORDER)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, total, s, e, left, right), written once for what reads it."""
    numbered = _numbered(spark, sf_dir)
    totals = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"))
    starts = totals.select("user_id", F.lit(0).cast("long").alias("i"))
    bounds = thinned(numbered.where(F.col("event_type") == CUT).select("user_id", "i").union(starts), "user_id", "i", LEAST)
    return segments(bounds, totals, "user_id", LEAST, SEGMENT, OVERLAP)


def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("user_id", "s", "e", "left", "right")


def segment_context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each segment holds with its context: an equi join, because the plan is unfolded to frames."""
    unfolded = _planned(spark, sf_dir).select("user_id", "s", "e", F.explode(F.sequence(F.col("s") - F.col("left"), F.col("e") + F.col("right") - 1)).alias("i"))
    met = unfolded.join(_numbered(spark, sf_dir).select("user_id", "i", "value"), ["user_id", "i"])
    body = (F.col("i") >= F.col("s")) & (F.col("i") < F.col("e"))
    return met.groupBy("user_id", "s").agg(F.count("*").alias("frames"), F.sum(body.cast("long")).alias("body"), F.round(F.sum(F.when(body, F.col("value"))), 4).alias("body_value"))


def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest silence in seconds, and how many were over six hours."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    gaps = _events(spark, sf_dir).select("user_id", ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("gap")).where("gap IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("longest"), F.sum((F.col("gap") > 21600).cast("long")).alias("stalls"))


def stall_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end with twelve silent hours."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    marked = _events(spark, sf_dir).select("user_id", *ORDER, "us", F.coalesce(((F.col("us") - F.lag("us").over(w)) > 43200 * 1_000_000).cast("long"), F.lit(1).cast("long")).alias("new"))
    numbered = marked.withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count("*").alias("n"))


def scene_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of frames and their scores: a score belongs to the frame line before it."""
    rows = _numbered(spark, sf_dir).select("user_id", "i", "us", F.explode(F.array(F.concat(F.lit("frame: pts_time:"), F.col("i")), F.concat(F.lit("lavfi.scene_score="), F.format_string("%.2f", F.col("value"))))).alias("line"), "event_id")
    rows = rows.withColumn("n", F.when(F.col("line").startswith("frame"), 0).otherwise(1))
    w = Window.partitionBy("user_id").orderBy("i", "n")
    pts = F.regexp_extract("line", r"pts_time:(\d+)", 1)
    carried = F.last(F.when(pts != "", pts.cast("long")), ignorenulls=True).over(w)
    score = F.regexp_extract("line", r"scene_score=([-0-9.]+)", 1)
    return rows.select("user_id", carried.alias("frame"), score.alias("score")).where("score <> ''").select("user_id", "frame", F.col("score").cast("double").alias("score"))


QUERIES = {f.__name__: f for f in (sample_grid_asof, shot_islands, black_runs, boundary_union, shot_bounds, segment_plan, segment_context_blocks, heartbeat_gaps, stall_sessions, scene_log_parse)}

_EV = "ev AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_RUNS = f"""{_EV}, bl AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM ev WHERE event_type = '{BLACK}'),
  runs AS (SELECT user_id, min(i) AS first, max(i) + 1 AS until, count(*) AS length FROM bl GROUP BY user_id, run HAVING count(*) >= {LEAST_BLACK})"""
_PLAN = f"""{_EV}, tot AS (SELECT user_id, count(*) AS total FROM ev GROUP BY user_id), cuts AS (SELECT user_id, i AS c FROM ev WHERE event_type = '{CUT}'),
  acc AS (SELECT user_id, 0::BIGINT AS last FROM tot UNION ALL
    SELECT a.user_id, (SELECT min(c) FROM cuts JOIN tot USING (user_id) WHERE cuts.user_id = a.user_id AND c - a.last >= {LEAST} AND c < total) FROM acc a WHERE a.last IS NOT NULL),
  bd AS (SELECT user_id, total, list_sort(list(last) FILTER (last IS NOT NULL)) AS b FROM acc JOIN tot USING (user_id) GROUP BY ALL),
  fin AS (SELECT user_id, CASE WHEN b[-1] = total THEN b WHEN total - b[-1] < {LEAST} AND len(b) > 1 THEN list_append(b[:-2], total) ELSE list_append(b, total) END AS b FROM bd),
  sh AS (SELECT user_id, unnest(b[:-2]) AS a, unnest(b[2:]) AS z FROM fin),
  sg AS (SELECT user_id, a, z, a + k * {SEGMENT} AS s, least(a + (k + 1) * {SEGMENT}, z) AS e FROM sh, range(0, 100000) r(k) WHERE a + k * {SEGMENT} < z),
  pl AS (SELECT user_id, s, e, least({OVERLAP}, s - a)::BIGINT AS "left", least({OVERLAP}, z - e)::BIGINT AS "right" FROM sg)"""
ORACLES = {
    "sample_grid_asof": f"""WITH {_EV}, sp AS (SELECT min(us) AS low, max(us) AS high FROM ev), st AS (SELECT k AS stamp, low + trunc((high - low) * (0.04::DOUBLE + 0.92::DOUBLE * k / {STAMPS - 1}))::BIGINT AS begins FROM sp, range({STAMPS}) r(k))
      SELECT stamp, begins, (SELECT min_by(event_id, (us, event_id)) FROM ev WHERE us >= begins) AS event_id FROM st""",
    "shot_islands": f"""WITH {_EV}, s AS (SELECT *, sum(CASE WHEN event_type = '{CUT}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS shot FROM ev)
      SELECT user_id, shot::BIGINT AS shot, min(i) AS first, count(*) AS length FROM s GROUP BY ALL""",
    "black_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "boundary_union": f"WITH {_RUNS} SELECT user_id, i AS bound FROM ev WHERE event_type = '{CUT}' UNION SELECT user_id, until FROM runs",
    "shot_bounds": f"WITH {_RUNS} SELECT user_id, i AS bound FROM ev WHERE event_type = '{CUT}' UNION SELECT user_id, until FROM runs",
    "segment_plan": f'WITH RECURSIVE {_PLAN} SELECT user_id, s, e, "left", "right" FROM pl',
    "segment_context_blocks": f"""WITH RECURSIVE {_PLAN} SELECT pl.user_id, s, count(*) AS frames, count(*) FILTER (i >= s AND i < e) AS body, round(sum(value) FILTER (i >= s AND i < e), 4) AS body_value
      FROM pl JOIN ev ON ev.user_id = pl.user_id AND i >= s - "left" AND i < e + "right" GROUP BY pl.user_id, s""",
    "heartbeat_gaps": f"""WITH {_EV}, g AS (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY i)) / 1e6 AS gap FROM ev)
      SELECT user_id, round(max(gap), 3) AS longest, count(*) FILTER (gap > 21600) AS stalls FROM g WHERE gap IS NOT NULL GROUP BY user_id""",
    "stall_sessions": f"""WITH {_EV}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY i) > 43200000000, true)::INT AS new FROM ev),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, session::BIGINT AS session, min(us) AS from_us, max(us) AS to_us, count(*) AS n FROM s GROUP BY ALL""",
    "scene_log_parse": f"WITH {_EV} SELECT user_id, i AS frame, round(value, 2) AS score FROM ev WHERE value IS NOT NULL",
}

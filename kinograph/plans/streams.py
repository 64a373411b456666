"""Streaming and stateful queries, with batch twins as oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.operators.repair import repair
from kinograph.plans.oracle import PX
from kinograph.sources.tables import frames, pixels, table
from kinograph.streaming.machines import STEPS, job_states, patch_cache
from kinograph.streaming.processors import context_blocks, silences
from kinograph.streaming.runs import drain, event_stream

HOLD, TOLERANCE = 2, 0.142
SEGMENT, OVERLAP = 8, 3
#: Milliseconds of silence until a heartbeat is due, a job counts as interrupted, and what is kept of it goes.
AFTER_MS = {"silent": 6 * 3_600_000, "interrupted": 24 * 3_600_000, "removed": 48 * 3_600_000}
BOX = "x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5"


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and day, with a watermark of a day."""
    day = F.window("ts", "1 day")
    counted = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"))
    out = counted.select(F.unix_seconds(F.col("window.start")).alias("day"), "event_type", "n", "value")
    return drain(out, "daily", "complete")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end with half a day of silence."""
    session = F.session_window("ts", "12 hours")
    counted = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(session, "user_id").agg(F.count("*").alias("n"))
    out = counted.select("user_id", F.unix_micros(F.col("session_window.start")).alias("from_us"), (F.unix_micros(F.col("session_window.end")) - 43200 * 1_000_000).alias("to_us"), "n")
    return drain(out, "sessions", "complete")


def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's place in the job machine after the whole stream."""
    out = drain(job_states(event_stream(spark, sf_dir)), "jobs", "update")
    return out.groupBy("user_id").agg(F.max_by("rank", "moves").alias("rank"), F.max("moves").alias("moves"))


def stream_first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen on each day, each once."""
    days = event_stream(spark, sf_dir).select("user_id", F.date_trunc("day", "ts").alias("day")).withWatermark("day", "2 days").dropDuplicatesWithinWatermark(["user_id", "day"])
    return drain(days.select("user_id", F.unix_seconds("day").alias("day")), "first", "append")


def cached_patch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_cache(frames(spark, sf_dir), TOLERANCE, HOLD)


def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cached_patch_fold(spark, sf_dir).groupBy("clip")
    return hits.agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("ratio"), F.count("*").alias("frames"))


def stream_context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in blocks with context on both sides, as far as the look-ahead has come; the state is a list of the last few."""
    out = drain(context_blocks(event_stream(spark, sf_dir), SEGMENT, OVERLAP), "context", "append")
    return out.withColumn("body_value", F.round("body_value", 4))


def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's silence made a heartbeat due, an interruption, and the end of what was kept of it, by timers."""
    return drain(silences(event_stream(spark, sf_dir).withWatermark("ts", "1 day"), AFTER_MS), "silences", "append")


def stream_first_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup with the user's first purchase within two days, or none: two streams, whose state is bounded by the interval.

    Signups so late that the watermark has not closed their interval are not told of.
    """
    rows = lambda kind: event_stream(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", "ts").withWatermark("ts", "1 day")
    left = rows("signup").select("user_id", "event_id", F.col("ts").alias("signed"))
    right = rows("purchase").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    within = (F.col("user_id") == F.col("buyer")) & (F.col("bought") >= F.col("signed")) & (F.col("bought") <= F.col("signed") + F.expr("INTERVAL 2 DAYS"))
    met = drain(left.join(right, within, "leftOuter").select("user_id", "event_id", "signed", "bought", "purchase_id"), "purchases", "append")
    first = met.groupBy("user_id", "event_id", "signed").agg(F.min(F.when(F.col("purchase_id").isNotNull(), F.struct("bought", "purchase_id"))).alias("p"))
    ends = [table(spark, sf_dir, "events").where((F.col("event_type") == kind) & F.col("user_id").isNotNull()).agg(F.max(F.col("ts").cast("timestamp")).alias(kind)) for kind in ("signup", "purchase")]
    closed = ends[0].crossJoin(F.broadcast(ends[1])).select((F.least("signup", "purchase") - F.expr("INTERVAL 74 HOURS")).alias("closed"))  # one row
    told = first.crossJoin(F.broadcast(closed)).where(F.col("signed") < F.col("closed"))
    return told.select("user_id", "event_id", F.col("p.purchase_id").alias("purchase_id"), F.unix_micros("p.bought").alias("bought_us"))


def repair_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a box filled from its surroundings."""
    mask = np.zeros((8, 8), bool)
    mask[2:6, 2:6] = True
    return pixels(repair(frames(spark, sf_dir), mask), "px").select("t", "y", "x", F.round("px", 6).alias("v"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_sessions, stream_job_state, stream_first_of_day, cached_patch_fold, cache_hit_ratio, stream_context_blocks, stream_silences, stream_first_purchase, repair_stub)}

_EV = "ev AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_DUE = "CASE r.rank " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STEPS)) + " END"
_FOLD = f"""fr AS (SELECT label::BIGINT AS clip, vec_id AS t, embedding::DOUBLE[] AS px, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings WHERE len(embedding) = 64),
  fo AS (SELECT clip, t, i, px AS anchor, false AS hit, 1::BIGINT AS age FROM fr WHERE i = 1
    UNION ALL SELECT f.clip, f.t, f.i, CASE WHEN h THEN o.anchor ELSE f.px END, h, CASE WHEN h THEN o.age + 1 ELSE 1 END
    FROM (SELECT f.*, o.anchor AS oa, o.age AS og, o.age < {HOLD} OR list_sum(list_transform(list_zip(f.px, o.anchor), lambda z: abs(z[1] - z[2]))) / 64 <= {TOLERANCE} AS h FROM fo o JOIN fr f ON f.clip = o.clip AND f.i = o.i + 1) f
    JOIN fo o ON o.clip = f.clip AND o.i = f.i - 1)"""
_FOLD = _FOLD.replace("CASE WHEN h THEN o.anchor ELSE f.px END, h, CASE WHEN h THEN o.age + 1 ELSE 1 END\n", "CASE WHEN h THEN oa ELSE f.px END, h, CASE WHEN h THEN og + 1 ELSE 1 END\n").replace("\n    JOIN fo o ON o.clip = f.clip AND o.i = f.i - 1)", ")")
ORACLES = {
    "stream_daily_counts": "SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
    "stream_sessions": f"""WITH {_EV}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY i) >= 43200000000, true)::INT AS new FROM ev),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(us) AS from_us, max(us) AS to_us, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_job_state": f"""WITH RECURSIVE {_EV}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS rank, 0::BIGINT AS i, 0::BIGINT AS moves FROM ev
      UNION ALL SELECT user_id, CASE WHEN (t).e = 'error' THEN 9 ELSE rank + 1 END, (t).i, moves + 1
      FROM (SELECT r.*, (SELECT min({{'i': i, 'e': event_type}}) FROM ev WHERE ev.user_id = r.user_id AND ev.i > r.i AND (event_type = {_DUE} OR (event_type = 'error' AND r.rank > 0))) AS t FROM r WHERE rank < {len(STEPS)}) WHERE t IS NOT NULL)
      SELECT user_id, max_by(rank, moves) AS rank, max(moves) AS moves FROM r GROUP BY user_id""",
    "stream_first_of_day": "SELECT DISTINCT user_id, epoch(date_trunc('day', ts))::BIGINT AS day FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL",
    "cached_patch_fold": f"WITH RECURSIVE {_FOLD} SELECT clip, t, hit, age FROM fo",
    "cache_hit_ratio": f"WITH RECURSIVE {_FOLD} SELECT clip, round(avg(hit::INT), 6) AS ratio, count(*) AS frames FROM fo GROUP BY clip",
    "stream_context_blocks": f"""WITH {_EV}, n AS (SELECT user_id, count(*) AS total FROM ev GROUP BY user_id),
      b AS (SELECT user_id, unnest(range(0, total - {SEGMENT + OVERLAP} + 1, {SEGMENT})) AS s FROM n)
      SELECT b.user_id, s, count(*) AS frames, count(*) FILTER (i - 1 >= s AND i - 1 < s + {SEGMENT}) AS body, round(coalesce(sum(value) FILTER (i - 1 >= s AND i - 1 < s + {SEGMENT}), 0), 4) AS body_value
      FROM b JOIN ev ON ev.user_id = b.user_id AND i - 1 >= s - {OVERLAP} AND i - 1 < s + {SEGMENT + OVERLAP} GROUP BY b.user_id, s""",
    "stream_silences": f"""WITH {_EV}, g AS (SELECT user_id, us // 1000 AS ms, lead(us) OVER (PARTITION BY user_id ORDER BY i) // 1000 AS after, max(us) OVER () // 1000 - 86400000 AS mark FROM ev),
      k AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::BIGINT)" for k, v in AFTER_MS.items())}) v(kind, due))
      SELECT user_id, kind, ms + due AS at_ms FROM g, k WHERE after - ms > due OR (after IS NULL AND ms + due <= mark)""",
    "stream_first_purchase": f"""WITH {_EV}, c AS (SELECT least(max(ts) FILTER (event_type = 'signup'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 74 HOURS AS closed FROM ev),
      s AS (SELECT user_id, event_id, ts FROM ev, c WHERE event_type = 'signup' AND ts < closed),
      p AS (SELECT s.event_id, min_by(ev.event_id, (ev.us, ev.event_id)) AS purchase_id, min(us) AS bought_us FROM s JOIN ev ON ev.user_id = s.user_id AND event_type = 'purchase' AND ev.ts BETWEEN s.ts AND s.ts + INTERVAL 2 DAYS GROUP BY s.event_id)
      SELECT user_id, event_id, purchase_id, bought_us FROM s LEFT JOIN p USING (event_id)""",
    "repair_stub": f"WITH {PX}, m AS (SELECT t, avg(v) FILTER (NOT ({BOX})) AS m FROM px GROUP BY t) SELECT t, y, x, round(CASE WHEN {BOX} THEN m ELSE v END, 6) AS v FROM px JOIN m USING (t)",
}

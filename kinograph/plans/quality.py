"""Verification, flicker and artifact queries: a clip's next frame plays the processed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.operators.quality import INSIDE_DB, OUTLIER, OUTSIDE_DB, mean_abs_difference, psnr, robust_z, with_previous
from kinograph.plans.oracle import PX
from kinograph.sources.tables import frames, pixels, table

INSIDE, NEAR, FAR = "x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4", "x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5", "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"
PEAK = 1.0


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, px, qx): each frame with the next one of its clip; a clip's last frame has none and is left out."""
    later = F.lead("px").over(Window.partitionBy("clip").orderBy("t"))
    return frames(spark, sf_dir).withColumn("qx", later).where("qx IS NOT NULL").select("clip", "t", "px", "qx")


def _zone_psnr(pairs: DataFrame) -> DataFrame:
    error = pixels(pairs.select("clip", "t", "px", "qx"), "px", "qx").withColumn("e", F.pow(F.col("px") - F.col("qx"), F.lit(2)))
    zones = {"inside": INSIDE, "outside": f"NOT ({NEAR})", "near": f"NOT ({NEAR}) AND {FAR}", "far": f"NOT ({FAR})"}
    mse = error.groupBy("clip", "t").agg(*[F.avg(F.when(F.expr(c), F.col("e"))).alias(z) for z, c in zones.items()])
    return mse.select("clip", "t", *[F.round(psnr(F.col(z), PEAK), 5).alias(f"psnr_{z}") for z in zones])


def psnr_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR of each pair of frames inside the box, outside it, near it and far from it."""
    return _zone_psnr(_pairs(spark, sf_dir))


def verify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of nine samples of each clip against the limits (lowered by 30 dB for these pixels); only samples are scored."""
    shot = Window.partitionBy("clip").orderBy("t")
    ordered = _pairs(spark, sf_dir).withColumns({"i": F.row_number().over(shot) - 1, "n": F.count("*").over(Window.partitionBy("clip"))})
    step = F.greatest(F.floor(F.col("n") / 9), F.lit(1))
    sampled = ordered.where((F.col("i") % step == 0) & (F.col("i") < 9 * step))
    med = _zone_psnr(sampled).groupBy("clip").agg(F.count("*").alias("samples"), F.expr("percentile(psnr_outside, 0.5)").alias("outside"), F.expr("percentile(psnr_inside, 0.5)").alias("inside"))
    outside_ok, inside_ok = F.col("outside") >= OUTSIDE_DB - 30, F.col("inside") <= INSIDE_DB - 30
    return med.select("clip", "samples", F.round("outside", 4).alias("outside"), F.round("inside", 4).alias("inside"), outside_ok.alias("outside_ok"), inside_ok.alias("inside_ok"), (outside_ok & inside_ok).alias("ok"))


def fill_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the next frame differs (fill), and how much a frame differs from the one before (jump, first 0)."""
    both = with_previous(_pairs(spark, sf_dir), "clip")
    jump = F.coalesce(mean_abs_difference(F.col("px"), F.col("before")), F.lit(0.0))
    return both.select("clip", "t", F.round(mean_abs_difference(F.col("px"), F.col("qx")), 6).alias("fill"), F.round(jump, 6).alias("jump"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = with_previous(_pairs(spark, sf_dir).withColumn("px", F.arrays_zip("px", "qx")), "clip").where("before IS NOT NULL")
    delta = lambda f: F.zip_with("px", "before", lambda a, b: a[f] - b[f])
    return both.select("clip", "t", delta("px").alias("a"), delta("qx").alias("b"))


def temporal_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, over a clip, of how pixels of frame and next frame change; 0 where either hardly does."""
    change = pixels(_changes(spark, sf_dir), "a", "b")
    stats = change.groupBy("clip").agg(F.corr("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    flat = (F.col("sa") < 1e-6) | (F.col("sb") < 1e-6)
    return stats.select("clip", F.round(F.when(flat, 0.0).otherwise(F.col("c")), 6).alias("corr"))


def flicker_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of the next frames beyond that of the frames, in levels of 255, in classes."""
    change = pixels(_changes(spark, sf_dir), "a", "b").groupBy("clip").agg(((F.avg(F.abs(F.col("b"))) - F.avg(F.abs(F.col("a")))) * 255).alias("excess"))
    size = F.abs("excess")
    kind = F.when(size < 0.5, "none").when(size < 1.5, "slight").when(size < 3.0, "visible").otherwise("strong")
    return change.select("clip", F.round("excess", 5).alias("excess"), kind.alias("verdict"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL")


def robust_z_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty events farthest from their type's median, and how many are beyond the limit."""
    z = robust_z(_events(spark, sf_dir).select("event_id", "event_type", "value"), "value", "event_type").withColumn("z", F.round("z", 6))
    many = z.agg(F.sum((F.abs("z") > OUTLIER).cast("long")).alias("flagged"))
    return z.orderBy(F.desc(F.abs("z")), "event_id").limit(20).crossJoin(F.broadcast(many)).select("event_id", "event_type", "value", "z", "flagged")


def artifact_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, whether outlying events come near segment bounds (every 10th), in short shots, or at shot starts."""
    z = robust_z(_events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value"), "value", "user_id")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = z.withColumn("i", F.row_number().over(by_user) - 1).withColumn("shot", F.sum((F.col("event_type") == "purchase").cast("int")).over(by_user))
    shot = Window.partitionBy("user_id", "shot")
    numbered = numbered.withColumns({"length": F.count("*").over(shot), "start": F.min("i").over(shot)})
    flagged = numbered.where(F.abs("z") > 1.5)
    near = F.least(F.col("i") % 10, 10 - F.col("i") % 10) <= 2
    counts = flagged.groupBy("user_id").agg(F.count("*").alias("flagged"), F.sum(near.cast("long")).alias("near_bound"), F.sum((F.col("length") <= 3).cast("long")).alias("in_short"), F.sum((F.col("i") - F.col("start") <= 5).cast("long")).alias("at_start"))
    half = F.col("flagged") / 2
    verdict = F.when(F.col("near_bound") >= half, "boundary").when(F.col("in_short") >= half, "short shot").when(F.col("at_start") > 0, "shot start").otherwise("none")
    return counts.withColumn("verdict", verdict)


def blank_frame_glow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are blank outside the box but glow in it (levels scaled to these pixels)."""
    level = pixels(frames(spark, sf_dir), "px").select("t", F.expr("least(greatest((px + 1) * 127.5, 0), 255)").alias("c"), F.expr(INSIDE).alias("in"))
    out = level.groupBy("t").agg(F.expr("percentile(CASE WHEN NOT in THEN c END, 0.99)").alias("p99"), (F.max(F.when(F.col("in"), F.col("c"))) - F.max(F.when(~F.col("in"), F.col("c")))).alias("glow"))
    return out.select("t", F.round("p99", 5).alias("p99"), F.round("glow", 5).alias("glow"), ((F.col("p99") <= 165) & (F.col("glow") > 4)).alias("glows"))


QUERIES = {f.__name__: f for f in (psnr_zones, verify_checks, fill_jump, temporal_corr, flicker_verdict, robust_z_outliers, artifact_verdict, blank_frame_glow)}


def _db(mse: str) -> str:
    return f"CASE WHEN coalesce({mse}, 0) <= 1e-9 THEN 'inf'::DOUBLE ELSE 10 * log10({PEAK * PEAK} / {mse}) END"


_PAIR = f"""{PX}, pr AS (SELECT clip, t, y, x, v AS p, q FROM (SELECT *, lead(v) OVER (PARTITION BY clip, y, x ORDER BY t) AS q FROM px) WHERE q IS NOT NULL)"""
_ZONES = f"""{_PAIR}, ms AS (SELECT clip, t, avg((p - q) ** 2) FILTER ({INSIDE}) AS i, avg((p - q) ** 2) FILTER (NOT ({NEAR})) AS o,
  avg((p - q) ** 2) FILTER (NOT ({NEAR}) AND {FAR}) AS n, avg((p - q) ** 2) FILTER (NOT ({FAR})) AS f FROM pr GROUP BY clip, t),
  zn AS (SELECT clip, t, round({_db('i')}, 5) AS psnr_inside, round({_db('o')}, 5) AS psnr_outside, round({_db('n')}, 5) AS psnr_near, round({_db('f')}, 5) AS psnr_far FROM ms)"""
_CHANGE = f"""{_PAIR}, ch AS (SELECT * FROM (SELECT clip, t, p - lag(p) OVER w AS a, q - lag(q) OVER w AS b FROM pr WINDOW w AS (PARTITION BY clip, y, x ORDER BY t)) WHERE a IS NOT NULL)"""
_EV = "ev AS (SELECT * FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL)"


def _z(key: str) -> str:
    return f"""{_EV}, md AS (SELECT {key}, median(value) AS med FROM ev GROUP BY ALL), mm AS (SELECT {key}, any_value(med) AS med, median(abs(value - med)) AS mad FROM ev JOIN md USING ({key}) GROUP BY {key}),
      z AS (SELECT ev.*, CASE WHEN mad <= 1e-9 THEN 0 ELSE (value - med) / (1.4826 * mad) END AS z FROM ev JOIN mm USING ({key}))"""


ORACLES = {
    "psnr_zones": f"WITH {_ZONES} SELECT * FROM zn",
    "verify_checks": f"""WITH {_ZONES}, f AS (SELECT DISTINCT clip, t FROM pr), o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM f),
      s AS (SELECT clip, t FROM o WHERE i % greatest(n // 9, 1) = 0 AND i < 9 * greatest(n // 9, 1)),
      m AS (SELECT clip, count(*) AS samples, median(psnr_outside) AS o, median(psnr_inside) AS i FROM s JOIN zn USING (clip, t) GROUP BY clip)
      SELECT clip, samples, round(o, 4) AS outside, round(i, 4) AS inside, o >= 8 AS outside_ok, i <= 10 AS inside_ok, o >= 8 AND i <= 10 AS ok FROM m""",
    "fill_jump": f"""WITH {_PAIR}, d AS (SELECT clip, t, abs(p - q) AS fill, coalesce(abs(p - lag(p) OVER (PARTITION BY clip, y, x ORDER BY t)), 0) AS jump FROM pr)
      SELECT clip, t, round(avg(fill), 6) AS fill, round(avg(jump), 6) AS jump FROM d GROUP BY clip, t""",
    "temporal_corr": f"WITH {_CHANGE} SELECT clip, round(CASE WHEN stddev_pop(a) < 1e-6 OR stddev_pop(b) < 1e-6 THEN 0 ELSE corr(a, b) END, 6) AS corr FROM ch GROUP BY clip",
    "flicker_verdict": f"""WITH {_CHANGE}, e AS (SELECT clip, (avg(abs(b)) - avg(abs(a))) * 255 AS e FROM ch GROUP BY clip)
      SELECT clip, round(e, 5) AS excess, CASE WHEN abs(e) < 0.5 THEN 'none' WHEN abs(e) < 1.5 THEN 'slight' WHEN abs(e) < 3 THEN 'visible' ELSE 'strong' END AS verdict FROM e""",
    "robust_z_outliers": f"WITH {_z('event_type')} SELECT event_id, event_type, value, round(z, 6) AS z, (SELECT count(*) FROM z WHERE abs(round(z, 6)) > 6) AS flagged FROM z ORDER BY abs(round(z, 6)) DESC, event_id LIMIT 20",
    "artifact_verdict": f"""WITH {_z('user_id')}, n AS (SELECT *, row_number() OVER w - 1 AS i, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shot FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, count(*) OVER (PARTITION BY user_id, shot) AS length, min(i) OVER (PARTITION BY user_id, shot) AS start FROM n),
      c AS (SELECT user_id, count(*) AS flagged, count(*) FILTER (least(i % 10, 10 - i % 10) <= 2) AS near_bound, count(*) FILTER (length <= 3) AS in_short, count(*) FILTER (i - start <= 5) AS at_start FROM s WHERE abs(z) > 1.5 GROUP BY user_id)
      SELECT *, CASE WHEN near_bound >= flagged / 2 THEN 'boundary' WHEN in_short >= flagged / 2 THEN 'short shot' WHEN at_start > 0 THEN 'shot start' ELSE 'none' END AS verdict FROM c""",
    "blank_frame_glow": f"""WITH {PX}, l AS (SELECT t, y, x, least(greatest((v + 1) * 127.5, 0), 255) AS c FROM px),
      g AS (SELECT t, quantile_cont(c, 0.99) FILTER (NOT ({INSIDE})) AS p99, max(c) FILTER ({INSIDE}) - max(c) FILTER (NOT ({INSIDE})) AS glow FROM l GROUP BY t)
      SELECT t, round(p99, 5) AS p99, round(glow, 5) AS glow, p99 <= 165 AND glow > 4 AS glows FROM g""",
}

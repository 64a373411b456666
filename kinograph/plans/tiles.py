"""Stencils over tiles, alpha fits and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.frames import BLUR, SIDE, SOBEL_X, SOBEL_Y, convolve, neighbourhood, positions
from kinograph.operators.alpha import LEAST_THROUGH, MIN_CONTRAST, SOLID, matte_alpha, recovered, scaled_means, variance_alpha
from kinograph.operators.alpha import alpha_bound as bounded
from kinograph.plans.oracle import PX, WHOLE, mirrored
from kinograph.sources.scratch import written
from kinograph.sources.tables import frames, pixels

#: The mark's box in the queries, and levels: pixels are mapped to 0..255.
BOX = "x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5"
LOW, HIGH = 2, 5
INK = 255.0
#: Channels blue, green and red: where in the tile each begins, and (fixed values) their weights in gray.
CHANNELS, TURNS, GRAY = ("c0", "c1", "c2"), (0, 21, 42), (0.114, 0.587, 0.299)
LEVEL = "least(greatest((v + 1) * 127.5, 0), 255)"


def _tile(spark: SparkSession, sf_dir: str, column, name: str) -> DataFrame:
    return pixels(frames(spark, sf_dir).select("t", column.alias(name)), name).select("t", "y", "x", F.round(name, 6).alias(name))


def gaussian_blur_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile(spark, sf_dir, convolve(F.col("px"), BLUR), "blur")


def dilate_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile(spark, sf_dir, neighbourhood(F.col("px"), F.greatest), "dilated")


def close_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames(spark, sf_dir).select("t", neighbourhood(F.col("px"), F.greatest).alias("wide"))
    return pixels(wide.select("t", neighbourhood(F.col("wide"), F.least).alias("closed")), "closed").select("t", "y", "x", F.round("closed", 6).alias("closed"))


def sobel_locked_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strength, inside the box, of the Sobel gradients averaged over time."""
    graded = frames(spark, sf_dir).select("clip", "t", convolve(F.col("px"), SOBEL_X).alias("sx"), convolve(F.col("px"), SOBEL_Y).alias("sy"))
    stats = pixels(graded, "sx", "sy").groupBy("clip", "y", "x").agg(F.abs(F.avg("sx")).alias("ex"), F.abs(F.avg("sy")).alias("ey"))
    return stats.groupBy("clip").agg(F.round(F.avg(F.when(F.expr(BOX), F.col("ex") + F.col("ey"))), 6).alias("energy"))


def _colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, c0, c1, c2): frames in three channels of levels; a channel is the tile read from another pixel on."""
    turned = lambda by: F.transform(positions(), lambda p: F.least(F.greatest((F.col("px")[(p + by) % 64] + 1) * 127.5, F.lit(0.0)), F.lit(255.0)))
    return frames(spark, sf_dir).select("clip", "t", *[turned(by).alias(f"c{k}") for k, by in enumerate(TURNS)])


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel of a frame: its levels c0, c1 and c2."""
    return pixels(_colour_frames(spark, sf_dir), *CHANNELS)


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pixel of a clip and channel: mean, deviation and least value, and mean and deviation of what surrounds the box."""
    each = [f(c).alias(f"{name}_{c}") for c in CHANNELS for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("least", F.min))]
    stats = _levels(spark, sf_dir).groupBy("clip", "y", "x").agg(*each)
    around = stats.where(~F.expr(BOX)).groupBy("clip").agg(*[F.avg(f"{name}_{c}").alias(f"around_{name}_{c}") for c in CHANNELS for name in ("mean", "std")])
    return stats.join(around, "clip")


def _each(name: str) -> list:
    return [F.col(f"{name}_{c}") for c in CHANNELS]


def alpha_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha of each pixel of the box by how much less it moves than its surroundings."""
    alpha = variance_alpha(_each("std"), _each("around_std"))
    return _means(spark, sf_dir).where(BOX).select("clip", "y", "x", F.round(alpha, 6).alias("alpha"))


def _alpha():
    return matte_alpha(_each("mean"), _each("around_mean"), INK)


def _bound():
    return bounded(_each("least"), INK)


def alpha_matte_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares alpha of each pixel of the box against its surroundings."""
    return _means(spark, sf_dir).where(BOX).select("clip", "y", "x", F.round(_alpha(), 6).alias("alpha"))


def alpha_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most alpha that the darkest moment of a pixel allows."""
    return _means(spark, sf_dir).where(BOX).select("clip", "y", "x", F.round(_bound(), 6).alias("bound"))


def alpha_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's pixels with the fitted alpha taken out."""
    fit = _means(spark, sf_dir).where(BOX).select("clip", "y", "x", F.round(F.least(_alpha(), _bound()), 6).alias("a"))
    both = _levels(spark, sf_dir).join(fit, ["clip", "y", "x"])
    return both.select("t", "y", "x", *[recovered(F.col(c), F.col("a"), INK).cast("long").alias(c) for c in CHANNELS])


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, y, x, a, bound) of every pixel, nothing outside the box; a row per pixel of a clip, written once for all that read it."""
    within = lambda v: F.when(F.expr(BOX), F.round(v, 6)).otherwise(0.0)
    return written(_means(spark, sf_dir).select("clip", "y", "x", within(_alpha()).alias("a"), within(_bound()).alias("bound")), "fit")


def _scale_energies(spark: SparkSession, sf_dir: str, fit: DataFrame) -> DataFrame:
    """(clip, s, energy): locked edges left in the box when alphas are scaled by s tenths, over all frames of a clip.

    Gradients and means over time are linear: the frames are averaged first, then one tile of a clip and scale is graded.
    """
    maps = fit.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("y", "x", "a", "bound"))).alias("map"))  # 64 of a tile
    maps = maps.select("clip", F.transform("map", lambda m: m["a"]).alias("a"), F.transform("map", lambda m: m["bound"]).alias("bound"))
    gray = scaled_means(_colour_frames(spark, sf_dir).join(maps, "clip"), list(range(10, 41)), GRAY, INK)
    tiles = gray.groupBy("clip", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "gray"))), lambda v: v["gray"]).alias("gray"))
    graded = tiles.select("clip", "s", convolve(F.col("gray"), SOBEL_X).alias("sx"), convolve(F.col("gray"), SOBEL_Y).alias("sy"))
    still = pixels(graded, "sx", "sy").where(BOX)
    return still.groupBy("clip", "s").agg(F.round(F.avg(F.abs("sx") + F.abs("sy")), 5).alias("energy"))


def _best_scales(energy: DataFrame) -> DataFrame:
    best = energy.groupBy("clip").agg(F.min(F.struct("energy", "s")).alias("m"), F.max(F.when(F.col("s") == 10, F.col("energy"))).alias("unscaled"))
    return best.select("clip", (F.col("m.s") / 10).alias("scale"), F.col("m.energy").alias("energy"), "unscaled")


def alpha_scale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scale of the alpha that leaves the least locked edges in the box, what it leaves, and what scale 1 does."""
    return _best_scales(_scale_energies(spark, sf_dir, _fitted(spark, sf_dir)))


def alpha_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fit per pixel of the box: the matte's shape, scaled as the sweep found, within its bound, and whether it is opaque."""
    fit = _fitted(spark, sf_dir)
    both = fit.where(BOX).join(_best_scales(_scale_energies(spark, sf_dir, fit)).select("clip", "scale"), "clip")
    alpha = F.least(F.col("a") * F.col("scale"), F.lit(1 - LEAST_THROUGH), F.col("bound"))
    return both.select("clip", "y", "x", F.round(alpha, 6).alias("alpha"), (F.round(alpha, 6) >= SOLID).alias("opaque"))


def composite_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame blended with its own blur under a feathered box."""
    feather = [[1.0 if 2 <= x <= 5 and 2 <= y <= 5 else 0.5 if 1 <= x <= 6 and 1 <= y <= 6 else 0.0 for x in range(8)] for y in range(8)]
    weights = F.array(*[F.lit(v) for row in feather for v in row])
    both = frames(spark, sf_dir).select("t", F.arrays_zip(F.col("px").alias("p"), convolve(F.col("px"), BLUR).alias("b"), weights.alias("w")).alias("z"))
    return pixels(both.select("t", F.transform("z", lambda z: z["p"] * (1 - z["w"]) + z["b"] * z["w"]).alias("out")), "out").select("t", "y", "x", F.round("out", 6).alias("out"))


def border_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box filled from its four borders by distance, softened, and laid over the frame under the feathered box: one pass over a row."""

    def filled(p: Column) -> Column:
        y, x = F.floor(p / SIDE).cast("int"), p % SIDE
        ends = [(x - LOW + 1, y * SIDE + LOW - 1), (HIGH - x + 1, y * SIDE + HIGH + 1), (y - LOW + 1, (LOW - 1) * SIDE + x), (HIGH - y + 1, (HIGH + 1) * SIDE + x)]
        inside = x.between(LOW, HIGH) & y.between(LOW, HIGH)
        # outside the box any place and distance will do
        shares = [(1 / F.when(inside, far).otherwise(1), F.col("px")[F.when(inside, at).otherwise(p)]) for far, at in ends]
        return F.when(inside, sum(w * v for w, v in shares) / sum(w for w, _ in shares)).otherwise(F.col("px")[p])

    clean = frames(spark, sf_dir).select("t", F.transform(positions(), filled).alias("clean"))
    soft = clean.select("t", "clean", convolve(F.col("clean"), BLUR).alias("soft"))
    weights = F.array(*[F.lit(v) for row in _feather() for v in row])
    both = soft.select("t", F.arrays_zip(F.col("clean").alias("c"), F.col("soft").alias("s"), weights.alias("w")).alias("z"))
    return pixels(both.select("t", F.transform("z", lambda z: z["c"] * (1 - z["w"]) + z["s"] * z["w"]).alias("out")), "out").select("t", "y", "x", F.round("out", 6).alias("out"))


def _feather() -> list[list[float]]:
    """One in the box, half around it."""
    return [[1.0 if LOW <= min(x, y) and max(x, y) <= HIGH else 0.5 if LOW - 1 <= min(x, y) and max(x, y) <= HIGH + 1 else 0.0 for x in range(SIDE)] for y in range(SIDE)]


def dark_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are dark around the box and too bright in it get the surroundings' median there."""
    level = _levels(spark, sf_dir).select("t", F.floor(F.greatest(*CHANNELS)).alias("c"), F.expr(BOX).alias("hole"))
    ring = F.when(~F.col("hole"), F.col("c"))
    out = level.groupBy("t").agg(F.expr("percentile(CASE WHEN NOT hole THEN c END, 0.99)").alias("p99"), F.expr("percentile(CASE WHEN NOT hole THEN c END, 0.5)").alias("median"), F.max(F.when(F.col("hole"), F.col("c"))).alias("top"), F.max(ring).alias("around"))
    # pixels are mid-grey here, so the guard's 24 and 8 of 255 become 170 and 8
    guarded = (F.col("p99") <= 170) & (F.col("top") > F.greatest(F.lit(150), F.col("median") + 8))
    return out.select("t", F.round("p99", 6).alias("p99"), F.round("median", 6).alias("median"), F.col("top").cast("long").alias("top"), guarded.alias("replaced"))


QUERIES = {f.__name__: f for f in (gaussian_blur_tile, dilate_tile, close_tile, sobel_locked_energy, alpha_variance_ratio, alpha_matte_fit, alpha_bound, alpha_recover, alpha_scale_sweep, alpha_fit, composite_feather, border_removal, dark_guard)}


def _conv(kernel, name):
    return f"SELECT vec_id AS t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, round({mirrored(kernel)}, 6) AS {name} FROM embeddings, range(1, 65) r(i) WHERE {WHOLE}"


_LV = f"""lv AS (SELECT label::BIGINT AS clip, vec_id AS t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x,
  {', '.join(f"least(greatest((embedding[((i - 1 + {by}) % 64 + 1)::INT]::DOUBLE + 1) * 127.5, 0), 255) AS c{k}" for k, by in enumerate(TURNS))}
  FROM embeddings, range(1, 65) r(i) WHERE {WHOLE})"""
_ST = f"""{_LV}, st AS (SELECT clip, y, x, {', '.join(f'avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}, min({c}) AS least_{c}' for c in CHANNELS)} FROM lv GROUP BY ALL),
  ar AS (SELECT clip, {', '.join(f'avg(mean_{c}) AS am_{c}, avg(std_{c}) AS as_{c}' for c in CHANNELS)} FROM st WHERE NOT ({BOX}) GROUP BY clip),
  gp AS (SELECT st.*, ar.* EXCLUDE (clip), {' + '.join(f'(mean_{c} - am_{c}) * ({INK} - am_{c})' for c in CHANNELS)} AS top,
    {' + '.join(f'({INK} - am_{c}) ** 2' for c in CHANNELS)} AS bottom FROM st JOIN ar USING (clip) WHERE {BOX}),
  al AS (SELECT *, least(greatest(CASE WHEN bottom > {MIN_CONTRAST**2 * 3} THEN top / bottom ELSE 0 END, 0), 1) AS a,
    least({', '.join(f'least_{c} / {INK}' for c in CHANNELS)}, {SOLID}) AS bound FROM gp)"""
_REC = lambda c, a: f"floor(least(greatest(({c} - {a} * {INK}) / greatest(1 - {a}, {LEAST_THROUGH}), 0), 255))"
_SWEEP = f"""{_ST}, sc AS (SELECT lv.clip, t, s, y, x, CASE WHEN a IS NULL THEN 0 ELSE least(greatest(round(a, 6) * s / 10, 0), {1 - LEAST_THROUGH}, round(bound, 6)) END AS a, c0, c1, c2
    FROM lv LEFT JOIN al USING (clip, y, x), range(10, 41) r(s)),
  gy AS (SELECT clip, t, s, list({' + '.join(f'{w}::DOUBLE * {_REC(c, "a")}' for c, w in zip(CHANNELS, GRAY, strict=True))} ORDER BY y, x) AS gray FROM sc GROUP BY clip, t, s),
  gr AS (SELECT clip, s, (i - 1) // 8 AS y, (i - 1) % 8 AS x, {mirrored(SOBEL_X, "gray")} AS sx, {mirrored(SOBEL_Y, "gray")} AS sy FROM gy, range(1, 65) r(i)),
  en AS (SELECT clip, s, round(avg(e), 5) AS energy FROM (SELECT clip, s, y, x, abs(avg(sx)) + abs(avg(sy)) AS e FROM gr WHERE {BOX} GROUP BY ALL) GROUP BY ALL),
  bs AS (SELECT clip, min_by(s, (energy, s)) / 10 AS scale, min(energy) AS energy, max(energy) FILTER (s = 10) AS unscaled FROM en GROUP BY clip)"""
_NEAR = "a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
ORACLES = {
    "gaussian_blur_tile": _conv(BLUR, "blur"),
    "dilate_tile": f"WITH {PX} SELECT a.t, a.y, a.x, round(max(b.v), 6) AS dilated FROM px a JOIN px b ON {_NEAR} GROUP BY ALL",
    "close_tile": f"WITH {PX}, d AS (SELECT a.t, a.y, a.x, max(b.v) AS v FROM px a JOIN px b ON {_NEAR} GROUP BY ALL) SELECT a.t, a.y, a.x, round(min(b.v), 6) AS closed FROM d a JOIN d b ON {_NEAR} GROUP BY ALL",
    "sobel_locked_energy": f"""WITH s AS (SELECT label::BIGINT AS clip, (i - 1) // 8 AS y, (i - 1) % 8 AS x, {mirrored(SOBEL_X)} AS sx, {mirrored(SOBEL_Y)} AS sy FROM embeddings, range(1, 65) r(i) WHERE {WHOLE}),
      p AS (SELECT clip, y, x, abs(avg(sx)) + abs(avg(sy)) AS e FROM s GROUP BY ALL) SELECT clip, round(avg(e) FILTER ({BOX}), 6) AS energy FROM p GROUP BY clip""",
    "alpha_variance_ratio": f"WITH {_ST} SELECT clip, y, x, round(least(greatest(1 - least({', '.join(f'std_{c} / as_{c}' for c in CHANNELS)}), 0), 1), 6) AS alpha FROM al",
    "alpha_matte_fit": f"WITH {_ST} SELECT clip, y, x, round(a, 6) AS alpha FROM al",
    "alpha_bound": f"WITH {_ST} SELECT clip, y, x, round(bound, 6) AS bound FROM al",
    "alpha_recover": f"""WITH {_ST}, f AS (SELECT clip, y, x, round(least(a, bound), 6) AS a FROM al)
      SELECT t, y, x, {', '.join(f'{_REC(c, "a")}::BIGINT AS {c}' for c in CHANNELS)} FROM lv JOIN f USING (clip, y, x)""",
    "alpha_scale_sweep": f"WITH {_SWEEP} SELECT * FROM bs",
    "alpha_fit": f"""WITH {_SWEEP}, f AS (SELECT clip, y, x, round(least(round(a, 6) * scale, {1 - LEAST_THROUGH}, round(bound, 6)), 6) AS alpha FROM al JOIN bs USING (clip))
      SELECT *, alpha >= {SOLID} AS opaque FROM f""",
    "composite_feather": f"""WITH s AS (SELECT vec_id AS t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, embedding[i]::DOUBLE AS v, {mirrored(BLUR)} AS b FROM embeddings, range(1, 65) r(i) WHERE {WHOLE}),
      w AS (SELECT *, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 1 WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN 0.5 ELSE 0 END AS w FROM s)
      SELECT t, y, x, round(v * (1 - w) + b * w, 6) AS out FROM w""",
    "border_removal": f"""WITH {PX}, c AS (SELECT p.t, p.y, p.x, CASE WHEN p.{BOX.replace(' AND y', ' AND p.y')} THEN (l.v / (p.x - {LOW - 1}) + r.v / ({HIGH + 1} - p.x) + u.v / (p.y - {LOW - 1}) + d.v / ({HIGH + 1} - p.y))
        / (1 / (p.x - {LOW - 1}) + 1 / ({HIGH + 1} - p.x) + 1 / (p.y - {LOW - 1}) + 1 / ({HIGH + 1} - p.y)) ELSE p.v END AS v FROM px p
        JOIN px l ON l.t = p.t AND l.y = p.y AND l.x = {LOW - 1} JOIN px r ON r.t = p.t AND r.y = p.y AND r.x = {HIGH + 1} JOIN px u ON u.t = p.t AND u.x = p.x AND u.y = {LOW - 1} JOIN px d ON d.t = p.t AND d.x = p.x AND d.y = {HIGH + 1}),
      e AS (SELECT t, list(v ORDER BY y, x) AS clean FROM c GROUP BY t), s AS (SELECT t, (i - 1) // 8 AS y, (i - 1) % 8 AS x, clean[i] AS v, {mirrored(BLUR, "clean")} AS b FROM e, range(1, 65) q(i))
      SELECT t, y, x, round(CASE WHEN x BETWEEN {LOW} AND {HIGH} AND y BETWEEN {LOW} AND {HIGH} THEN b WHEN x BETWEEN {LOW - 1} AND {HIGH + 1} AND y BETWEEN {LOW - 1} AND {HIGH + 1} THEN (v + b) / 2 ELSE v END, 6) AS out FROM s""",
    "dark_guard": f"""WITH {_LV}, mx AS (SELECT t, y, x, floor(greatest(c0, c1, c2)) AS c FROM lv),
      g AS (SELECT t, quantile_cont(c, 0.99) FILTER (NOT ({BOX})) AS p99, median(c) FILTER (NOT ({BOX})) AS median, max(c) FILTER ({BOX}) AS top FROM mx GROUP BY t)
      SELECT t, round(p99, 6) AS p99, round(median, 6) AS median, top::BIGINT AS top, p99 <= 170 AND top > greatest(150, median + 8) AS replaced FROM g""",
}

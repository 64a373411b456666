"""Frames of 64 x 64 put together from the tiles of the embeddings table, held in blocks: stencils, regions and detection across their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.frames import SIDE as TILE
from kinograph.functions.windows import bell, blurred, ellipse, gradients, over_ellipse, window_means
from kinograph.operators.edges import PERSIST_FIND, boxes, locked_edges
from kinograph.operators.grid import regions
from kinograph.operators.mosaic import SIDE, block_pixels, stencil
from kinograph.sources.scratch import written
from kinograph.sources.tables import frames

import numpy as np

#: Tiles along a side of a mosaic, and of a block.
TILES, OF_BLOCK = 8, SIDE // TILE
WIDE = TILES * TILE
EDGE, WEAK, STRONG, NEAR, FAR, SIGMA, SOFT = 0.1, 0.1, 0.3, 4, 24, 3.0, 12
#: A detection's seeds and what grows from them, as shares of the strongest, and the least area of a region.
SEED, GROWN, LEAST = 0.20, 0.06, 4
FOUND = 0.16


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole mosaics: 64 tiles of following numbers make a frame, frames go to two clips in turn."""
    tiles = frames(spark, sf_dir).select(F.floor(F.col("t") / TILES**2).alias("m"), (F.col("t") % TILES**2).alias("k"), "px")
    tiles = tiles.select("m", F.floor(F.col("k") / TILES).alias("ty"), (F.col("k") % TILES).alias("tx"), "px")
    blocks = tiles.groupBy("m", F.floor(F.col("ty") / OF_BLOCK).alias("by"), F.floor(F.col("tx") / OF_BLOCK).alias("bx")).agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "px"))).alias("tiles"))

    def row(r: Column) -> Column:  # of a block: a row of each of its tiles there
        return F.concat(*[F.slice(F.col("tiles")[(F.floor(r / TILE) * OF_BLOCK + j).cast("int")]["px"], r % TILE * TILE + 1, TILE) for j in range(OF_BLOCK)])

    blocks = blocks.where(F.size("tiles") == OF_BLOCK**2).withColumn("px", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), row)))
    whole = blocks.groupBy("m").count().where(F.col("count") == (TILES // OF_BLOCK) ** 2).select("m")
    size = F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w")
    return blocks.join(whole, "m", "left_semi").select((F.col("m") % 2).alias("clip"), F.col("m").alias("t"), "by", "bx", *size, "px")


def _graded(a: np.ndarray) -> dict:
    dy, dx = gradients(a)
    return {"v": a, "dy": dy, "dx": dx}


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pixels(stencil(mosaics(spark, sf_dir), 1, _graded, dict.fromkeys(("v", "dy", "dx"), "double")), "v", "dy", "dx")


def mosaic_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel's gradients, central across the borders of blocks, one-sided only where the frame ends."""
    return _edges(spark, sf_dir).select("t", "y", "x", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"))


def mosaic_locked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that stay in place over the frames of a clip."""
    found = locked_edges(_edges(spark, sf_dir), EDGE, "clip")
    return found.select("clip", "y", "x", *[F.round(c, 6).alias(c) for c in ("edge_x", "edge_y", "std", "persistence")], "n_frames")


def _one(spark: SparkSession, sf_dir: str, reach: int, work, *names: str) -> DataFrame:
    out = block_pixels(stencil(mosaics(spark, sf_dir), reach, work, dict.fromkeys(names, "double")), *names)
    return out.select("t", "y", "x", *[F.round(n, 6).alias(n) for n in names])


def mosaic_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing of each frame by an ellipse of nine rows: the least, over it, of the greatest."""
    return _one(spark, sf_dir, 2 * NEAR, lambda a: {"closed": over_ellipse(over_ellipse(a, NEAR), NEAR, np.minimum)}, "closed")


def mosaic_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value within an ellipse of radius 24 and the mean of the square around it, at the cost of radius 1."""
    return _one(spark, sf_dir, FAR, lambda a: {"greatest": over_ellipse(a, FAR), "mean": window_means(a, FAR)}, "greatest", "mean")


def mosaic_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame under a Gaussian of deviation 3, mirrored at the ends of the frame only."""
    return _one(spark, sf_dir, SOFT, lambda a: {"blur": blurred(a, SIGMA, SOFT)}, "blur")


def mosaic_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of bright pixels of each frame that hold a very bright one, through any number of blocks: size, box, and whether they count."""
    px = written(block_pixels(mosaics(spark, sf_dir), "px").where(F.col("px") > WEAK), "bright")
    weak = regions(px.select("t", "y", "x"), "t", SIDE)
    strong = weak.join(px.where(F.col("px") > STRONG).select("t", "y", "x"), ["t", "y", "x"], "left_semi").select("t", "region").distinct()
    found = boxes(weak.join(strong, ["t", "region"], "left_semi"), "t", "region")
    return found.withColumn("counts", F.col("n") >= LEAST)


def mosaic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's mark from end to end: locked and lasting edges, softened, grown from their seeds, closed, and the box around all regions large enough."""
    locked = locked_edges(_edges(spark, sf_dir), FOUND, "clip")
    marked = (F.greatest("edge_x", "edge_y") > FOUND) & (F.col("persistence") >= PERSIST_FIND)
    score = _as_blocks(locked.select("clip", "y", "x", marked.cast("double").alias("v")))
    soft = block_pixels(stencil(score, SOFT, lambda a: {"v": blurred(a, SIGMA, SOFT)}, {"v": "double"}), "v")
    top = soft.groupBy("clip").agg(F.max("v").alias("top")).where("top > 0")
    share = written(soft.join(top, "clip").select("clip", "y", "x", F.round(F.col("v") / F.col("top"), 9).alias("s")), "share")
    weak = regions(share.where(F.col("s") > GROWN), "clip", SIDE)
    seeds = weak.join(share.where(F.col("s") > SEED), ["clip", "y", "x"], "left_semi").select("clip", "region").distinct()
    grown = weak.join(seeds, ["clip", "region"], "left_semi").select("clip", "y", "x", F.lit(1.0).alias("g"))
    binary = _as_blocks(share.join(grown, ["clip", "y", "x"], "left").select("clip", "y", "x", F.coalesce("g", F.lit(0.0)).alias("v")))
    closed = block_pixels(stencil(binary, 2 * NEAR, lambda a: {"v": over_ellipse(over_ellipse(a, NEAR), NEAR, np.minimum)}, {"v": "double"}), "v")
    found = regions(closed.where("v > 0"), "clip", SIDE)
    large = found.groupBy("clip", "region").count().where(F.col("count") >= LEAST).select("clip", "region")
    box = boxes(found.join(large, ["clip", "region"], "left_semi"), "clip")
    return box.join(large.groupBy("clip").agg(F.count("*").alias("regions")), "clip")


def _as_blocks(px: DataFrame) -> DataFrame:
    """Blocks again of (clip, y, x, v): each gathers its own pixels only."""
    at = px.withColumns({"by": F.floor(F.col("y") / SIDE), "bx": F.floor(F.col("x") / SIDE)})
    rows = at.groupBy("clip", F.lit(0).cast("long").alias("t"), "by", "bx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return rows.select("clip", "t", "by", "bx", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform("p", lambda p: p["v"]).alias("px"))


QUERIES = {f.__name__: f for f in (mosaic_gradients, mosaic_locked_edges, mosaic_closing, mosaic_reach, mosaic_blur, mosaic_regions, mosaic_detect)}

_MZ = f"""tl AS (SELECT vec_id // {TILES**2} AS t, vec_id % {TILES**2} AS k, embedding AS e, count(*) OVER (PARTITION BY vec_id // {TILES**2}) AS n FROM embeddings WHERE len(embedding) = {TILE**2}),
  mz AS MATERIALIZED (SELECT t % 2 AS clip, t, k // {TILES} * {TILE} + (i - 1) // {TILE} AS y, k % {TILES} * {TILE} + (i - 1) % {TILE} AS x, e[i]::DOUBLE AS v FROM tl, range(1, {TILE**2 + 1}) r(i) WHERE n = {TILES**2})"""
_GZ = f"""{_MZ}, gz AS (SELECT clip, t, y, x, v, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y IN (0, {WIDE - 1}) THEN 1 ELSE 2 END AS dy,
  (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x IN (0, {WIDE - 1}) THEN 1 ELSE 2 END AS dx FROM mz WINDOW c AS (PARTITION BY t, x ORDER BY y), r AS (PARTITION BY t, y ORDER BY x))"""


def _extreme(source: str, keys: str, radius: int, pick: str) -> str:
    """``pick`` of v over an ellipse: each of its rows a window, of the row that lies as far above or below."""
    rows = ", ".join(f"({d}, {half})" for d, half in zip(range(-radius, radius + 1), ellipse(radius), strict=True))
    return f"""SELECT {keys}, y - d AS y, x, {pick}(v) AS v FROM (SELECT {keys}, y, x, d, {pick}(v) OVER (PARTITION BY {keys}, y, d ORDER BY x ROWS BETWEEN half PRECEDING AND half FOLLOWING) AS v
      FROM {source}, (VALUES {rows}) k(d, half)) WHERE y - d BETWEEN 0 AND {WIDE - 1} GROUP BY ALL"""


def _soft(source: str, keys: str) -> str:
    rows = ", ".join(f"({k - SOFT}, {float(w)!r}::DOUBLE)" for k, w in enumerate(bell(SIGMA, SOFT)))
    mirror = lambda v: f"CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {WIDE - 1} THEN {2 * WIDE - 2} - ({v}) ELSE {v} END"
    row = f"SELECT a.{', a.'.join(keys.split(', '))}, a.y, a.x, sum(w * b.v) AS v FROM {source} a, (VALUES {rows}) k(d, w) JOIN {source} b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND a.y = b.y AND b.x = {mirror('a.x + d')} GROUP BY ALL"
    return f"""(WITH h AS MATERIALIZED ({row}) {row.replace('a.y = b.y AND b.x = ' + mirror('a.x + d'), 'a.x = b.x AND b.y = ' + mirror('a.y + d')).replace(f'FROM {source} a', 'FROM h a').replace(f'JOIN {source} b', 'JOIN h b')})"""


def _flood(name: str, source: str, key: str) -> str:
    """8-connected regions of ``source``, by reachability between runs of its rows."""
    return f"""{name}_u AS MATERIALIZED (SELECT {key}, y, min(x) AS a, max(x) AS b FROM (SELECT {key}, y, x, x - row_number() OVER (PARTITION BY {key}, y ORDER BY x) AS g FROM {source}) GROUP BY {key}, y, g),
    {name}_r AS (SELECT {key}, y, a, b, y AS ry, a AS rx FROM {name}_u
      UNION SELECT m.{key}, m.y, m.a, m.b, r.ry, r.rx FROM {name}_r r JOIN {name}_u m ON m.{key} = r.{key} AND abs(m.y - r.y) = 1 AND m.a <= r.b + 1 AND m.b >= r.a - 1),
    {name}_l AS (SELECT {key}, y, a, b, min(ry * 1048576 + rx) AS region FROM {name}_r GROUP BY ALL),
    {name} AS (SELECT s.{key}, s.y, s.x, region FROM {source} s JOIN {name}_l l ON l.{key} = s.{key} AND l.y = s.y AND s.x BETWEEN a AND b)"""


_BOX = "count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h"
_AROUND = f"ROWS BETWEEN {FAR} PRECEDING AND {FAR} FOLLOWING"
ORACLES = {
    "mosaic_gradients": f"WITH {_GZ} SELECT t, y, x, round(dy, 6) AS dy, round(dx, 6) AS dx FROM gz",
    "mosaic_locked_edges": f"""WITH {_GZ} SELECT clip, y, x, round(abs(avg(dx)), 6) AS edge_x, round(abs(avg(dy)), 6) AS edge_y, round(stddev_pop(v), 6) AS std,
      round(avg(CASE WHEN abs(dx) > {EDGE} OR abs(dy) > {EDGE} THEN 1 ELSE 0 END), 6) AS persistence, count(*) AS n_frames FROM gz GROUP BY clip, y, x""",
    "mosaic_closing": f"WITH {_MZ}, d AS MATERIALIZED ({_extreme('mz', 't', NEAR, 'max')}) SELECT t, y, x, round(v, 6) AS closed FROM ({_extreme('d', 't', NEAR, 'min')})",
    "mosaic_reach": f"""WITH {_MZ}, g AS ({_extreme('mz', 't', FAR, 'max')}), a AS (SELECT t, y, x, sum(v) OVER (PARTITION BY t, y ORDER BY x {_AROUND}) AS s, count(*) OVER (PARTITION BY t, y ORDER BY x {_AROUND}) AS n FROM mz),
      b AS (SELECT t, y, x, sum(s) OVER (PARTITION BY t, x ORDER BY y {_AROUND}) / sum(n) OVER (PARTITION BY t, x ORDER BY y {_AROUND}) AS mean FROM a)
      SELECT t, y, x, round(v, 6) AS greatest, round(mean, 6) AS mean FROM g JOIN b USING (t, y, x)""",
    "mosaic_blur": f"WITH {_MZ} SELECT t, y, x, round(v, 6) AS blur FROM {_soft('mz', 't')}",
    "mosaic_regions": f"""WITH RECURSIVE {_MZ}, br AS (SELECT t, y, x, v FROM mz WHERE v > {WEAK}), {_flood('rg', 'br', 't')}, st AS (SELECT DISTINCT t, region FROM rg JOIN br USING (t, y, x) WHERE v > {STRONG})
      SELECT t, region, {_BOX}, count(*) >= {LEAST} AS counts FROM rg SEMI JOIN st USING (t, region) GROUP BY t, region""",
    "mosaic_detect": f"""WITH RECURSIVE {_GZ}, sc AS MATERIALIZED (SELECT clip, y, x, CASE WHEN greatest(abs(avg(dx)), abs(avg(dy))) > {FOUND} AND avg(CASE WHEN abs(dx) > {FOUND} OR abs(dy) > {FOUND} THEN 1 ELSE 0 END) >= {PERSIST_FIND} THEN 1.0::DOUBLE ELSE 0 END AS v FROM gz GROUP BY ALL),
      sf AS MATERIALIZED (SELECT * FROM {_soft('sc', 'clip')}), tp AS (SELECT clip, max(v) AS top FROM sf GROUP BY clip HAVING max(v) > 0), sh AS MATERIALIZED (SELECT clip, y, x, round(v / top, 9) AS s FROM sf JOIN tp USING (clip)),
      wk AS (SELECT clip, y, x FROM sh WHERE s > {GROWN}), {_flood('wr', 'wk', 'clip')}, sd AS (SELECT DISTINCT clip, region FROM wr JOIN sh USING (clip, y, x) WHERE s > {SEED}),
      gw AS (SELECT clip, y, x FROM wr SEMI JOIN sd USING (clip, region)), bn AS MATERIALIZED (SELECT sh.clip, sh.y, sh.x, CASE WHEN gw.clip IS NULL THEN 0 ELSE 1 END AS v FROM sh LEFT JOIN gw USING (clip, y, x)),
      dl AS MATERIALIZED ({_extreme('bn', 'clip', NEAR, 'max')}), cl AS MATERIALIZED ({_extreme('dl', 'clip', NEAR, 'min')}), mk AS (SELECT clip, y, x FROM cl WHERE v > 0), {_flood('fr', 'mk', 'clip')},
      lg AS (SELECT clip, region FROM fr GROUP BY ALL HAVING count(*) >= {LEAST}) SELECT clip, {_BOX}, count(DISTINCT region) AS regions FROM fr SEMI JOIN lg USING (clip, region) GROUP BY clip""",
}

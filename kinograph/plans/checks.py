"""Smaller rules: search-region edges, knobs, sizing, admission, masks, nearest lookups, sweeps of settings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.functions.frames import SIDE
from kinograph.functions.marching import fill
from kinograph.operators.quality import robust_z
from kinograph.plans.geometry import _C, FRAME_H, FRAME_W, box_clamp
from kinograph.plans.jobs import _J, _jobs
from kinograph.plans.oracle import PX, WHOLE
from kinograph.plans.quality import _events, _z
from kinograph.plans.shots import _PLAN, CUT, _numbered
from kinograph.plans.shots import segment_plan as _plan
from kinograph.plans.tiles import _ST, BOX, _alpha, _means
from kinograph.sources.tables import frames, pixels, table

PAD = 2
#: Fixed value: how far the marching fill looks.
FILL_RADIUS = 5
#: The alpha from which a pixel belongs to a stroke; marks are faint in these tiles.
STROKE = 0.01
#: Bytes of video memory per pixel and frame, of memory per pixel and frame, and the longest segment.
PER_PIXEL, PER_PIXEL_RAM, LONGEST = 80, 6, 2000


def kernel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes made odd, closing gaps (9 at least, 6 % of the shorter side) and coverage rings (48 to 200, by the box)."""
    b = box_clamp(spark, sf_dir)
    odd = lambda n: n + (1 - n % 2)
    gap = F.greatest(F.lit(9), odd(F.bround(0.06 * F.least("w", "h")).cast("long")))
    return b.select("box", odd(F.col("w")).alias("odd"), gap.cast("long").alias("gap"), F.greatest(F.lit(48), F.least(F.col("w"), F.lit(200))).cast("long").alias("ring"))


def roi_edges_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner edges of the top right search region that a box comes near; the frame's own edges do not count."""
    x0, y0, w, h = 224, 0, 96, 54
    b = box_clamp(spark, sf_dir)
    near = {
        "left": (F.lit(x0) > 0) & (F.col("x") <= x0 + PAD + 1),
        "right": (F.lit(x0 + w) < FRAME_W) & (F.col("x") + F.col("w") >= x0 + w - PAD - 1),
        "top": (F.lit(y0) > 0) & (F.col("y") <= y0 + PAD + 1),
        "bottom": (F.lit(y0 + h) < FRAME_H) & (F.col("y") + F.col("h") >= y0 + h - PAD - 1),
    }
    return b.select("box", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in near.items()])), ",").alias("touched"))


def box_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes too long, too small or too large to be a mark, and whether a wider search's box is taken instead."""
    b = box_clamp(spark, sf_dir).withColumn("ratio", F.col("w") / F.col("h"))
    share = F.col("area") / (FRAME_W * FRAME_H)
    says = F.array_compact(F.array(F.when((F.col("ratio") > 5) | (F.col("ratio") < 0.2), F.lit("long")), F.when(share < 0.0005, F.lit("small")), F.when(share > 0.10, F.lit("large"))))
    wider = F.least(F.col("w") + F.col("box") % 7 * 12, F.lit(FRAME_W)) * F.least(F.col("h") + F.col("box") % 4 * 9 - 6, F.lit(FRAME_H))  # a second search's box
    return b.select("box", F.array_join(says, ",").alias("warnings"), wider.alias("retry_area"), ((wider > F.col("area")) & (wider <= 3 * F.col("area"))).alias("widened"))


def time_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates whose numerator is raised tenfold until it is 10,000 at least, so that frames have whole durations."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    times = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(1).cast("long"), lambda t, _: F.when(F.col("n") * t < 10000, t * 10).otherwise(t))
    return p.where("n > 0").select("p_partkey", (F.col("n") * times).alias("num"), times.alias("den"))


def segment_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per segment by what is scarcest: video memory, memory or the ceiling; unknown memory does not count."""
    b = box_clamp(spark, sf_dir).select("box", "area", F.when(F.col("box") % 3 != 0, (F.col("box") + 1) * 3_000_000).alias("vram"), ((F.col("box") + 1) * 2_000_000).alias("ram"))
    vram = F.greatest(F.lit(32), F.floor(F.col("vram") * 0.7 / (PER_PIXEL * F.col("area"))))
    ram = F.greatest(F.lit(32), F.floor(F.col("ram") * 0.25 / (PER_PIXEL_RAM * F.col("area"))) - 10)
    least = F.least(F.when(F.col("vram").isNotNull(), vram), ram, F.lit(LONGEST))
    why = F.when(F.col("vram").isNotNull() & (vram == least), "vram").when(ram == least, "ram").otherwise("ceiling")
    return b.select("box", least.cast("long").alias("frames"), why.alias("reason"))


def box_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run's box comes from (given, else preset, else found) and whether it may grow."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("given"), (F.col("o_orderkey") % 3 == 0).alias("preset"), F.element_at(F.array(F.lit("auto"), F.lit("always"), F.lit("never")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("policy"))
    source = F.when(F.col("given"), "given").when(F.col("preset"), "preset").otherwise("detect")
    return o.select("o_orderkey", source.alias("source"), ((F.col("policy") == "always") | ((F.col("policy") == "auto") & (source == "detect"))).alias("grows"))


def stroke_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the box whose alpha is over ``STROKE``, and their neighbours, per clip."""
    fit = _means(spark, sf_dir).where(BOX).select("clip", "y", "x", F.round(_alpha(), 6).alias("a"))
    span = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    wide = fit.where(F.col("a") > STROKE).select("clip", "y", "x", F.explode(span).alias("dy")).select("clip", "y", "x", "dy", F.explode(span).alias("dx"))
    return wide.select("clip", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).where("y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7").distinct()


def inverse_distance_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean frames with the box filled from outside, by inverse squared distance, within each clip's one tile."""
    mean = pixels(frames(spark, sf_dir), "px").groupBy("clip", "y", "x").agg(F.avg("px").alias("v"))
    tile = mean.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("tile"))  # 64 pixels
    inside = lambda p: p["x"].between(2, 5) & p["y"].between(2, 5)
    tile = tile.withColumns({"hole": F.filter("tile", inside), "known": F.filter("tile", lambda p: ~inside(p))})

    def filled(h):
        weight = lambda k: 1 / (F.pow(h["y"] - k["y"], F.lit(2)) + F.pow(h["x"] - k["x"], F.lit(2)))
        total = lambda f: F.aggregate("known", F.lit(0.0), lambda s, k: s + f(k))
        return F.struct(h["y"].alias("y"), h["x"].alias("x"), F.round(total(lambda k: k["v"] * weight(k)) / total(weight), 6).alias("v"))

    return tile.select("clip", F.inline(F.transform("hole", filled)))


def marching_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean frames with the box filled by a front that marches in from its rim; a task holds one clip's tile."""
    mean = pixels(frames(spark, sf_dir), "px").groupBy("clip", "y", "x").agg(F.avg("px").alias("v"))

    def filled(tile: pa.Table) -> pa.Table:
        y, x, v = (tile.column(c).to_numpy() for c in ("y", "x", "v"))
        a, hole = np.zeros((SIDE, SIDE)), np.zeros((SIDE, SIDE), bool)
        a[y, x] = v
        hole[2:6, 2:6] = True
        out, (y, x) = fill(a, hole, FILL_RADIUS), np.nonzero(hole)
        return pa.table([pa.array([tile.column("clip")[0].as_py()] * len(y), pa.int64()), pa.array(y), pa.array(x), pa.array(out[y, x].round(6))], ["clip", "y", "x", "v"])

    return mean.groupBy("clip").applyInArrow(filled, "clip long, y long, x long, v double")


def tile_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base frames with a tile of the frame of the next number laid over the box; frames without one stay as they are."""
    base = frames(spark, sf_dir).select("t", "px")
    tiles = base.select((F.col("t") - 1).alias("t"), F.col("px").alias("tile"))
    inside = lambda p: (p % 8).between(2, 5) & F.floor(p / 8).between(2, 5)
    over = F.transform("px", lambda v, p: F.when(inside(p), F.coalesce(F.col("tile")[p], v)).otherwise(v))
    return pixels(base.join(tiles, "t", "left").select("t", over.alias("v")), "v").select("t", "y", "x", F.round("v", 6).alias("v"))


def tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a tile, from a frame on: both cuts are made in the scan."""
    own = frames(spark, sf_dir).where("t >= 10")
    inside = F.filter(F.transform("px", lambda v, p: F.when((p % 8).between(2, 5) & F.floor(p / 8).between(2, 5), v)), lambda v: v.isNotNull())
    return own.select("t", F.round(F.aggregate(inside, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of a coordinate grid of step 3 run over each clip's mean frame."""
    mean = pixels(frames(spark, sf_dir), "px").groupBy("clip", "y", "x").agg(F.avg("px").alias("v"))
    return mean.where("x % 3 = 0 OR y % 3 = 0").select("clip", "y", "x", F.round("v", 6).alias("v"))


def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, the event nearest to its hour of the month; ties go to the earlier one.

    Of the events of one second, the one before a stamp is that of the greatest id, the one after it that of the smallest.
    """
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(1704067200) + F.col("o_orderkey") % 744 * 3600).alias("at_s"))
    # one row per distinct stamp, merged with the events in hourly slices: the last before and the first after
    stamps = o.select(F.col("at_s").alias("s")).distinct().withColumn("event_id", F.lit(None).cast("long"))
    day = F.floor((F.col("s") - 1704067200) / 86400)
    line = e.select("s", "event_id").unionByName(stamps).withColumn("day", day)
    before, after = Window.partitionBy("day").orderBy("s", F.col("event_id").asc_nulls_last()), Window.partitionBy("day").orderBy(F.desc("s"), F.col("event_id").desc_nulls_last())
    known = F.when(F.col("event_id").isNotNull(), F.struct("s", "event_id"))
    seen = line.withColumns({"low": F.last(known, ignorenulls=True).over(before), "high": F.last(known, ignorenulls=True).over(after)}).where("event_id IS NULL")
    edges = line.groupBy("day").agg(F.min(known).alias("first"), F.max(known).alias("last"))  # a row per day
    past, future = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("day", F.last("last", ignorenulls=True).over(past).alias("last_before"), F.first("first", ignorenulls=True).over(future).alias("first_after"))
    seen = seen.join(F.broadcast(edges), "day", "left").withColumns({"low": F.coalesce("low", "last_before"), "high": F.coalesce("high", "first_after")})
    low_is = F.col("high").isNull() | (F.col("low").isNotNull() & (F.col("s") - F.col("low.s") <= F.col("high.s") - F.col("s")))
    found = seen.select(F.col("s").alias("at_s"), F.when(low_is, F.col("low")).otherwise(F.col("high")).alias("nearest"))
    return o.join(found, "at_s").select("o_orderkey", F.abs(F.col("nearest.s") - F.col("at_s")).alias("seconds_off"), F.col("nearest.s").alias("event_s"), F.col("nearest.event_id").alias("event_id"))


def nearest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each outlying event is from its user's nearest cut, in events."""
    z = robust_z(_events(spark, sf_dir).select("event_id", "user_id", "value"), "value", "user_id").select("event_id", "z")
    n = _numbered(spark, sf_dir).join(z, "event_id")
    back, ahead = Window.partitionBy("user_id").orderBy("i"), Window.partitionBy("user_id").orderBy(F.desc("i"))
    cut = F.when(F.col("event_type") == CUT, F.col("i"))
    n = n.withColumns({"before": F.last(cut, ignorenulls=True).over(back), "after": F.last(cut, ignorenulls=True).over(ahead)})
    return n.where("abs(z) > 1.5").select("event_id", F.least(F.col("i") - F.col("before"), F.col("after") - F.col("i")).alias("off"))


def config_sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per setting (event type): median and greatest value, outliers, and the worst of them."""
    z = robust_z(_events(spark, sf_dir).select("event_type", "value"), "value", "event_type")
    return z.groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 4).alias("median"), F.max("value").alias("greatest"), F.sum((F.abs("z") > 2).cast("long")).alias("flagged"), F.round(F.max("z"), 4).alias("worst"))


def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest and longest segment of each user's plan."""
    return _plan(spark, sf_dir).groupBy("user_id").agg(F.min(F.col("e") - F.col("s")).alias("shortest"), F.max(F.col("e") - F.col("s")).alias("longest"), F.count("*").alias("segments"))


def free_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space against three times a job's bytes: unknown (or a total of 0) passes, too little is refused."""
    j = _jobs(spark, sf_dir).select("job", "bytes", F.when(F.col("job") % 10 != 0, F.col("job") % 9 * 200000).alias("total"))
    free = F.when(F.col("total") > 0, F.col("total") * 0.75)
    return j.select("job", F.round(free, 2).alias("free"), F.coalesce(free >= 3 * F.col("bytes"), F.lit(True)).alias("fits"), F.coalesce(free < 1.2 * F.col("bytes"), F.lit(False)).alias("warns"))


def job_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of letters of any script, digits, _ and - are job ids; paths that climb are not inside a root."""
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("name"), "url")
    inside = ~F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).rlike(r"/\.\.(/|$)")
    return d.select("page_id", F.col("name").rlike(r"^[\p{L}\p{N}_-]+$").alias("valid"), inside.alias("inside"))


def usable_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines that a host can run: those for a graphics card need one."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("card"))
    engines = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("card")) for n, g in (("draft", False), ("recover", False), ("frames", True), ("video", True))])
    return s.select("s_suppkey", F.array_join(F.transform(F.filter(engines, lambda e: ~e["card"] | F.col("card")), lambda e: e["name"]), ",").alias("engines"))


def oom_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks halved, three times at most, until they fit what an order can hold; never under 32 frames unless whole."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 + 1).alias("n"), (F.col("o_orderkey") % 150 + 1).alias("fits"))
    halve = lambda s, _: F.when((s["size"] > F.col("fits")) & (s["size"] >= 64), F.struct(F.ceil(s["size"] / 2).alias("size"), (s["blocks"] * 2).alias("blocks"))).otherwise(s)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.struct(F.col("n").alias("size"), F.lit(1).cast("long").alias("blocks")), halve)
    return o.select("o_orderkey", done["size"].alias("size"), done["blocks"].alias("blocks"), (done["size"] <= F.col("fits")).alias("fits"))


def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines told apart: out of memory, lost transfer, or anything else."""
    d = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in ("CUDA out of memory", "OutOfMemoryError:", "connection reset by peer", "done")]), (F.col("event_id") % 4 + 1).cast("int")), "event_type").alias("line"))
    kind = F.when(F.lower("line").rlike("out ?of ?memory"), "memory").when(F.lower("line").rlike("connection|timed out"), "transfer").otherwise("other")
    return d.select("event_id", kind.alias("kind"))


def progress_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that count as done for each order: those of a repeated attempt are taken back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_extendedprice").cast("long").alias("n"), (F.col("l_returnflag") == "R").alias("again"))
    return rows.groupBy("l_orderkey").agg(F.sum(F.when(F.col("again"), 0).otherwise(F.col("n"))).alias("done"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("taken_back"))


def head_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six outlying events of each user, in order, as one list."""
    z = robust_z(_events(spark, sf_dir).select("event_id", "user_id", "value"), "value", "user_id").where("abs(z) > 1.5")
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = z.withColumn("n", F.row_number().over(w)).where("n <= 6")
    return first.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("samples"))


QUERIES = {f.__name__: f for f in (kernel_sizes, roi_edges_touched, box_warnings, time_base, segment_sizing, box_source, stroke_mask, inverse_distance_fill, marching_fill, tile_overlay, tile_scan, grid_pixels, nearest_frame, nearest_cut, config_sweep_table, segment_lengths, free_space, job_id_valid, usable_engines, oom_split, failure_class, progress_rollback, head_samples)}

_SEG = f'WITH RECURSIVE {_PLAN} SELECT user_id, min(e - s) AS shortest, max(e - s) AS longest, count(*) AS segments FROM pl GROUP BY user_id'
_ODD = "({0}) + (1 - ({0}) % 2)"
_EVV = "ev0 AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events WHERE ts IS NOT NULL)"
ORACLES = {
    "kernel_sizes": f"WITH {_C} SELECT box, {_ODD.format('w')} AS odd, greatest(9, {_ODD.format('round_even(0.06::DOUBLE * least(w, h), 0)::BIGINT')}) AS gap, greatest(48, least(w, 200)) AS ring FROM cl",
    "roi_edges_touched": f"WITH {_C} SELECT box, concat_ws(',', CASE WHEN x <= 227 THEN 'left' END, CASE WHEN y + h >= 51 THEN 'bottom' END) AS touched FROM cl",
    "box_warnings": f"""WITH {_C}, a AS (SELECT *, w * h AS area FROM cl) SELECT box, concat_ws(',', CASE WHEN w / h > 5 OR w / h < 0.2::DOUBLE THEN 'long' END, CASE WHEN area / {FRAME_W * FRAME_H} < 0.0005::DOUBLE THEN 'small' END,
      CASE WHEN area / {FRAME_W * FRAME_H} > 0.1::DOUBLE THEN 'large' END) AS warnings, area2 AS retry_area, area2 > area AND area2 <= 3 * area AS widened FROM (SELECT *, least(w + box % 7 * 12, {FRAME_W}) * least(h + box % 4 * 9 - 6, {FRAME_H}) AS area2 FROM a)""",
    "time_base": "WITH p AS (SELECT p_partkey, p_size::BIGINT AS n FROM part WHERE p_size > 0), d AS (SELECT *, CASE WHEN n >= 10000 THEN 1 WHEN n >= 1000 THEN 10 WHEN n >= 100 THEN 100 WHEN n >= 10 THEN 1000 ELSE 10000 END::BIGINT AS den FROM p) SELECT p_partkey, n * den AS num, den FROM d",
    "segment_sizing": f"""WITH {_C}, s AS (SELECT box, CASE WHEN box % 3 <> 0 THEN greatest(32, floor((box + 1) * 3000000 * 0.7::DOUBLE / ({PER_PIXEL} * w * h))) END AS v, greatest(32, floor((box + 1) * 2000000 * 0.25::DOUBLE / ({PER_PIXEL_RAM} * w * h)) - 10) AS r FROM cl),
      m AS (SELECT *, least(v, r, {LONGEST}) AS least FROM s) SELECT box, least::BIGINT AS frames, CASE WHEN v = least THEN 'vram' WHEN r = least THEN 'ram' ELSE 'ceiling' END AS reason FROM m""",
    "box_source": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'given' WHEN o_orderkey % 3 = 0 THEN 'preset' ELSE 'detect' END AS source FROM orders)
      SELECT o_orderkey, source, o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND source = 'detect') AS grows FROM o""",
    "stroke_mask": f"WITH {_ST}, m AS (SELECT clip, y, x FROM al WHERE round(a, 6) > {STROKE}) SELECT DISTINCT clip, y + dy AS y, x + dx AS x FROM m, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7",
    "inverse_distance_fill": f"""WITH {PX}, m AS (SELECT clip, y, x, avg(v) AS v FROM px GROUP BY ALL), w AS (SELECT h.clip, h.y, h.x, k.v, 1 / ((h.y - k.y) ** 2 + (h.x - k.x) ** 2) AS w FROM m h JOIN m k ON h.clip = k.clip
      WHERE h.x BETWEEN 2 AND 5 AND h.y BETWEEN 2 AND 5 AND NOT (k.x BETWEEN 2 AND 5 AND k.y BETWEEN 2 AND 5)) SELECT clip, y, x, round(sum(v * w) / sum(w), 6) AS v FROM w GROUP BY clip, y, x""",
    "tile_overlay": f"""WITH f AS (SELECT vec_id AS t, embedding AS e FROM embeddings WHERE {WHOLE}),
      p AS (SELECT a.t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, a.e[i]::DOUBLE AS v, b.e[i]::DOUBLE AS over FROM f a LEFT JOIN f b ON b.t = a.t + 1, range(1, 65) r(i))
      SELECT t, y, x, round(CASE WHEN {BOX} THEN coalesce(over, v) ELSE v END, 6) AS v FROM p""",
    "tile_scan": f"WITH {PX} SELECT t, round(sum(v), 6) AS total FROM px WHERE t >= 10 AND {BOX} GROUP BY t",
    "grid_pixels": f"WITH {PX} SELECT clip, y, x, round(avg(v), 6) AS v FROM px WHERE x % 3 = 0 OR y % 3 = 0 GROUP BY clip, y, x",
    "nearest_frame": f"""WITH {_EVV}, st AS (SELECT DISTINCT 1704067200 + o_orderkey % 744 * 3600 AS a FROM orders), lo AS (SELECT a, max(s) AS s FROM st JOIN ev0 ON s <= a GROUP BY a), hi AS (SELECT a, min(s) AS s FROM st JOIN ev0 ON s >= a GROUP BY a),
      n AS (SELECT a, CASE WHEN hi.s IS NULL OR a - lo.s <= hi.s - a THEN lo.s ELSE hi.s END AS s FROM st LEFT JOIN lo USING (a) LEFT JOIN hi USING (a)),
      e AS (SELECT s, min(event_id) AS first, max(event_id) AS last FROM ev0 GROUP BY s)
      SELECT o_orderkey, abs(s - a) AS seconds_off, s AS event_s, CASE WHEN s <= a THEN last ELSE first END AS event_id FROM orders JOIN n ON a = 1704067200 + o_orderkey % 744 * 3600 JOIN e USING (s)""",
    "nearest_cut": f"""WITH {_z('user_id').replace(', md AS', f', nv AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), md AS', 1)},
      c AS (SELECT user_id, i FROM ev JOIN nv USING (event_id) WHERE event_type = '{CUT}') SELECT z.event_id, (SELECT min(abs(nv.i - c.i)) FROM c WHERE c.user_id = z.user_id) AS off FROM z JOIN nv USING (event_id) WHERE abs(z) > 1.5""",
    "config_sweep_table": f"WITH {_z('event_type')} SELECT event_type, round(median(value), 4) AS median, max(value) AS greatest, count(*) FILTER (abs(z) > 2) AS flagged, round(max(z), 4) AS worst FROM z GROUP BY event_type",
    "segment_lengths": _SEG,
    "free_space": f"""WITH {_J}, f AS (SELECT job, bytes, CASE WHEN job % 10 <> 0 AND job % 9 > 0 THEN job % 9 * 200000 * 0.75::DOUBLE END AS free FROM j)
      SELECT job, round(free, 2) AS free, coalesce(free >= 3 * bytes, true) AS fits, coalesce(free < 1.2::DOUBLE * bytes, false) AS warns FROM f""",
    "job_id_valid": r"""SELECT page_id, regexp_matches(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '^[\p{L}\p{N}_-]+$') AS valid, NOT regexp_matches('/' || regexp_replace(url, '^[a-z]+://', ''), '/\.\.(/|$)') AS inside FROM pages""",
    "usable_engines": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'draft,recover,frames,video' ELSE 'draft,recover' END AS engines FROM supplier",
    "oom_split": """WITH o AS (SELECT o_orderkey, o_orderkey % 400 + 1 AS n, o_orderkey % 150 + 1 AS f FROM orders), a AS (SELECT *, n > f AND n >= 64 AS h1, CASE WHEN n > f AND n >= 64 THEN (n + 1) // 2 ELSE n END AS n1 FROM o),
      b AS (SELECT *, n1 > f AND n1 >= 64 AS h2, CASE WHEN n1 > f AND n1 >= 64 THEN (n1 + 1) // 2 ELSE n1 END AS n2 FROM a), c AS (SELECT *, n2 > f AND n2 >= 64 AS h3, CASE WHEN n2 > f AND n2 >= 64 THEN (n2 + 1) // 2 ELSE n2 END AS n3 FROM b)
      SELECT o_orderkey, n3 AS size, (CASE WHEN h1 THEN 2 ELSE 1 END * CASE WHEN h2 THEN 2 ELSE 1 END * CASE WHEN h3 THEN 2 ELSE 1 END)::BIGINT AS blocks, n3 <= f AS fits FROM c""",
    "failure_class": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'memory' WHEN 2 THEN 'transfer' ELSE 'other' END AS kind FROM events",
    "progress_rollback": "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE floor(l_extendedprice) END)::BIGINT AS done, sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) ELSE 0 END)::BIGINT AS taken_back FROM lineitem GROUP BY l_orderkey",
    "head_samples": f"WITH {_z('user_id')}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM z WHERE abs(z) > 1.5) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS samples FROM n WHERE n <= 6 GROUP BY user_id",
}

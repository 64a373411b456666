"""Restartable partitioned work: grids of parts, what can be kept, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.sources.tables import table

PART_BYTES, PART_FRAMES, SEGMENT, OVERLAP = 65_536, 12, 17, 5


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("size"))


def _grid(sizes: DataFrame) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PART_BYTES) - 1))
    parts = sizes.select("key", "size", k.alias("k"))
    return parts.select("key", (F.col("k") + 1).alias("part"), (F.col("k") * PART_BYTES).alias("begins"), F.least(F.lit(PART_BYTES).cast("long"), F.col("size") - F.col("k") * PART_BYTES).alias("length"))


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal bytes, the last one what is left."""
    return _grid(_sizes(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per (order, number): keys are not unique, so the least of all columns is taken."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order)).alias("m"))
    return first.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("part"), F.col("m.l_quantity").cast("long").alias("counted"), F.col("m.l_extendedprice").alias("price"))


def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's parts, how many from the first on are whole: counted frames must be a multiple of 2."""
    good = _lines(spark, sf_dir).where(F.col("counted") % 2 == 0)
    place = F.row_number().over(Window.partitionBy("key").orderBy("part"))
    unbroken = good.withColumn("place", place).where(F.col("part") == F.col("place")).groupBy("key").agg(F.count("*").alias("whole"))
    known = _lines(spark, sf_dir).groupBy("key").agg(F.count("*").alias("parts"))
    return known.join(unbroken, "key", "left").select("key", "parts", F.coalesce("whole", F.lit(0)).alias("whole"))


def parts_usable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefix(spark, sf_dir).withColumn("frames", F.col("whole") * PART_FRAMES)


def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's work goes on: the segment that holds the first missing frame, and its pre-roll."""
    done = F.col("whole") * PART_FRAMES
    start = F.floor(done / SEGMENT) * SEGMENT
    return _prefix(spark, sf_dir).select("key", done.alias("done"), start.alias("segment"), F.greatest(start - OVERLAP, F.lit(0)).alias("decode_from"), (done - start).alias("emitted_head"))


def multipart_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned parts that are stored with the planned length, in steps of 4 KiB."""
    stored = _lines(spark, sf_dir).select("key", "part", (F.least(F.floor(F.col("price") / 4096) * 4096, F.lit(PART_BYTES))).cast("long").alias("stored"))
    planned = _grid(_sizes(spark, sf_dir))
    met = planned.join(stored, ["key", "part"], "left")
    return met.groupBy("key").agg(F.count("*").alias("planned"), F.sum((F.col("stored") == F.col("length")).cast("long")).alias("reused")).select("key", "planned", F.coalesce("reused", F.lit(0)).alias("reused"))


def chunks_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned parts of each order that no line stands for."""
    return _grid(_sizes(spark, sf_dir)).join(_lines(spark, sf_dir), ["key", "part"], "left_anti").select("key", "part", "begins", "length")


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without any line; urgent ones even with lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return orders.where("priority = '1-URGENT'").union(orders.where("priority IS NULL OR priority <> '1-URGENT'").join(done, "key", "left_anti"))


def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts done of those planned, and the seconds left once two are done, at one part per 90 seconds."""
    planned = _grid(_sizes(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("total"))
    done = _lines(spark, sf_dir).groupBy("key").agg(F.count("*").alias("done"))
    both = planned.join(done, "key", "left").select("key", "total", F.least(F.coalesce("done", F.lit(0)), F.col("total")).alias("done"))
    return both.withColumn("eta", F.when(F.col("done") >= 2, (F.col("total") - F.col("done")) * 90))


def same_size_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name and size are stored already."""
    local = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))
    remote = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("size"))
    return local.join(remote, ["key", "size"], "left_semi")


QUERIES = {f.__name__: f for f in (part_grid, parts_usable_prefix, resume_point, multipart_reuse, chunks_todo, skip_existing, progress_eta, same_size_uploads)}

_GRID = f"""sz AS (SELECT o_orderkey AS key, floor(o_totalprice)::BIGINT AS size FROM orders WHERE o_totalprice > 0),
  grid AS (SELECT key, k + 1 AS part, k * {PART_BYTES} AS begins, least({PART_BYTES}, size - k * {PART_BYTES})::BIGINT AS length FROM sz, range(0, 1000) r(k) WHERE k * {PART_BYTES} < size)"""
_LINES = """ln AS (SELECT * FROM (SELECT l_orderkey AS key, l_linenumber::BIGINT AS part, l_quantity::BIGINT AS counted, l_extendedprice AS price,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1)"""
_PRE = f"""{_LINES}, bad AS (SELECT k.key, min(n) AS n FROM (SELECT DISTINCT key FROM ln) k, range(1, 10) r(n) WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.key = k.key AND part = n AND counted % 2 = 0) GROUP BY k.key),
  pre AS (SELECT key, count(*) AS parts, any_value(n) - 1 AS whole FROM ln JOIN bad USING (key) GROUP BY key)"""
ORACLES = {
    "part_grid": f"WITH {_GRID} SELECT * FROM grid",
    "parts_usable_prefix": f"WITH {_PRE} SELECT key, parts, whole, whole * {PART_FRAMES} AS frames FROM pre",
    "resume_point": f"""WITH {_PRE} SELECT key, whole * {PART_FRAMES} AS done, whole * {PART_FRAMES} // {SEGMENT} * {SEGMENT} AS segment,
      greatest(whole * {PART_FRAMES} // {SEGMENT} * {SEGMENT} - {OVERLAP}, 0) AS decode_from, whole * {PART_FRAMES} % {SEGMENT} AS emitted_head FROM pre""",
    "multipart_reuse": f"""WITH {_GRID}, {_LINES} SELECT grid.key, count(*) AS planned, count(*) FILTER (price IS NOT NULL AND least(floor(price / 4096) * 4096, {PART_BYTES})::BIGINT = length) AS reused
      FROM grid LEFT JOIN ln USING (key, part) GROUP BY grid.key""",
    "chunks_todo": f"WITH {_GRID}, {_LINES} SELECT key, part, begins, length FROM grid ANTI JOIN ln USING (key, part)",
    "skip_existing": "SELECT o_orderkey AS key, o_orderpriority AS priority FROM orders WHERE o_orderpriority = '1-URGENT' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "progress_eta": f"""WITH {_GRID}, {_LINES}, g AS (SELECT key, count(*) AS total FROM grid GROUP BY key), d AS (SELECT key, count(*) AS n FROM ln GROUP BY key),
      b AS (SELECT key, total, least(coalesce(n, 0), total) AS done FROM g LEFT JOIN d USING (key)) SELECT key, total, done, CASE WHEN done >= 2 THEN (total - done) * 90 END AS eta FROM b""",
    "same_size_uploads": "SELECT p_partkey AS key, p_size::BIGINT AS size FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity::BIGINT = p_size)",
}

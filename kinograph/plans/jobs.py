"""Job queries: orders play jobs, customers play hosts, events play the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.operators.jobs import LIVE, ORPHAN_S, STATE_OF_OUTCOME, TAKE_BACK, TERMINAL, WINDOW_S, decide, latest, state_of
from kinograph.sources.tables import table

NOW = 1_030_000_000
#: What an event type does to a job.
STATE_OF_EVENT = {"signup": "preparing", "view": "downloading", "click": "running", "purchase": "uploading", "error": "failed"}
STATE_OF_STATUS = {"F": "succeeded", "O": "running", "P": "interrupted"}
OUTCOMES = {"1-URGENT": "ok", "2-HIGH": "verify_failed", "3-MEDIUM": "coverage_under", "4-NOT SPECIFIED": "internal", "5-LOW": "interrupted"}


def _mapped(column: str, of: dict):
    return F.element_at(F.create_map(*[F.lit(x) for p in of.items() for x in p]), F.col(column))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("job"),
        F.col("o_custkey").alias("host"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "detecting").otherwise(F.coalesce(_mapped("o_orderstatus", STATE_OF_STATUS), F.lit("failed"))).alias("state"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("finished"),
        _mapped("o_orderpriority", OUTCOMES).alias("outcome"),
        F.col("o_orderpriority").alias("priority"),
    )


def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last state; a failure, the first one, ends the job."""
    log = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", _mapped("event_type", STATE_OF_EVENT).alias("state"))
    return latest(log, "user_id", ["us", "event_id"])


def outcome_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome decided for each job and the state that it leads to."""
    j = _jobs(spark, sf_dir)
    decided = decide(F.col("job") % 7 == 0, F.when(F.col("job") % 5 != 0, F.col("outcome")), F.col("job") % 3 != 0, (F.col("job") % 4 - 1).cast("long"))
    return j.select("job", decided.alias("outcome")).withColumn("state", state_of(F.col("outcome")))


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live jobs of each host, and whether it takes another."""
    live = _jobs(spark, sf_dir).groupBy("host").agg(F.sum(F.col("state").isin(*LIVE).cast("long")).alias("live"))
    return live.withColumn("free", F.col("live") < 3)


def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs whose files can go: delivered (urgent ones here), or older than the window."""
    j = _jobs(spark, sf_dir).where(F.col("state").isin(*TERMINAL))
    delivered, age = F.coalesce(F.col("priority") == "1-URGENT", F.lit(False)), NOW - F.col("finished")
    return j.where(delivered | (age >= WINDOW_S)).select("job", "bytes", F.when(delivered, "delivered").otherwise("window").alias("reason"), age.alias("age"))


def emergency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host, jobs in the order in which their space is taken back, until a quarter more than the floor is free."""
    rank = F.array_position(F.array(*[F.lit(s) for s in TAKE_BACK]), F.col("state"))
    w = Window.partitionBy("host").orderBy("rank", "finished", "job").rowsBetween(Window.unboundedPreceding, -1)
    j = _jobs(spark, sf_dir).where(F.col("state").isin(*TERMINAL)).withColumn("rank", rank)
    freed = j.withColumn("freed_before", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    return freed.where(F.col("freed_before") < 1.25 * 400_000).select("host", "job", "rank", "bytes", "freed_before")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts' folders without any live job, an hour old at least (their balance in cents, here)."""
    folders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), F.floor(F.col("c_acctbal")).cast("long").alias("age"))
    return folders.where(F.col("age") >= ORPHAN_S).join(_jobs(spark, sf_dir).where(F.col("state").isin(*LIVE)), "host", "left_anti")


def held_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each host's folder holds, and of ended jobs."""
    return _jobs(spark, sf_dir).groupBy("host").agg(F.sum("bytes").alias("held"), F.sum(F.when(F.col("state").isin(*TERMINAL), F.col("bytes")).otherwise(0)).alias("ended"))


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention sweep frees, by reason, and what it keeps."""
    c = retention_candidates(spark, sf_dir).select("job", "reason")
    kept = _jobs(spark, sf_dir).join(c, "job", "left").withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return kept.groupBy("reason").agg(F.count("*").alias("jobs"), F.sum("bytes").alias("bytes"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by verdict and priority, with subtotals."""
    verdict = F.when(F.col("state") == "succeeded", "processed").when(F.col("state") == "interrupted", "failed").otherwise("blocked")
    out = _jobs(spark, sf_dir).withColumn("verdict", verdict).rollup("verdict", "priority").agg(F.count("*").alias("jobs"), F.sum("bytes").alias("bytes"), F.grouping_id().cast("long").alias("level"))
    return out.select("verdict", "priority", "jobs", "bytes", "level")


def submit_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each submission, by the first rule that applies."""
    j = _jobs(spark, sf_dir).join(capacity(spark, sf_dir), "host")
    known, free_gb = F.col("job") % 11 == 0, F.when(F.col("job") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("bytes") / 10000)
    code = F.when(known, 200).when(F.col("job") % 17 == 0, 400).when(~F.col("free"), 409).when(free_gb < 5, 507).when(F.col("job") % 19 == 0, 400).otherwise(202)
    return j.select("job", code.cast("long").alias("code"))


def orphan_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs still live when their host starts again are interrupted."""
    return _jobs(spark, sf_dir).select("job", F.when(F.col("state").isin(*LIVE), "interrupted").otherwise(F.col("state")).alias("state"), F.col("state").isin(*LIVE).alias("adopted"))


def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host's submissions of one day, the first counts and the others are answered with it."""
    j = _jobs(spark, sf_dir)
    first = j.groupBy("host", "finished").agg(F.min("job").alias("accepted"), F.count("*").alias("sent"))
    return first


QUERIES = {f.__name__: f for f in (latest_job_state, outcome_state, capacity, retention_candidates, emergency_order, orphans, held_bytes, sweep_summary, batch_summary, submit_refusals, orphan_adoption, idempotent_submit)}


def _case(column: str, of: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + f" ELSE {other} END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_J = f"""j AS (SELECT o_orderkey AS job, o_custkey AS host,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'detecting' ELSE {_case('o_orderstatus', STATE_OF_STATUS, "'failed'")} END AS state, floor(o_totalprice)::BIGINT AS bytes,
  epoch(o_orderdate)::BIGINT AS finished, {_case('o_orderpriority', OUTCOMES)} AS outcome, o_orderpriority AS priority FROM orders)"""
_CAP = f"cap AS (SELECT host, count(*) FILTER (state IN {_in(LIVE)}) AS live, count(*) FILTER (state IN {_in(LIVE)}) < 3 AS free FROM j GROUP BY host)"
_RET = f"""ret AS (SELECT job, bytes, CASE WHEN priority = '1-URGENT' THEN 'delivered' ELSE 'window' END AS reason, {NOW} - finished AS age FROM j
  WHERE state IN {_in(TERMINAL)} AND (coalesce(priority = '1-URGENT', false) OR {NOW} - finished >= {WINDOW_S}))"""
ORACLES = {
    "latest_job_state": f"""WITH l AS (SELECT user_id, epoch_us(ts) AS us, event_id, {_case('event_type', STATE_OF_EVENT)} AS state FROM events WHERE user_id IS NOT NULL),
      e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS last FROM l),
      f AS (SELECT user_id, min(first) FILTER (state IN {_in(TERMINAL)}) AS f FROM e GROUP BY user_id)
      SELECT user_id, us, event_id, state FROM e JOIN f USING (user_id) WHERE first = f OR (f IS NULL AND last = 1)""",
    "outcome_state": f"""WITH {_J}, i AS (SELECT job, CASE WHEN job % 5 <> 0 THEN outcome END AS o FROM j),
      d AS (SELECT job, CASE WHEN job % 7 = 0 AND (o IS NULL OR o IN ('interrupted', 'internal')) THEN 'canceled' WHEN o = 'ok' AND job % 3 = 0 THEN 'coverage_under'
        WHEN o IS NOT NULL THEN o WHEN job % 4 = 0 THEN 'interrupted' ELSE 'internal' END AS outcome FROM i)
      SELECT job, outcome, {_case('outcome', STATE_OF_OUTCOME, "'failed'")} AS state FROM d""",
    "capacity": f"WITH {_J}, {_CAP} SELECT * FROM cap",
    "retention_candidates": f"WITH {_J}, {_RET} SELECT * FROM ret",
    "emergency_order": f"""WITH {_J}, r AS (SELECT host, job, list_position([{_in(TAKE_BACK)[1:-1]}], state)::BIGINT AS rank, bytes, finished FROM j WHERE state IN {_in(TERMINAL)}),
      f AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY host ORDER BY rank, finished, job ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM r)
      SELECT host, job, rank, bytes, freed_before FROM f WHERE freed_before < 500000""",
    "orphans": f"WITH {_J} SELECT c_custkey AS host, floor(c_acctbal)::BIGINT AS age FROM customer WHERE floor(c_acctbal) >= {ORPHAN_S} AND NOT EXISTS (SELECT 1 FROM j WHERE host = c_custkey AND state IN {_in(LIVE)})",
    "held_bytes": f"WITH {_J} SELECT host, sum(bytes)::BIGINT AS held, sum(CASE WHEN state IN {_in(TERMINAL)} THEN bytes ELSE 0 END)::BIGINT AS ended FROM j GROUP BY host",
    "sweep_summary": f"WITH {_J}, {_RET} SELECT coalesce(reason, 'kept') AS reason, count(*) AS jobs, sum(j.bytes)::BIGINT AS bytes FROM j LEFT JOIN ret USING (job) GROUP BY 1",
    "batch_summary": f"""WITH {_J}, v AS (SELECT *, CASE state WHEN 'succeeded' THEN 'processed' WHEN 'interrupted' THEN 'failed' ELSE 'blocked' END AS verdict FROM j)
      SELECT verdict, priority, count(*) AS jobs, sum(bytes)::BIGINT AS bytes, grouping(verdict, priority)::BIGINT AS level FROM v GROUP BY ROLLUP (verdict, priority)""",
    "submit_refusals": f"""WITH {_J}, {_CAP} SELECT job, CASE WHEN job % 11 = 0 THEN 200 WHEN job % 17 = 0 THEN 400 WHEN NOT free THEN 409
      WHEN job % 13 <> 0 AND bytes / 10000 < 5 THEN 507 WHEN job % 19 = 0 THEN 400 ELSE 202 END::BIGINT AS code FROM j JOIN cap USING (host)""",
    "orphan_adoption": f"WITH {_J} SELECT job, CASE WHEN state IN {_in(LIVE)} THEN 'interrupted' ELSE state END AS state, state IN {_in(LIVE)} AS adopted FROM j",
    "idempotent_submit": f"WITH {_J} SELECT host, finished, min(job) AS accepted, count(*) AS sent FROM j GROUP BY host, finished",
}

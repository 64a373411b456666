"""Options, reports, deliveries, progress and resumable parts of the job service."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.signing import hmac_sha256
from kinograph.operators.delivery import MAX_ATTEMPTS, deliver
from kinograph.operators.folds import fold_sorted
from kinograph.operators.repair import repair_blocks
from kinograph.plans.jobs import _J, _jobs
from kinograph.plans.oracle import PX
from kinograph.sources.records import part_states, resume_parts
from kinograph.sources.scratch import scratch, written
from kinograph.sources.tables import frames, pixels, table

# Options by name with the flag that takes their value, and flags that are set when an option is false.
VALUE_FLAGS = {
    "corner": "--corner",
    "samples": "--samples",
    "roiFrac": "--roi-frac",
    "gradThreshold": "--grad-threshold",
    "persistence": "--persistence",
    "maxArea": "--max-area",
    "dilate": "--dilate",
    "feather": "--feather",
    "margin": "--margin",
    "crf": "--crf",
    "x264Preset": "--x264-preset",
    "patchHold": "--patch-hold",
    "cacheTolerance": "--cache-tolerance",
    "unblendSamples": "--unblend-samples",
    "threads": "--threads",
    "device": "--device",
    "ppSegment": "--pp-segment",
    "ppPart": "--pp-part",
    "ppSubvideo": "--pp-subvideo",
    "ppWorkers": "--pp-workers",
    "raftIter": "--raft-iter",
    "ppMinShot": "--pp-min-shot",
    "ppSceneThreshold": "--pp-scene-threshold",
    "propainter": "--propainter",
    "coverageGate": "--coverage-gate",
    "coverageRing": "--coverage-ring",
    "coverageGrow": "--coverage-grow",
}
NEGATIVE_FLAGS = {"fp16": "--no-fp16", "ppBlackCuts": "--pp-no-black-cuts", "resume": "--no-resume", "verify": "--no-verify"}
# The keys of a run's report, in order.
REPORT_KEYS = ("schema", "version", "ok", "outcome", "input", "output", "engine", "engine_label", "device", "device_label", "video", "box", "tile", "coverage", "unblend", "propainter", "verify", "elapsed_seconds", "host", "error")
_NAMES = [*VALUE_FLAGS, *NEGATIVE_FLAGS, "colour", "mode"]  # the last two are no options
ECHO_S = 3600 * 24
PART_FRAMES = 12


def argv(options: Column) -> Column:
    """A map of options as command-line arguments, in the order of the flag tables: null values and unknown names are dropped, and booleans of value flags."""

    def joined(m: Column) -> Column:  # a variable of the function, so that the map is made once a row and not once a flag
        takes = [F.when(~m[name].isin("true", "false"), F.concat(F.lit(flag + " "), m[name])) for name, flag in VALUE_FLAGS.items()]
        offs = [F.when(m[name] == "false", F.lit(flag)) for name, flag in NEGATIVE_FLAGS.items()]
        return F.array_join(F.array(*takes, *offs), " ")  # nulls are left out

    return F.transform(F.array(options), joined)[0]


def options_argv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's options (six of them, some null, some unknown) as arguments."""
    e = table(spark, sf_dir, "events").select("event_id")
    names = F.array(*[F.lit(n) for n in _NAMES])
    name = lambda i: F.element_at(names, ((F.col("event_id") + i * 5) % len(_NAMES) + 1).cast("int"))
    value = lambda i: F.when((F.col("event_id") + i) % 4 == 0, F.lit("false")).when((F.col("event_id") + i) % 4 == 1, F.lit("true")).when((F.col("event_id") + i) % 7 != 0, (F.col("event_id") * (i + 1) % 100).cast("string"))
    given = F.map_from_arrays(F.array(*[name(i) for i in range(6)]), F.array(*[value(i) for i in range(6)]))
    return e.select("event_id", argv(given).alias("argv"))


def merged_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults overlaid with what an order sets and is not null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    own = F.create_map(F.lit("dilate"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 9).cast("string")), F.lit("engine"), F.left("o_orderpriority", F.lit(1)))
    defaults = F.create_map(*[F.lit(x) for x in ("margin", "16", "feather", "3")])
    base = F.map_concat(defaults, F.map_from_arrays(F.array(F.lit("crf")), F.array(F.lit("18"))))
    kept = F.map_filter(own, lambda k, v: v.isNotNull())
    pairs = F.array_sort(F.map_entries(F.map_concat(base, kept)))
    return o.select("o_orderkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("knobs"))


def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as data URIs, by digest."""
    uri = F.concat(F.lit("data:text/html;base64,"), F.translate(F.base64(F.coalesce("html", F.lit("")).cast("binary")), "\r\n", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.length(uri).cast("long").alias("chars"), F.sha2(uri.cast("binary"), 256).alias("digest"))


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's report with all its keys, null where an engine has nothing to say, as one JSON text."""
    j = _jobs(spark, sf_dir)
    known = {
        "schema": F.lit(1),
        "version": F.lit("1.0"),
        "ok": F.coalesce(F.col("outcome") == "ok", F.lit(False)),
        "outcome": F.col("outcome"),
        "input": F.concat(F.lit("in/"), F.col("job")),
        "output": F.when(F.col("outcome") == "ok", F.concat(F.lit("out/"), F.col("job"))),
        "coverage": F.when(F.col("job") % 2 == 0, F.struct((F.col("job") % 3 == 0).alias("ok"))),
        "elapsed_seconds": F.col("bytes") % 1000,
        "host": F.concat(F.lit("h"), F.col("host")),
        "error": F.when(F.col("state") == "failed", F.lit("failed")),
    }
    doc = F.struct(*[known.get(k, F.lit(None).cast("string")).alias(k) for k in REPORT_KEYS])
    return j.select("job", F.to_json(doc, {"ignoreNullFields": "false"}).alias("report"))


def aborted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open uploads of each part that an abort ends, and uploads that stay."""
    lines = table(spark, sf_dir, "lineitem")
    opened = F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).cast("long")
    return lines.groupBy("l_partkey").agg(F.sum(opened).alias("aborted"), F.sum(1 - opened).alias("stay"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, statuses): what each order's deliveries were answered, in the order of its lines (seven at most)."""
    status = F.when(F.col("l_returnflag") == "R", 503).when(F.col("l_returnflag") == "A", 429).when(F.col("l_linenumber") % 3 == 0, 404).otherwise(200)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(status).alias("status"))
    return lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "status"))), lambda s: s["status"]).alias("statuses"))


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each delivery (four at most), seconds waited before them (1, 2, 4), and whether it landed; refusals are not repeated."""
    start = F.struct(F.lit(0).cast("long").alias("attempts"), F.lit(0).alias("status"))
    settled = lambda s: ((s > 0) & (s < 300)) | ((s >= 400) & (s < 500) & (s != 429))
    done = F.aggregate(F.slice("statuses", 1, MAX_ATTEMPTS), start, lambda a, s: F.when(settled(a["status"]), a).otherwise(F.struct((a["attempts"] + 1).alias("attempts"), s.alias("status"))))
    out = _answers(spark, sf_dir).select("key", done["attempts"].alias("attempts"), (done["status"] < 300).alias("delivered"))
    return out.withColumn("waited", (F.pow(F.lit(2), F.col("attempts") - 1) - 1).cast("long"))


class _Replay:
    """A receiver that gives each message the answers that its body lists, the last one again when they are out."""

    def __init__(self):
        self.calls = {}

    def __call__(self, name: int, body: str) -> int:
        answers = body.split(",")
        k = self.calls[name] = self.calls.get(name, -1) + 1
        return int(answers[min(k, len(answers) - 1)])


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sent by the tasks that hold them, to a receiver that replays recorded answers: attempts, and whether they landed."""
    messages = _answers(spark, sf_dir).select(F.col("key").alias("id"), F.array_join(F.col("statuses").cast("array<string>"), ",").alias("body"))
    return deliver(messages, _Replay(), wait=lambda seconds: None).select(F.col("id").alias("key"), "attempts", "delivered")


def progress_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes done of each order by its ordered deltas; a repeated attempt takes its bytes back, never below none."""
    n = F.floor("l_extendedprice").cast("long")
    delta = F.when(F.col("l_returnflag") == "R", -n).otherwise(n)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(delta).alias("delta"))
    ordered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "delta"))).alias("d"))
    zero = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("most"))

    def add(a, x):
        now = F.greatest(a["done"] + x["delta"], F.lit(0))
        return F.struct(now.alias("done"), F.greatest(a["most"], now).alias("most"))

    return ordered.select("l_orderkey", F.aggregate("d", zero, add).alias("a")).select("l_orderkey", "a.done", "a.most")


def heartbeat_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose progress is echoed: it moved since the last echo, which is more than a day back."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    e = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.floor("value").cast("long").alias("done"))

    def step(state, row):
        at, done = state or (None, -1)
        said = row["done"] != done and (at is None or row["us"] - at > ECHO_S * 1_000_000)
        return ((row["us"], row["done"]) if said else (at, done)), (said,)

    schema = "user_id long, us long, event_id long, done long, said boolean"
    return fold_sorted(e, ["user_id"], ["us", "event_id"], step, schema, ["said"]).where("said").select("user_id", "event_id", "done")


def webhook_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received messages whose signature is that of their time and body under a derived key; every fifth was tampered with."""
    key = hashlib.sha256(b"kinograph" + b"hooks").digest()
    j = _jobs(spark, sf_dir)
    body = F.concat(F.lit('{"job":'), F.col("job"), F.lit("}"))
    signed = lambda b: hmac_sha256(key, F.concat(F.lit("v1:"), F.col("finished").cast("string"), F.lit(":"), b))
    received = j.select("job", "finished", F.when(F.col("job") % 5 == 0, F.concat(body, F.lit(" "))).otherwise(body).alias("body"), signed(body).alias("signature"))
    return received.select("job", (signed(F.col("body")) == F.col("signature")).alias("valid"))


def parts_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written in parts; a run that broke off after two parts and a half is taken up again: what was there is not written twice."""
    own, path = frames(spark, sf_dir), scratch(spark, "resumed")
    resume_parts(own.where(F.col("t") < PART_FRAMES * 2 + 5), path, PART_FRAMES, "settings")
    before = written(part_states(spark, path).select("part", F.col("written").alias("then")), "states")  # its files are about to go
    resume_parts(own, path, PART_FRAMES, "settings")
    after = part_states(spark, path)
    return after.join(before, "part", "left").select("part", "counted", "first", "last", F.coalesce(F.col("written") == F.col("then"), F.lit(False)).alias("reused"))


def repair_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a box filled by the mean of what surrounds it, over their block of eight and three frames before and after it."""
    import numpy as np

    mask = np.zeros((8, 8), bool)
    mask[2:6, 2:6] = True
    done = repair_blocks(frames(spark, sf_dir), mask, "steady", block=8, overlap=3)
    return pixels(done, "px").select("t", "y", "x", F.round("px", 6).alias("v"))


QUERIES = {f.__name__: f for f in (options_argv, merged_knobs, data_uri, full_report, aborted_uploads, delivery_attempts, deliveries, progress_deltas, heartbeat_echo, webhook_verified, parts_resumed, repair_in_context)}

_FLAGS = ", ".join(f"({i}, '{n}', '{f}', {'true' if n in VALUE_FLAGS else 'false'})" for i, (n, f) in enumerate({**VALUE_FLAGS, **NEGATIVE_FLAGS}.items()))
_LINES = "ln AS (SELECT l_orderkey AS key, l_linenumber AS i, min({value}) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_ANSWER = "CASE WHEN l_returnflag = 'R' THEN 503 WHEN l_returnflag = 'A' THEN 429 WHEN l_linenumber % 3 = 0 THEN 404 ELSE 200 END"
_FINAL = "(v < 300 OR (v >= 400 AND v < 500 AND v <> 429))"
_REPORT = {
    "schema": "'1'",
    "version": "'\"1.0\"'",
    "ok": "CASE WHEN outcome = 'ok' THEN 'true' ELSE 'false' END",
    "outcome": "coalesce('\"' || outcome || '\"', 'null')",
    "input": "'\"in/' || job || '\"'",
    "output": "CASE WHEN outcome = 'ok' THEN '\"out/' || job || '\"' ELSE 'null' END",
    "coverage": "CASE WHEN job % 2 = 0 THEN '{\"ok\":' || CASE WHEN job % 3 = 0 THEN 'true' ELSE 'false' END || '}' ELSE 'null' END",
    "elapsed_seconds": "(bytes % 1000)::VARCHAR",
    "host": "'\"h' || host || '\"'",
    "error": "CASE WHEN state = 'failed' THEN '\"failed\"' ELSE 'null' END",
}
ORACLES = {
    "options_argv": f"""WITH fl AS (SELECT * FROM (VALUES {_FLAGS}) v(ord, name, flag, takes)), nm AS (SELECT {list(_NAMES)} AS names),
      op AS (SELECT event_id, names[(event_id + i * 5) % {len(_NAMES)} + 1] AS name, CASE (event_id + i) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE CASE WHEN (event_id + i) % 7 <> 0 THEN (event_id * (i + 1) % 100)::VARCHAR END END AS value
        FROM events, nm, range(6) r(i)),
      ar AS (SELECT event_id, ord, CASE WHEN takes AND value NOT IN ('true', 'false') THEN flag || ' ' || value WHEN NOT takes AND value = 'false' THEN flag END AS arg FROM op JOIN fl USING (name))
      SELECT event_id, coalesce(string_agg(arg, ' ' ORDER BY ord), '') AS argv FROM events LEFT JOIN ar USING (event_id) GROUP BY event_id""",
    "merged_knobs": """SELECT o_orderkey, 'crf=18' || CASE WHEN o_orderkey % 2 = 0 THEN ';dilate=' || o_orderkey % 9 ELSE '' END || coalesce(';engine=' || left(o_orderpriority, 1), '') || ';feather=3;margin=16' AS knobs FROM orders""",
    "data_uri": "SELECT page_id, length(u) AS chars, sha256(u) AS digest FROM (SELECT page_id, 'data:text/html;base64,' || to_base64(encode(coalesce(html, ''))) AS u FROM pages)",
    "full_report": f"""WITH {_J} SELECT job, '{{' || {" || ',' || ".join(f"'\"{k}\":' || {_REPORT.get(k, chr(39) + 'null' + chr(39))}" for k in REPORT_KEYS)} || '}}' AS report FROM j""",
    "aborted_uploads": "SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS aborted, count(*) FILTER (coalesce(l_linestatus, '') <> 'O') AS stay FROM lineitem GROUP BY l_partkey",
    "delivery_attempts": f"""WITH {_LINES.format(value=_ANSWER)}, nr AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY i) AS n FROM ln),
      st AS (SELECT key, least(coalesce(min(n) FILTER ({_FINAL}), max(n)), {MAX_ATTEMPTS}) AS attempts FROM nr GROUP BY key)
      SELECT key, attempts, v < 300 AS delivered, (2 ** (attempts - 1) - 1)::BIGINT AS waited FROM st JOIN nr USING (key) WHERE n = attempts""",
    "deliveries": f"""WITH {_LINES.format(value=_ANSWER)}, nr AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY i) AS n FROM ln),
      st AS (SELECT key, min(n) FILTER ({_FINAL} AND n <= {MAX_ATTEMPTS}) AS n FROM nr GROUP BY key)
      SELECT st.key, coalesce(st.n, {MAX_ATTEMPTS}) AS attempts, coalesce(v < 300, false) AS delivered FROM st LEFT JOIN nr ON nr.key = st.key AND nr.n = st.n""",
    "progress_deltas": f"""WITH RECURSIVE {_LINES.format(value="CASE WHEN l_returnflag = 'R' THEN -floor(l_extendedprice) ELSE floor(l_extendedprice) END::BIGINT")}, nr AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY i) AS n FROM ln),
      fo AS (SELECT key, n, greatest(v, 0) AS done, greatest(v, 0) AS most FROM nr WHERE n = 1 UNION ALL
        SELECT nr.key, nr.n, greatest(fo.done + nr.v, 0), greatest(fo.most, fo.done + nr.v) FROM fo JOIN nr ON nr.key = fo.key AND nr.n = fo.n + 1)
      SELECT key AS l_orderkey, max_by(done, n) AS done, max(most) AS most FROM fo GROUP BY key""",
    "heartbeat_echo": f"""WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) AS us, event_id, floor(value)::BIGINT AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
      fo AS (SELECT user_id, i, us AS at, done AS said, event_id, done <> -1 AS is_said FROM ev WHERE i = 1 UNION ALL
        SELECT ev.user_id, ev.i, CASE WHEN ev.done <> fo.said AND ev.us - fo.at > {ECHO_S * 1_000_000} THEN ev.us ELSE fo.at END,
          CASE WHEN ev.done <> fo.said AND ev.us - fo.at > {ECHO_S * 1_000_000} THEN ev.done ELSE fo.said END, ev.event_id, ev.done <> fo.said AND ev.us - fo.at > {ECHO_S * 1_000_000}
        FROM fo JOIN ev ON ev.user_id = fo.user_id AND ev.i = fo.i + 1)
      SELECT user_id, event_id, said AS done FROM fo WHERE is_said""",
    "webhook_verified": "SELECT o_orderkey AS job, o_orderkey % 5 <> 0 AS valid FROM orders",
    "parts_resumed": f"""WITH f AS (SELECT vec_id AS t, vec_id // {PART_FRAMES} AS part FROM embeddings WHERE len(embedding) = 64)
      SELECT part, count(*) AS counted, min(t) AS first, max(t) AS last, part < 2 AND count(*) = {PART_FRAMES} AS reused FROM f GROUP BY part""",
    "repair_in_context": f"""WITH {PX}, m AS (SELECT clip, t, avg(v) FILTER (NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)) AS m FROM px GROUP BY clip, t),
      n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS i FROM m),
      c AS (SELECT a.t, avg(b.m) AS m FROM n a JOIN n b ON a.clip = b.clip AND b.i BETWEEN a.i // 8 * 8 - 3 AND a.i // 8 * 8 + 10 GROUP BY a.t)
      SELECT t, y, x, round(CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN m ELSE v END, 6) AS v FROM px JOIN c USING (t)""",
}

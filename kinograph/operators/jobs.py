"""Jobs as an event log: states, outcomes, admission, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States that run, states that end, and the state that each outcome leads to (others: failed).
LIVE = ("preparing", "downloading", "detecting", "running", "uploading")
TERMINAL = ("succeeded", "failed", "needs_review", "canceled", "interrupted")
STATE_OF_OUTCOME = {
    "ok": "succeeded",
    "coverage_inconclusive": "needs_review",
    "coverage_under": "needs_review",
    "verify_failed": "needs_review",
    "interrupted": "interrupted",
    "canceled": "canceled",
}
# Seconds that outputs stay, that unknown folders stay, and the order in which space is taken back.
WINDOW_S, ORPHAN_S = 48 * 3600, 3600
TAKE_BACK = ("succeeded", "canceled", "failed", "needs_review", "interrupted")


def state_of(outcome: Column) -> Column:
    """The state for an outcome."""
    pairs = [F.lit(x) for pair in STATE_OF_OUTCOME.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), outcome), F.lit("failed"))


def decide(canceled: Column, outcome: Column, covered: Column, exit_code: Column) -> Column:
    """A finished run's outcome: a wanted cancel first, then coverage, then its own word, then how it ended."""
    return (
        F.when(canceled & (outcome.isNull() | outcome.isin("interrupted", "internal")), "canceled")
        .when((outcome == "ok") & (F.coalesce(covered, F.lit(True)) == F.lit(False)), "coverage_under")
        .when(outcome.isNotNull(), outcome)
        .when(exit_code < 0, "interrupted")
        .otherwise("internal")
    )


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle; a terminal row, the first one, is the last."""
    rest = [c for c in log.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    ended = F.col("state").isin(*TERMINAL)
    both = log.groupBy(key).agg(F.min(F.when(ended, row)).alias("end"), F.max(row).alias("last"))
    return both.select(key, F.coalesce("end", "last").alias("r")).select(key, "r.*")

"""Scalar column functions of domains, decisions and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence_level(c: Column | str) -> Column:
    """high from .85, medium from .5, low above 0, else unknown."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v >= 0.85, F.lit("high")).when(v >= 0.5, F.lit("medium")).when(v > 0, F.lit("low")).otherwise("unknown")


def requires_human(domain: Column | str) -> Column:
    return (F.col(domain) if isinstance(domain, str) else domain) == "Disorder"


def is_emergency(domain: Column | str) -> Column:
    return (F.col(domain) if isinstance(domain, str) else domain) == "Chaotic"


def is_approved(decision: Column | str) -> Column:
    return (F.col(decision) if isinstance(decision, str) else decision) == "approve"


def needs_review(decision: Column | str) -> Column:
    return (F.col(decision) if isinstance(decision, str) else decision) == "escalate"


def is_error(decision: Column | str) -> Column:
    """Whether a policy could not be evaluated: such a decision is neither approved nor one for review."""
    return (F.col(decision) if isinstance(decision, str) else decision) == "error"


def fold_sessions(steps: DataFrame) -> DataFrame:
    """(session, depth, domain, confidence, level, has_rejection, requires_human) per session.

    ``steps`` has session, seq, domain, confidence and decision; the latest domain and
    confidence hold, and a session needs a human in Disorder or after an escalation.
    """
    got = steps.groupBy("session").agg(F.count("*").alias("depth"), F.max_by(F.struct("domain", "confidence"), "seq").alias("e"), F.max(F.coalesce(F.col("decision") == "reject", F.lit(False))).alias("has_rejection"), F.max(F.coalesce(needs_review("decision"), F.lit(False))).alias("_up"))
    return got.select("session", "depth", "e.domain", "e.confidence", confidence_level(F.col("e.confidence")).alias("level"), "has_rejection", (requires_human(F.col("e.domain")) | F.col("_up")).alias("requires_human"))


def reasoning_log(steps: DataFrame) -> DataFrame:
    """(session, log): what each step of a session gave as its reasoning, in order; steps without any are left out.

    A session's log is one row, so a session must fit in a task.
    """
    said = F.struct("seq", "reasoning")
    return steps.where("reasoning is not null").groupBy("session").agg(F.sort_array(F.collect_list(said)).alias("_log")).select("session", F.transform("_log", lambda x: x["reasoning"]).alias("log"))


def reclassify(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """``steps`` (session, seq, domain, confidence, decision) with further classifications (session, seq, domain, confidence).

    They count as steps without a decision, so ``fold_sessions`` takes the latest of both.
    """
    return steps.select("session", "seq", "domain", "confidence", "decision").unionByName(changes.select("session", "seq", "domain", "confidence", F.lit(None).cast("string").alias("decision")))

"""What should have happened and hasn't: gaps of five kinds, their order and summary.

A gap is (kind, subject, severity, days, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import at, days_between
from .sets import names_in_texts

# Labels of people to keep in touch with, language of a state that waits for
# something, and the order of severities.
KEY_LABELS = ["partner", "client", "key"]
WAITING = ["await", "pending", "follow%up", "follow-up", "waiting", "response%needed", "no reply"]
ORDER = {"critical": 0, "high": 1, "medium": 2}
KINDS = ["communication", "commitment", "thread", "project", "prediction"]


def like_some(text: str | Column, patterns: list[str]) -> Column:
    """Whether a text holds one of the patterns, in any case; % stands for any letters."""
    text = F.lower(text)
    out = F.lit(False)
    for p in patterns:
        out = out | text.like(f"%{p}%")
    return F.coalesce(out, F.lit(False))


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between, cut towards zero."""
    return days_between(later, earlier).cast("int")


def communication(mentions: DataFrame, entities: DataFrame, open_texts: DataFrame, as_of: str, silent: int = 5) -> DataFrame:
    """Key people, silent for long, whose name stands in something that is open.

    ``open_texts``: id, text of open commitments (owner, assignee, text) and threads."""
    last = mentions.groupBy("entity_id").agg(F.max("mention_date").alias("last"))
    key = entities.filter(F.col("label").isin(KEY_LABELS) & ~F.col("dismissed")).select(F.col("id").alias("entity_id"), "name", "label")
    quiet = key.join(last, "entity_id").withColumn("days", whole_days(at(as_of), F.col("last"))).filter(F.col("days") > silent)
    named = names_in_texts(quiet.select(F.col("entity_id").alias("name_id"), "name"), open_texts.select(F.col("id").alias("text_id"), "text")).select(F.col("name_id").alias("entity_id")).distinct()
    severity = F.when(F.col("days") > 14, "critical").when(F.col("days") > 7, "high").otherwise("medium")
    detail = F.concat("label", F.lit(" silent for "), F.col("days").cast("string"), F.lit(" days"))
    return quiet.join(named, "entity_id", "left_semi").select(F.lit("communication").alias("kind"), F.col("name").alias("subject"), severity.alias("severity"), "days", detail.alias("detail"))


def commitment(commitments: DataFrame, recent_texts: DataFrame, as_of: str, soon: int = 3, begins: int = 40) -> DataFrame:
    """Active commitments (``id, text, due_date``) past due or due soon whose text's begin
    stands in no recent item (``id, text``)."""
    due = commitments.filter((F.col("state") == "active") & (days_between(F.col("due_date"), at(as_of)) < soon))
    due = due.withColumn("left", whole_days(F.col("due_date"), at(as_of)))
    told = names_in_texts(due.select(F.col("id").alias("name_id"), F.substring("text", 1, begins).alias("name")), recent_texts.select(F.col("id").alias("text_id"), "text"))
    open_ = due.join(told.select(F.col("name_id").alias("id")).distinct(), "id", "left_anti")
    late = F.col("left") < 0
    severity = F.when(late, "critical").when(F.col("left") <= 1, "high").otherwise("medium")
    detail = F.when(late, F.concat(F.lit("overdue by "), F.abs("left").cast("string"), F.lit(" days"))).otherwise(F.concat(F.lit("due in "), F.col("left").cast("string"), F.lit(" days")))
    return open_.select(F.lit("commitment").alias("kind"), F.substring("text", 1, 80).alias("subject"), severity.alias("severity"), F.when(late, F.abs("left")).otherwise(0).alias("days"), detail.alias("detail"))


def thread(threads: DataFrame, as_of: str, stale: int = 7) -> DataFrame:
    """Active threads (``title, status, current_state, updated_at``) that wait for something
    and have lain still."""
    age = days_between(at(as_of), F.col("updated_at"))
    own = threads.filter((F.col("status") == "active") & (age > stale) & like_some("current_state", WAITING)).withColumn("days", whole_days(at(as_of), F.col("updated_at")))
    severity = F.when(F.col("days") > 21, "critical").when(F.col("days") > 14, "high").otherwise("medium")
    return own.select(F.lit("thread").alias("kind"), F.col("title").alias("subject"), severity.alias("severity"), "days", F.substring("current_state", 1, 100).alias("detail"))


def project(profiles: DataFrame, staged: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Projects (``project, status``) that stall without a pending action; 999 days where
    nothing of them is known."""
    slow = profiles.filter(F.col("status").isin("stalling", "stalled"))
    slow = slow.join(staged.filter(F.col("status") == "pending").select("project").distinct(), "project", "left_anti")
    last = items.groupBy("project").agg(F.max("source_date").alias("last"))
    days = F.coalesce(F.round(days_between(at(as_of), F.col("last"))).cast("int"), F.lit(999))
    severity = F.when(F.col("status") == "stalled", "critical").otherwise("high")
    return slow.join(last, "project", "left").select(F.lit("project").alias("kind"), F.col("project").alias("subject"), severity.alias("severity"), days.alias("days"), F.concat("status", F.lit(" without an action")).alias("detail"))


def prediction(predictions: DataFrame, as_of: str) -> DataFrame:
    """Predictions (``subject, prediction, check_by, outcome``) whose check is past."""
    late = predictions.filter((F.col("outcome") == "pending") & (F.col("check_by") < at(as_of))).withColumn("days", whole_days(at(as_of), F.col("check_by")))
    return late.select(F.lit("prediction").alias("kind"), "subject", F.when(F.col("days") > 7, "high").otherwise("medium").alias("severity"), "days", F.substring("prediction", 1, 80).alias("detail"))


def in_order(*kinds: DataFrame) -> DataFrame:
    """All gaps, gravest first, then those of the longest time; ``place`` numbers them within
    a severity and age so that the order is fixed."""
    out = kinds[0]
    for rows in kinds[1:]:
        out = out.unionByName(rows)
    rank = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))[F.col("severity")]
    return out.orderBy(rank, F.desc("days"), "kind", "subject", "detail")


def summary(gaps: DataFrame) -> DataFrame:
    """Counts by severity and by kind: one row."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ORDER] + [F.count_if(F.col("kind") == k).alias(f"{k}_gaps") for k in KINDS]
    return gaps.agg(F.count("*").alias("total"), *counts)

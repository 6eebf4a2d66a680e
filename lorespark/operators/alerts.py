"""Commitments, alerts, gaps and other findings that ask for attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import ago, at, days_between, ordinal, since
from ..schema import OPEN_STATES, SEVERITY_ORDER

# What a completed promise's evidence reads like, what promises begin with, and
# words that tell nothing.
DONE_WORDS = ["sent", "completed", "done", "delivered", "submitted", "signed", "approved", "finalized", "confirmed", "scheduled"]
PROMISES = ["committed to", "will", "should", "needs to", "promised", "agreed", "going to", "plan to"]
STOP_WORDS = ["that", "this", "with", "from", "they", "have", "been", "would", "could", "about", "their", "some", "also"]


def overdue_days(as_of: str, due: str = "due_date") -> Column:
    return days_between(at(as_of), F.col(due))


def advance_states(commitments: DataFrame, as_of: str, nightly: bool = True, drop_after: int = 14) -> DataFrame:
    """Past due becomes overdue, and overdue long enough dropped; in that order."""
    late = F.col("due_date") < at(as_of)
    from_states = ["active", "detected"] if nightly else ["active"]
    one = F.when(F.col("state").isin(from_states) & late, "overdue").otherwise(F.col("state"))
    two = F.when((F.col("next") == "overdue") & (F.col("due_date") < ago(as_of, drop_after)), "dropped").otherwise(F.col("next"))
    return commitments.withColumn("next", one).withColumn("next", two)


def commitment_buckets(commitments: DataFrame, as_of: str, soon: int = 3) -> DataFrame:
    late = overdue_days(as_of)
    bucket = (
        F.when(F.col("state").isin(OPEN_STATES) & (late > 0), "fire")
        .when(F.col("state").isin(OPEN_STATES) & (late >= -soon), "due_soon")
        .when(F.col("state").isin(OPEN_STATES), "active")
        .when((F.col("state") == "fulfilled") & (late >= 0) & (late <= 7), "recently_fulfilled")
        .when(F.col("state") == "dropped", "dropped")
        .otherwise("closed")
    )
    return commitments.withColumn("bucket", bucket)


def commitment_alerts(commitments: DataFrame, as_of: str, soon: int = 3) -> DataFrame:
    """Overdue ones by how long, and those due soon."""
    late = overdue_days(as_of)
    open_ = commitments.filter(F.col("state").isin(OPEN_STATES) & F.col("due_date").isNotNull() & (late >= -soon))
    severity = F.when(late > 7, "high").when(late > 3, "medium").when(late > 0, "low").otherwise("medium")
    return open_.select("id", "owner", F.when(late > 0, "overdue").otherwise("due_soon").alias("kind"), F.floor(late).alias("days"), severity.alias("severity"))


def dropped_balls(threads: DataFrame, as_of: str, most: int = 45) -> DataFrame:
    """Waiting threads (``id, entity_id, waiting_since, average_gap, label,
    dismissed, contacted_since``) that have waited twice the usual time."""
    age = days_between(at(as_of), F.col("waiting_since"))
    wait = F.greatest(F.lit(3.0), 2 * F.coalesce("average_gap", F.lit(0.0)))
    due = threads.filter(~F.col("dismissed") & ~F.coalesce(F.col("label") == "employee", F.lit(False)) & ~F.col("contacted_since") & (age >= wait) & (age <= most))
    severity = F.when(age > 14, "high").when(age > 7, "medium").otherwise("low")
    confidence = 0.5 + F.when(F.col("label").isin("partner", "client"), 0.2).otherwise(0.0) + F.when(age > 14, 0.1).otherwise(0.0)
    return due.select("id", "entity_id", F.floor(age).alias("days"), severity.alias("severity"), F.round(confidence, 6).alias("confidence"))


def union_alerts(**families: DataFrame) -> DataFrame:
    """(family, id, severity, confidence) in one order: gravest and surest first."""
    out = None
    for family, rows in families.items():
        confidence = F.col("confidence") if "confidence" in rows.columns else F.lit(0.8)
        own = rows.select(F.lit(family).alias("family"), F.col("id").cast("string").alias("id"), "severity", confidence.cast("double").alias("confidence"))
        out = own if out is None else out.unionByName(own)
    return out.orderBy(ordinal("severity", SEVERITY_ORDER), F.desc("confidence"), "family", "id")


def silent_owners(commitments: DataFrame, mentions: DataFrame, as_of: str, silent: int = 7) -> DataFrame:
    """Open commitments (``id, entity_id``) whose owner hasn't been heard of."""
    last = mentions.groupBy("entity_id").agg(F.max("mention_date").alias("last"))
    days = days_between(at(as_of), F.col("last"))
    return commitments.join(last, "entity_id").filter(days > silent).groupBy("entity_id").agg(F.count("*").alias("open"), F.floor(F.max(days)).alias("days"))


def keywords(text: str | Column, most: int = 5) -> Column:
    """The first words of over three letters that say something, promises left out."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)\b(" + "|".join(PROMISES) + r")\b", ""), r"[^\w\s]", "")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(STOP_WORDS))
    return F.slice(words, 1, most)


def fulfilment_evidence(commitments: DataFrame, items: DataFrame, first: int = 30, newest: int = 5) -> DataFrame:
    """Of the open commitments that are due first, the evidence that they are done.

    For each keyword in turn, of the newest later items that have it in title or summary
    (as part of a word too), the newest that tells of completion or is sent mail.

    ``commitments``: id, text, state, due_date, detected_at; ``items``: item_id, title,
    summary, source, source_date."""
    from ..schema import OPEN_STATES as states

    open_ = commitments.filter(F.col("state").isin(states)).orderBy(F.asc_nulls_first("due_date"), "id").limit(first)
    since_ = F.coalesce("detected_at", "due_date", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).alias("since")
    wanted = open_.select("id", since_, F.posexplode(keywords("text")).alias("place", "word"))  # ``first`` times five rows at most
    said = F.concat_ws("\n", F.lower("title"), F.lower("summary"))
    met = items.select("item_id", "source", "source_date", said.alias("said")).join(F.broadcast(wanted), F.col("said").contains(F.lower("word")) & (F.col("source_date") > F.col("since")))
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("source_date"), "item_id"))
    late = met.withColumn("rank", rank).filter(F.col("rank") <= newest)
    done = (F.col("source") == "gmail-sent") | F.exists(F.array(*map(F.lit, DONE_WORDS)), lambda w: F.col("said").contains(w))
    best = late.filter(done).groupBy("id").agg(F.min(F.struct("place", "rank", "item_id")).alias("m"))
    return best.select("id", F.col("m.item_id").alias("evidence_id"))


def resolve_replies(items: DataFrame) -> DataFrame:
    """Clear the waiting tag of items whose thread has a later sent item.

    ``items``: id, thread, at, sent, tags."""
    sent = items.filter("sent").groupBy("thread").agg(F.max("at").alias("answered"))
    done = F.coalesce(F.col("answered") > F.col("at"), F.lit(False))
    return items.join(sent, "thread", "left").withColumn("tags", F.when(done, F.array_remove("tags", "awaiting_reply")).otherwise(F.col("tags"))).drop("answered")


def escalation_level(actions: DataFrame, as_of: str) -> DataFrame:
    """Levels at 24, 48 and 72 hours of waiting; snoozed ones stay; what isn't mail
    runs by itself from level 1."""
    hours = days_between(at(as_of), F.col("created_at")) * 24
    level = F.when(hours >= 72, 3).when(hours >= 48, 2).when(hours >= 24, 1).otherwise(0)
    snoozed = F.coalesce(F.col("snoozed_until") > at(as_of), F.lit(False))
    new = F.when(snoozed | (F.col("status") != "pending"), F.col("level")).otherwise(F.greatest("level", level))
    return actions.withColumn("next_level", new).withColumn("automatic", (F.col("next_level") >= 1) & (F.col("type") != "email") & (F.col("status") == "pending"))


def recent_triggers(items: DataFrame, key_entities: DataFrame, as_of: str, minutes: int = 20, k: int = 5) -> DataFrame:
    """The newest items of key entities in the last minutes."""
    own = items.filter(F.col("source_date") >= at(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE")).join(key_entities, "entity_id", "left_semi")
    return own.orderBy(F.desc("source_date"), "id").limit(k)


def expire_actions(actions: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    return actions.withColumn("status", F.when((F.col("status") == "pending") & (F.col("created_at") < ago(as_of, hours=hours)), "expired").otherwise(F.col("status")))


def waiting_importance(items: DataFrame, as_of: str) -> DataFrame:
    """Unanswered inbound items grow in importance with age."""
    days = days_between(at(as_of), F.col("source_date"))
    return items.withColumn("importance", F.when((F.col("direction") == "inbound") & (days > 30), "critical").when((F.col("direction") == "inbound") & (days > 14), "high").otherwise(F.col("importance")))


def urgent(commitments: DataFrame, as_of: str) -> DataFrame:
    """Due between 48 hours ago and 24 hours ahead."""
    return commitments.filter(F.col("state").isin("active", "overdue") & F.col("due_date").between(ago(as_of, hours=48), ago(as_of, hours=-24)))


def recent_by(items: DataFrame, as_of: str, days: int, column: str) -> DataFrame:
    return items.filter(since("source_date", as_of, days)).groupBy(column).agg(F.count("*").alias("n"))

"""Communication activity over time: statuses, momentum, baselines, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import ago, at, days_between, half_up, ordinal, since
from ..schema import TREND_ORDER


def status_bucket(days: Column) -> Column:
    """active to 3 days, warm to 7, cooling to 14, cold to 30, then dormant."""
    return F.when(days.isNull(), "unknown").when(days <= 3, "active").when(days <= 7, "warm").when(days <= 14, "cooling").when(days <= 30, "cold").otherwise("dormant")


def relationship_status(mentions: DataFrame, as_of: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Mentions, whole days since the last one, and the status."""
    last = mentions.groupBy(*keys).agg(F.count("*").alias("mentions"), F.max("mention_date").alias("last"))
    days = F.floor(days_between(at(as_of), F.col("last")))
    return last.select(*keys, "mentions", days.alias("days_since"), status_bucket(days).alias("status"))


def weekly_counts(mentions: DataFrame, as_of: str, keys: tuple[str, ...], weeks: int = 4) -> DataFrame:
    """Counts of the last weeks, ``w1`` the latest; each week holds its later bound's side."""
    own = mentions.filter(since("mention_date", as_of, 7 * weeks) & (F.col("mention_date") <= at(as_of)))
    week = lambda k: F.count_if((F.col("mention_date") >= ago(as_of, 7 * k)) & (F.col("mention_date") < ago(as_of, 7 * k - 7) if k > 1 else F.lit(True)))
    return own.groupBy(*keys).agg(*(week(k).alias(f"w{k}") for k in range(1, weeks + 1)))


def momentum(mentions: DataFrame, as_of: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """The trend of each key over the last weeks, strongest kinds first."""
    return trends(weekly_counts(mentions, as_of, keys), keys)


def trends(weekly: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Trends of counts ``w1`` to ``w4``."""
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    trend = (
        F.when((w1 == 0) & ((w2 > 0) | (w3 > 0)), "cold")
        .when((w1 > 0) & (w2 == 0) & (w3 == 0), "new_burst")
        .when((w1 > w2) & (w2 >= w3), "accelerating")
        .when((w1 < w2) & (w2 <= w3), "decelerating")
        .otherwise("steady")
    )
    weekly = weekly.filter("w1 + w2 + w3 + w4 > 0")
    return weekly.withColumn("trend", trend).orderBy(ordinal("trend", TREND_ORDER), (w1 + w2 + w3 + F.col("w4")).desc(), *keys)


def communication_baseline(mentions: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """30-day baseline, velocity and anomaly of every entity of ``least`` mentions."""
    month, week = since("mention_date", as_of, 30), since("mention_date", as_of, 7)
    own = mentions.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.max("mention_date").alias("last"), F.count_if(month).alias("month"), F.count_if(week).alias("week"),
        F.count_if(month & (F.col("direction") == "inbound")).alias("inbound"),
        F.min(F.when(month, F.col("mention_date"))).alias("first_in"), F.max(F.when(month, F.col("mention_date"))).alias("last_in"),
    ).filter(F.col("n") >= least)
    return judged(own, as_of)


def judged(own: DataFrame, as_of: str) -> DataFrame:
    """Rates, velocity and anomaly of baselines (``n, last, month, week, inbound, first_in,
    last_in``)."""
    rate = F.col("month") / 4.3
    gap = F.when(F.col("month") > 1, days_between(F.col("last_in"), F.col("first_in")) / (F.col("month") - 1)).otherwise(0.0)
    silent = F.coalesce(days_between(at(as_of), F.col("last")), F.lit(999.0))
    velocity = F.when(rate > 0, F.col("week") / rate).when(F.col("week") > 0, 2.0).otherwise(0.0)
    kind = F.when(
        rate >= 1,
        F.when((velocity < 0.3) & (silent > gap * 2), "decelerating").when(velocity > 2.5, "surge").when((silent > 14) & (rate >= 2), "silent"),
    ).when((F.col("n") >= 5) & (silent > 30), "silent")
    severity = (
        F.when(F.col("anomaly") == "decelerating", F.when(silent > gap * 3, "high").otherwise("medium"))
        .when(F.col("anomaly") == "surge", F.when(velocity > 4, "high").otherwise("medium"))
        .when((F.col("anomaly") == "silent") & (rate >= 1), F.when(silent > 21, "high").otherwise("medium"))
        .when(F.col("anomaly") == "silent", "low")
    )
    return own.withColumn("anomaly", kind).select(
        "entity_id", F.col("n").alias("mentions"), half_up(rate, 1).alias("per_week"), half_up(gap, 1).alias("average_gap"),
        half_up(F.col("inbound") / F.greatest(F.col("month"), F.lit(1)), 2).alias("inbound_ratio"), half_up(silent, 1).alias("days_silent"),
        half_up(velocity, 2).alias("velocity"), "anomaly", severity.alias("severity"),
    )


def frequency_anomalies(mentions: DataFrame, as_of: str, keys: tuple[str, ...] = ("entity_id",), top: int = 10) -> DataFrame:
    """Keys whose last week is out of line with the three before."""
    last = F.count_if(since("mention_date", as_of, 7)).alias("last_week")
    before = F.count_if(since("mention_date", as_of, 28) & ~since("mention_date", as_of, 7)).alias("before")
    ratio = F.col("last_week") / F.nullif(F.col("before") / 3.0, F.lit(0.0))
    out = mentions.groupBy(*keys).agg(last, before).filter("before >= 3").withColumn("ratio", ratio)
    odd = out.filter((F.col("last_week") == 0) | (F.col("ratio") >= 3))
    return odd.orderBy(F.abs(F.col("ratio") - 1).desc(), *keys).limit(top).select(*keys, "last_week", "before", F.round("ratio", 6).alias("ratio"))


def average_gap(mentions: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Mean days between consecutive mentions; 0 for a single one."""
    earlier = F.lag("mention_date").over(Window.partitionBy(*keys).orderBy("mention_date"))
    gaps = mentions.withColumn("gap", days_between(F.col("mention_date"), earlier))
    return gaps.groupBy(*keys).agg(F.count("*").alias("mentions"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("average_gap"))


def living_profile(mentions: DataFrame, commitments: DataFrame, as_of: str) -> DataFrame:
    """Week against prior weeks, health, and the risk rules that hold.

    ``commitments``: entity_id, n_open, n_overdue."""
    own = mentions.groupBy("entity_id").agg(
        F.count_if(since("mention_date", as_of, 7)).alias("week"),
        F.count_if(since("mention_date", as_of, 28) & ~since("mention_date", as_of, 7)).alias("before"),
        F.max("mention_date").alias("last"),
    )
    ratio, days = F.col("week") / F.greatest(F.col("before") / 3, F.lit(1.0)), F.floor(days_between(at(as_of), F.col("last")))
    full = own.join(commitments, "entity_id", "left").fillna(0, ["n_open", "n_overdue"])
    trend = F.when(ratio > 2, "surging").when(ratio >= 0.5, "active").when(ratio >= 0.25, "cooling").otherwise("cold")
    risks = F.array_compact(
        F.array(
            F.when(ratio > 3, "surge"), F.when((ratio < 0.25) & (F.col("before") > 3), "drop"),
            F.when(F.col("n_overdue") > 0, "overdue"), F.when((days > 14) & (F.col("n_open") > 0), "silent"),
        )
    )
    health = F.least(F.lit(100), half_up(ratio * 100).cast("long"))
    return full.select("entity_id", "week", "before", trend.alias("trend"), health.alias("health"), days.alias("days_since"), F.array_join(risks, ",").alias("risks"))


def top_entities(mentions: DataFrame, entities: DataFrame, as_of: str, top: int = 20, days: int = 30) -> DataFrame:
    """The most mentioned entities of the last days, dismissed ones aside."""
    recent = mentions.filter(since("mention_date", as_of, days)).groupBy("entity_id").agg(F.count("*").alias("mentions"), F.max("mention_date").alias("last"))
    named = recent.join(entities.filter(~F.col("dismissed")), F.col("entity_id") == F.col("id"))
    ranked = named.orderBy(F.desc("mentions"), "entity_id").limit(top)
    return ranked.select("entity_id", "name", "label", "mentions", status_bucket(F.floor(days_between(at(as_of), F.col("last")))).alias("status"))


def cold_relationships(mentions: DataFrame, entities: DataFrame, as_of: str, least: int = 5, silent: int = 14, window: int = 30) -> DataFrame:
    """Entities with a history and nothing lately, surest first."""
    own = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.count_if(since("mention_date", as_of, window)).alias("recent"), F.max("mention_date").alias("last"))
    days = F.floor(days_between(at(as_of), F.col("last")))
    important = F.coalesce(F.col("label").isin("partner", "client"), F.lit(False))
    named = own.join(entities.filter(~F.col("dismissed")), F.col("entity_id") == F.col("id"))
    cold = named.filter((F.col("mentions") >= least) & (F.col("recent") == 0) & (days > silent) & (important | (F.col("mentions") >= 10)))
    confidence = 0.5 + F.when(important, 0.2).otherwise(0.0) + F.when(F.col("mentions") >= 10, 0.1).otherwise(0.0)
    return cold.select("entity_id", "name", "mentions", days.alias("days_since"), F.round(confidence, 6).alias("confidence"))


def stale_projects(items: DataFrame, active: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Projects called active of which nothing has come lately."""
    return active.join(items.filter(since("source_date", as_of, days)).select("project").distinct(), "project", "left_anti")


def multi_project_entities(items: DataFrame, as_of: str, least: int = 2, days: int = 30, top: int = 15) -> DataFrame:
    """Entities that connect projects."""
    own = items.filter(since("source_date", as_of, days)).groupBy("entity_id").agg(F.countDistinct("project").alias("n_projects"), F.count("*").alias("mentions"), F.array_join(F.sort_array(F.collect_set("project")), ",").alias("projects"))
    return own.filter(F.col("n_projects") >= least).orderBy(F.desc("n_projects"), F.desc("mentions"), "entity_id").limit(top)


def pileups(dates: DataFrame, least_day: int = 3, join_days: int = 3, least_window: int = 5) -> DataFrame:
    """Days with ``least_day`` or more due rows, merged into windows across gaps of
    up to ``join_days``; windows of at least ``least_window`` rows."""
    days = dates.groupBy("day").agg(F.count("*").alias("n")).filter(F.col("n") >= least_day)
    order = Window.partitionBy(F.year("day")).orderBy("day")  # windows end with the year
    begins = F.when(F.datediff("day", F.lag("day").over(order)) <= join_days, 0).otherwise(1)
    islands = days.withColumn("begin", begins).withColumn("island", F.sum("begin").over(order))
    out = islands.groupBy(F.year("day").alias("year"), "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("total"))
    return out.filter(F.col("total") >= least_window).select("first_day", "last_day", "total")


def date_overlaps(commitments: DataFrame, days: int = 7) -> DataFrame:
    """Pairs of projects with due dates at most ``days`` apart, nearest pair each.

    A project's commitments of one day are one row with their number and least id: all
    pairs of two days have one gap, and the first of them is that of the least ids.  The
    range join is an equi-join on date buckets: each row of one side goes to its own
    bucket and both neighbours."""
    c = commitments.filter("due_date is not null AND project is not null").groupBy("project", F.to_date("due_date").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    c = c.withColumn("bucket", F.floor(F.unix_date("day") / days))
    other = c.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("project").alias("project2"), F.col("day").alias("day2"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    gap = F.abs(F.datediff("day", "day2"))
    pairs = c.join(other, "bucket").filter((F.col("project") < F.col("project2")) & (gap <= days))
    best = pairs.groupBy("project", "project2").agg(F.sum(F.col("n") * F.col("n2")).alias("pairs"), F.min(F.struct(gap.alias("gap"), "id", "id2")).alias("b"))
    return best.select("project", "project2", "pairs", "b.gap", "b.id", "b.id2")


def project_pipeline(items: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Each project's week against the one before, people, and share of all items."""
    week, prior = since("source_date", as_of, 7), since("source_date", as_of, 14) & ~since("source_date", as_of, 7)
    own = items.groupBy("project").agg(F.count("*").alias("items"), F.count_if(week).alias("week"), F.count_if(prior).alias("prior"), F.countDistinct("entity_id").alias("people"))
    trend = F.when(F.col("week") > F.col("prior") * 1.5, "accelerating").when((F.col("week") > 0) & (F.col("week") >= F.col("prior") * 0.5), "steady").when(F.col("week") > 0, "decelerating").otherwise("stalled")
    total = own.agg(F.sum("items").alias("total"))
    return own.crossJoin(F.broadcast(total)).filter(F.col("items") >= least).select("project", "items", "week", "prior", "people", trend.alias("trend"), half_up(100 * F.col("items") / F.col("total")).alias("share"))


def anomalies(baseline: DataFrame, severity: str | None = None) -> DataFrame:
    """Entities whose communication departs from its baseline, of one severity if named."""
    own = baseline.filter(F.col("anomaly").isNotNull())
    return own if severity is None else own.filter(F.col("severity") == severity)

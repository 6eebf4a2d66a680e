"""Counts and rollups over items, contacts, projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import at, days_between, half_up
from ..schema import DERIVED_SOURCES, IMPORTANCE_ORDER
from .activity import status_bucket


def primary(items: DataFrame) -> DataFrame:
    """Observed rows; a row without a source counts as observed."""
    return items.filter(F.col("source").isNull() | ~F.col("source").isin(DERIVED_SOURCES))


def derived(items: DataFrame) -> DataFrame:
    """Exactly the rows that ``primary`` leaves."""
    return items.filter(F.col("source").isin(DERIVED_SOURCES))


def counts_by(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("n"))


def select_where(items: DataFrame, **wanted: object) -> DataFrame:
    """A conjunct for each option given; a list means any of its values."""
    for column, value in wanted.items():
        if value is not None:
            items = items.filter(F.col(column).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(column) == F.lit(value))
    return items


def lookup(items: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The items of many keys at once."""
    return items.join(keys.select(*on).distinct(), on, "left_semi")


def with_bare_columns(rows: DataFrame, keys: list[str], bare: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by key, with columns that the key determines."""
    return rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in bare), *aggregates)


def contact_rollup(items: DataFrame, contact: str = "entity_id") -> DataFrame:
    """Mentions and sources of each contact."""
    return items.groupBy(contact).agg(F.count("*").alias("mentions"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.countDistinct("project").alias("n_projects"))


def project_rollup(items: DataFrame) -> DataFrame:
    """Items, last date and the gravest importance of each project."""
    rank = F.create_map(*(F.lit(x) for kv in IMPORTANCE_ORDER.items() for x in kv))
    own = items.filter(F.col("project").isNotNull()).withColumn("_rank", F.coalesce(rank[F.col("importance")], F.lit(len(IMPORTANCE_ORDER))))
    return own.groupBy("project").agg(F.count("*").alias("items"), F.max("source_date").alias("last"), F.min(F.struct("_rank", "importance")).alias("m")).select("project", "items", "last", F.col("m.importance").alias("importance"))


def relationship_health(items: DataFrame, as_of: str, least: int = 2, contact: str = "entity_id") -> DataFrame:
    own = items.groupBy(contact).agg(F.count("*").alias("mentions"), F.max("source_date").alias("last"), F.countDistinct("source").alias("n_sources"), F.countDistinct("project").alias("n_projects")).filter(F.col("mentions") >= least)
    days = F.floor(days_between(at(as_of), F.col("last")))
    return own.select(contact, "mentions", "n_sources", "n_projects", days.alias("days_since"), status_bucket(days).alias("status"))


def mode_by(items: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value of each key; ties by value."""
    n = items.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(column))).alias("m")).select(key, F.col(f"m.{column}").alias(column), (-F.col("m.neg")).alias("n"))


def share_of_total(items: DataFrame, column: str) -> DataFrame:
    n = counts_by(items, column)
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", half_up(100 * F.col("n") / F.col("total")).cast("long").alias("percent"))  # total is one row


def accuracy(outcomes: DataFrame) -> DataFrame:
    """(correct + half of partial) over what was verified."""
    right, partial, wrong = (F.count_if(F.col("outcome") == x) for x in ("correct", "partial", "wrong"))
    return outcomes.agg(right.alias("correct"), partial.alias("partial"), wrong.alias("wrong"), F.round((right + 0.5 * partial) / F.nullif(right + partial + wrong, F.lit(0)), 6).alias("accuracy"))


def duplicate_groups(rows: DataFrame, keys: Sequence[str | Column], ident: str = "id") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).filter("n > 1")


def common_contacts(members: DataFrame, share: float = 0.3) -> DataFrame:
    """Contacts with their items, those in more than ``share`` of all items flagged."""
    total = members.agg(F.countDistinct("item_id").alias("items"))
    n = members.groupBy("entity_id").agg(F.countDistinct("item_id").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("entity_id", "n", (F.col("n") > share * F.col("items")).alias("common"))  # total is one row


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Numbered; a bounded sort a group, which Spark cuts before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Version numbers by time, and the latest flagged."""
    own = Window.partitionBy(key)
    return rows.withColumn("version", F.row_number().over(own.orderBy(order)).cast("long")).withColumn("is_latest", F.col("version") == F.max("version").over(own))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; columns that ``new`` lacks
    or leaves null keep their old values."""
    kept = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return o.join(n, on, "full_outer").select(*(F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys), *(pick(c).alias(c) for c in kept))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def as_current(rows: DataFrame) -> DataFrame:
    """Rows whose validity is open."""
    return rows.filter(F.col("valid_until").isNull())


def supersede(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Close each row at the next one's time (slowly changing dimension)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("valid_from", F.col(order)).withColumn("valid_until", F.lead(order).over(w)).withColumn("superseded_by", F.lead("id").over(w))


# Day tables: what moving windows are merged from.


def daily(mentions: DataFrame) -> DataFrame:
    """(entity_id, role, direction, day, n, first, last, items): counts, bounds and a
    mergeable sketch of distinct items.  Days of several loads add up when they are read."""
    day = F.to_date("mention_date").alias("day")
    return mentions.groupBy("entity_id", "role", "direction", day).agg(F.count("*").alias("n"), F.min("mention_date").alias("first"), F.max("mention_date").alias("last"), F.hll_sketch_agg("item_id", F.lit(14)).alias("items"))


def _midnight(as_of: str) -> str:
    if not as_of.endswith("00:00:00"):
        raise ValueError(f"windows of days end at midnight, not at {as_of}")
    return as_of[:10]


def _last(as_of: str, days: int) -> Column:
    """The days before a midnight."""
    end = F.lit(_midnight(as_of)).cast("date")
    return (F.col("day") >= F.date_sub(end, days)) & (F.col("day") < end)


def weekly_from_days(days: DataFrame, as_of: str, keys: tuple[str, ...], weeks: int = 4) -> DataFrame:
    """``w1`` (the latest) and so on, as from the mentions before that midnight."""
    week = lambda k: F.sum(F.when(_last(as_of, 7 * k) & ~_last(as_of, 7 * k - 7), F.col("n")).otherwise(0)).alias(f"w{k}")
    return days.filter(_last(as_of, 7 * weeks)).groupBy(*keys).agg(*map(week, range(1, weeks + 1)))


def baseline_from_days(days: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Baselines of 30 and 7 days of every entity of ``least`` mentions."""
    month, week = _last(as_of, 30), _last(as_of, 7)
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    own = days.groupBy("entity_id").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), total(month).alias("month"), total(week).alias("week"), total(month & (F.col("direction") == "inbound")).alias("inbound"),
        F.min(F.when(month, F.col("first"))).alias("first_in"), F.max(F.when(month, F.col("last"))).alias("last_in"),
    )
    return own.filter(F.col("n") >= least)


def window_from_days(days: DataFrame, as_of: str, width: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mentions, items, days) of a window of days; items by merged sketches."""
    own = days.filter(_last(as_of, width)).groupBy(*keys)
    return own.agg(F.sum("n").alias("mentions"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items"), F.countDistinct("day").alias("days"))

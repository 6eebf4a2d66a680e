"""Queries of streams with states and timers, run over logs that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.fixtures import NOW, Tables
from ..streaming import processors, stateful
from .catalog import query

_T = f"TIMESTAMP '{NOW}'"


def _log(rows: DataFrame, name: str, by: str, files: int, last: DataFrame | None = None) -> DataFrame:
    """A stream of the rows, written as so many files (read together: those of one time have
    no order), and then of ``last``."""
    path = scratch(rows.sparkSession, name)
    rows.repartitionByRange(files, by).sortWithinPartitions(by).write.parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    return processors.events(rows.sparkSession, path, rows.schema, 1_000)


_ACTIONS = f"""actions AS (SELECT event_id AS id, ts AS began, CASE WHEN event_id % 2 = 0 THEN 'email' ELSE 'call' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 30 HOUR END AS closed, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 20 HOUR END AS snoozed, ts + INTERVAL 60 HOUR AS until
  FROM events WHERE event_type = 'click' AND ts >= {_T} - INTERVAL 5 DAY AND value >= 20)"""


@query(
    "Z5",
    f"""
WITH {_ACTIONS}, e AS (SELECT *, least({_T}, coalesce(closed, {_T})) AS stop FROM actions),
h AS (SELECT *, epoch_us(CASE WHEN snoozed <= stop AND until > stop THEN snoozed ELSE stop END) - epoch_us(began) AS waited FROM e)
SELECT id, (waited >= 86400000000)::INTEGER + (waited >= 172800000000)::INTEGER + (waited >= 259200000000)::INTEGER AS level, kind <> 'email' AND waited >= 86400000000 AS automatic FROM h""",
)
def escalated_actions(t: Tables) -> DataFrame:
    """The level that each action has reached, from a stream with snoozes and timers."""
    picked = t.read("events").filter((F.col("event_type") == "click") & (F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAY")) & (F.col("value") >= 20))
    kind = F.when(F.col("event_id") % 2 == 0, "email").otherwise("call").alias("kind")
    none = F.lit(None).cast("timestamp")
    at = F.col("ts").cast("timestamp")
    row = lambda rows, when, status, until=none: rows.select(F.col("event_id").alias("id"), when.alias("at"), F.lit(status).alias("status"), until.alias("until"), kind)
    hours = lambda n: at + F.expr(f"INTERVAL {n} HOUR")
    log = row(picked, at, "pending").unionByName(row(picked.filter("event_id % 3 = 0"), hours(20), "snoozed", hours(60))).unionByName(row(picked.filter("event_id % 5 = 0"), hours(30), "done"))
    end = F.lit(NOW).cast("timestamp")
    # files of one time may come in any order: rows wait for five days, and the clock goes on for as long
    clock = t.spark.range(1).select(F.lit(-1).cast("long").alias("id"), (end + F.expr("INTERVAL 5 DAY")).alias("at"), F.lit("pending").alias("status"), none.alias("until"), F.lit("email").alias("kind"))
    found = stateful.drained(stateful.escalate(_log(log.filter(F.col("at") <= end), "actions", "at", 3, clock), "5 days"), scratch(t.spark, "escalated"))
    return found.filter("id >= 0").groupBy("id").agg(F.max("level").alias("level"), F.max("automatic").alias("automatic"))


@query(
    "Z9",
    f"""
WITH r AS (SELECT 'ctx' || (conv_id % 10) AS key, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((conv_id // 10) * 25 + turn * 3)::INTEGER) AS asked, role = 'assistant' AS is_put, conv_id * 100 + turn AS request, md5(text) AS value FROM conversations),
p AS (SELECT key, asked, max_by(value, request) AS value FROM r WHERE is_put GROUP BY ALL)
SELECT r.key, request, coalesce(epoch_us(r.asked) - epoch_us(p.asked) <= 1200000000, false) AS hit, CASE WHEN epoch_us(r.asked) - epoch_us(p.asked) <= 1200000000 THEN p.value END AS value
FROM r ASOF LEFT JOIN p ON r.key = p.key AND r.asked >= p.asked WHERE NOT is_put""",
)
def answered_from_cache(t: Tables) -> DataFrame:
    """Requests and whether a context of the last 20 minutes answers them."""
    c = t.read("conversations")
    minutes = ((F.floor(F.col("conv_id") / 10)) * 25 + F.col("turn") * 3).cast("int")
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("at")
    rows = c.select(F.concat(F.lit("Ctx"), (F.col("conv_id") % 10).cast("string")).alias("key"), at, (F.col("role") == "assistant").alias("is_put"), (F.col("conv_id") * 100 + F.col("turn")).alias("request"), F.md5(F.col("text").cast("binary")).alias("value"))
    found = stateful.drained(stateful.answer_from_cache(_log(rows, "requests", "at", 3), 20, "1 hour"), scratch(t.spark, "answered"))
    return found.select("key", "request", "hit", "value")

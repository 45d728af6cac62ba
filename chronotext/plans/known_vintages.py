"""Queries of problem 1: calendar events with the newest published observation of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators.known_at import for_every_entity, known_at
from chronotext.session import table


def plain_number(value: Column) -> Column:
    """The trimmed text if it is a plain decimal number, else null ('.', 'NA', blanks)."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), trimmed)


def calendar_events(calendar: DataFrame) -> DataFrame:
    """(event_type, day): the distinct non-null meeting and blackout days."""
    return (
        calendar.select("meeting_date", "blackout_date")
        .unpivot([], ["meeting_date", "blackout_date"], "event_type", "day")
        .filter(F.col("day").isNotNull())
        .distinct()
    )


def known_vintages(calendar: DataFrame, obs: DataFrame) -> DataFrame:
    """For each event and series the newest period published by that day; events before any publication are left out.

    Values that are no plain number, and rows without series, obs_date or realtime_start, are never known. Ties in
    obs_date and realtime_start go to the smallest obs_id.
    """
    usable = obs.select(
        "series", "obs_id", "obs_date", "realtime_start", plain_number(F.col("value")).cast("double").alias("number"),
        F.greatest(F.col("obs_date").cast("date"), F.col("realtime_start").cast("date")).alias("available"),
    ).filter(F.col("number").isNotNull() & F.col("obs_date").isNotNull() & F.col("realtime_start").isNotNull() & F.col("series").isNotNull())
    events = for_every_entity(usable.select("series").distinct(), calendar_events(calendar))
    known = known_at(
        events, usable, ["series"], "day", "available",
        [F.col("obs_date"), F.col("realtime_start"), -F.col("obs_id")], ["obs_id", "obs_date", "realtime_start", "number"],
    )
    return known.filter(F.col("known_obs_id").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_vintages(table(spark, sf_dir, "fomc_calendar"), table(spark, sf_dir, "vintage_obs"))
    return known.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("event_date"), "series", F.col("known_obs_id").alias("obs_id"))


def p1_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: how many series are known, how old the newest period is, and the largest known value."""
    known = known_vintages(table(spark, sf_dir, "fomc_calendar"), table(spark, sf_dir, "vintage_obs"))
    return known.groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("event_date")).agg(
        F.count("*").alias("n_series"),
        F.min(F.datediff("day", "known_obs_date")).cast("bigint").alias("youngest_days"),
        F.max("known_number").alias("max_value"),
    )


QUERIES = {"p1_found": p1_found, "p1_panel": p1_panel}

_KNOWN = """
WITH ev AS (
  SELECT DISTINCT 'meeting_date' AS event_type, meeting_date AS day FROM fomc_calendar WHERE meeting_date IS NOT NULL
  UNION
  SELECT DISTINCT 'blackout_date', blackout_date FROM fomc_calendar WHERE blackout_date IS NOT NULL),
ob AS (
  SELECT *, CAST(regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS number FROM vintage_obs
  WHERE regexp_full_match(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')),
best AS (
  SELECT event_type, day, series, obs_id, obs_date, number,
    row_number() OVER (PARTITION BY event_type, day, series ORDER BY obs_date DESC, realtime_start DESC, obs_id) AS rn
  FROM ev JOIN ob ON ob.obs_date <= ev.day AND CAST(ob.realtime_start AS DATE) <= ev.day)
"""
ORACLES = {
    "p1_found": _KNOWN + "SELECT event_type, strftime(day, '%Y-%m-%d') AS event_date, series, obs_id FROM best WHERE rn = 1",
    "p1_panel": _KNOWN + """SELECT event_type, strftime(day, '%Y-%m-%d') AS event_date, count(*) AS n_series,
  CAST(min(date_diff('day', obs_date, day)) AS BIGINT) AS youngest_days, max(number) AS max_value
FROM best WHERE rn = 1 GROUP BY 1, 2""",
}

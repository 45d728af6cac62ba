"""Attributes as known at event time.

Events and attribute changes are brought into one stream, ordered by entity and time of availability (at equal times
changes come before events), and the best version known so far is carried forward. A change is never seen by an event
before its availability.

Scale: changes are first reduced on the map side to one row per entity and time of availability. The scan is cut into
spans of `span_days`, so that a hot entity is spread over many tasks; what was known at the start of each span comes
from a scan over one small row per entity and span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of one calendar block that are replicated to every entity; a longer calendar is worked off in blocks.
CALENDAR_BLOCK = 10_000


def known_at(
    events: DataFrame,
    changes: DataFrame,
    entity: Sequence[str],
    event_time: str,
    available: str,
    version: Sequence[Column],
    payload: Sequence[str],
    span_days: int = 366,
    inclusive: bool = True,
    salts: int = 1,
) -> DataFrame:
    """Each event with the payload of the best version among the changes available by its time (inclusive).

    entity: key columns present in both inputs. event_time, available: DATE, TIMESTAMP or LONG (microseconds)
    columns of the same type. inclusive: a change at the very time of an event is known to it. salts: events of
    one entity and span are spread over so many tasks, each with a copy of the (reduced) changes; for few, very hot
    entities.
    version: expressions over `changes`; the largest tuple wins, compared in order. payload: columns of `changes` to
    return, renamed `known_<name>`, so that clashing names of the two sides never meet.

    Nulls: an event without time or entity, or without any change available, keeps null payloads; a change without
    entity or time of availability is never known. Repeated events stay repeated; repeated changes count once.
    """
    keys = [f"__k{i}" for i in range(len(entity))]
    picked = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(version)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    if changes.schema[available].dataType.simpleString() == "bigint":
        span = F.floor(F.col("__t") / (span_days * 86_400_000_000))
    else:
        span = F.floor(F.datediff(F.col("__t").cast("date"), F.lit("1970-01-01").cast("date")) / span_days)
    best = (
        changes.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(available).alias("__t"), picked.alias("__v"))
        .dropna(subset=[*keys, "__t"])
        .groupBy(*keys, "__t")
        .agg(F.max("__v").alias("__v"))
        .withColumn("__span", span)
    )
    kind = best.schema["__v"].dataType
    row = F.struct(*[F.col(c) for c in events.columns])
    asked = events.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(event_time).alias("__t"), row.alias("__e")).withColumn("__span", span)
    event_kind = asked.schema["__e"].dataType
    spans = best.groupBy(*keys, "__span").agg(F.max("__v").alias("__v")).unionByName(
        asked.dropna(subset=[*keys, "__t"]).select(*keys, "__span", F.lit(None).cast(kind).alias("__v")).distinct()
    ).groupBy(*keys, "__span").agg(F.max("__v").alias("__v"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "__span", F.lit(None).cast(best.schema["__t"].dataType).alias("__t"), F.lit(0).alias("__prio"), F.max("__v").over(before).alias("__v"), F.lit(None).cast(event_kind).alias("__e"))
    changes_known = carried.unionByName(best.select("*", F.lit(1 if inclusive else 3).alias("__prio"), F.lit(None).cast(event_kind).alias("__e")))
    asked = asked.select("*", F.lit(2).alias("__prio"), F.lit(None).cast(kind).alias("__v"))
    if salts > 1:
        changes_known = changes_known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.withColumn("__salt", F.pmod(F.xxhash64("__e"), F.lit(salts)).cast("int"))
    else:
        changes_known, asked = changes_known.withColumn("__salt", F.lit(0)), asked.withColumn("__salt", F.lit(0))
    stream = changes_known.unionByName(asked)
    sofar = Window.partitionBy(*keys, "__span", "__salt").orderBy(F.col("__t").asc_nulls_first(), "__prio").rowsBetween(Window.unboundedPreceding, 0)
    known = stream.withColumn("__known", F.max("__v").over(sofar)).filter(F.col("__prio") == 2)
    asked_ok = F.col("__t").isNotNull()
    for k in keys:
        asked_ok = asked_ok & F.col(k).isNotNull()
    return known.select("__e.*", *[F.when(asked_ok, F.col(f"__known.p{i}")).alias(f"known_{c}") for i, c in enumerate(payload)])


def for_every_entity(entities: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every entity with every event of a calendar (a stated, small query set), block by block.

    The calendar is read to the driver in blocks of CALENDAR_BLOCK rows and exploded beside each entity, so that no
    cross join is planned. A calendar of more than a thousand blocks is refused.
    """
    rows = calendar.distinct().limit(1000 * CALENDAR_BLOCK + 1).collect()
    if len(rows) > 1000 * CALENDAR_BLOCK:
        raise ValueError("the calendar is too long to be asked for every entity")
    spark, out = entities.sparkSession, None
    for at in range(0, max(1, len(rows)), CALENDAR_BLOCK):
        block = spark.createDataFrame(rows[at : at + CALENDAR_BLOCK], calendar.schema).agg(F.collect_list(F.struct(*calendar.columns)).alias("a"))
        kind = block.schema["a"].dataType.simpleString()
        text = block.select(F.to_json("a")).first()[0] or "[]"
        part = entities.select("*", F.explode(F.from_json(F.lit(text), kind)).alias("__c")).select(*entities.columns, "__c.*")
        out = part if out is None else out.unionByName(part)
    return out

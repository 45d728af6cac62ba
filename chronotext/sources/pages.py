"""Texts and tables of saved pages: statements by page layout, minutes by paragraph, projection tables as histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the body of a page stands, in order of preference, and what ends it.
CONTAINERS = [r'<div[^>]*class="col-xs-12 col-sm-8 col-md-8"[^>]*>', r'<div[^>]*id="content"[^>]*>', r'<div[^>]*class="article"[^>]*>', r'<div[^>]*id="leftText"[^>]*>', r"<body[^>]*>"]
BODIES = [r"(?is)For (?:immediate )?release\s*(.*?)(?:Last Update|Board of Governors|Home\s*\||\z)", r"(?is)FEDERAL RESERVE\s+press release\s*(.*?)(?:Last Update|\z)"]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&mdash;", " -- "), ("&ndash;", "-"), (" ", " "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')]
LONGER_RUN = r"(?i)longer.run|long run|\blr\b"
LEAST_BODY, LEAST_PARAGRAPH = 100, 40


def bare_text(html: Column) -> Column:
    """Without scripts, styles, menus, feet and tags; entities as characters, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)[^>]*>.*?</\1>", " ")
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(t, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_body(html: Column, least: int = LEAST_BODY) -> Column:
    """The body of a statement page: of the first container that exists, the part after the release line if it is longer than
    `least` characters, else the whole text if that is; else null."""
    inside = F.coalesce(*[F.nullif(F.regexp_extract(html, f"(?is){c}(.*)$", 1), F.lit("")) for c in CONTAINERS], html)
    text = bare_text(inside)
    parts = [F.trim(F.regexp_extract(text, p, 1)) for p in BODIES]
    return F.coalesce(*[F.when(F.length(p) > least, p) for p in (*parts, text)])


def minutes_paragraphs(html: Column, least: int = LEAST_PARAGRAPH) -> Column:
    """Texts of paragraphs longer than `least` characters, with plain quotes and blanks."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), bare_text), lambda x: F.length(x) > least)


def table_cells(table: Column) -> Column:
    """Array of rows, each an array of cell texts."""
    return F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), bare_text))


def level(label: Column) -> Column:
    """The middle of '4-1/4 to 4-1/2', '5.25 to 5.50' or '0 to 1/4'; a single number is itself."""
    numbers = F.regexp_extract_all(label, F.lit(r"(\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"), F.lit(1))
    fraction = lambda x: F.split_part(x, F.lit("/"), F.lit(1)).cast("double") / F.split_part(x, F.lit("/"), F.lit(2)).cast("double")
    value = lambda x: F.when(F.contains(x, F.lit("-")), F.split_part(x, F.lit("-"), F.lit(1)).cast("double") + fraction(F.split_part(x, F.lit("-"), F.lit(2)))).when(F.contains(x, F.lit("/")), fraction(x)).otherwise(x.try_cast("double"))
    return F.try_divide(F.aggregate(F.transform(numbers, value), F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(numbers), F.lit(0)))


def projections(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, year, level, n): how many projections each level of each year has, by the header row of years (lr: longer run).

    Tables that name no rate, cells that are no number and rows before any header give nothing.
    """
    tables = pages.select(id_, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "t")).filter(F.col("t").rlike(r"(?i)funds rate|federal funds|\bffr\b|0 to|0\.25 to"))
    year_of = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"\b(20[123]\d)\b", 1), F.lit("")), F.when(c.rlike(LONGER_RUN), "lr"))
    rows = tables.select(id_, "table", F.posexplode(table_cells(F.col("t"))).alias("at", "cells")).withColumn("years", F.transform(F.slice("cells", 2, 1000), year_of))
    rows = rows.withColumn("head", F.exists("years", lambda y: y.isNotNull()) & F.col("cells")[0].rlike(r"^\D*$"))
    data = rows.filter(~F.col("head") & (F.size("cells") > 1)).select(id_, "table", "at", level(F.col("cells")[0]).alias("level"), F.slice("cells", 2, 1000).alias("counts"))
    heads = rows.filter("head").groupBy(id_, "table").agg(F.min_by("years", "at").alias("years"))
    cells = data.join(heads, [id_, "table"]).select(id_, "level", F.explode(F.arrays_zip("years", "counts")).alias("x"))
    return cells.select(id_, F.col("x.years").alias("year"), "level", F.regexp_extract("x.counts", r"^(\d+)$", 1).try_cast("long").alias("n")).filter("year IS NOT NULL AND level IS NOT NULL AND n > 0").groupBy(id_, "year", "level").agg(F.sum("n").alias("n"))


def projection_statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    """Median, quartiles, range, Bowley skew and tails of each histogram (level, n)."""
    p = lambda q: F.percentile("level", F.lit(q), F.col("n"))
    s = cells.groupBy(*by).agg(F.sum("n").alias("n"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.min("level").alias("low"), F.max("level").alias("high")).withColumn("iqr", F.col("p75") - F.col("p25"))
    return s.withColumns({"bowley": F.when(F.col("iqr") > 0, (F.col("p75") + F.col("p25") - 2 * F.col("median")) / F.col("iqr")).otherwise(0.0), "tail_asymmetry": F.col("high") - 2 * F.col("median") + F.col("low")})


def with_spreads(df: DataFrame) -> DataFrame:
    """ct_spread, full_spread and outlier_pull, where the columns they need exist."""
    have = set(df.columns)
    if {"ct_high", "ct_low"} <= have:
        df = df.withColumn("ct_spread", F.col("ct_high") - F.col("ct_low"))
    if {"range_high", "range_low"} <= have:
        df = df.withColumn("full_spread", F.col("range_high") - F.col("range_low"))
    return df.withColumn("outlier_pull", F.col("full_spread") - F.col("ct_spread")) if {"ct_spread", "full_spread"} <= set(df.columns) else df


def projection_line(line: Column) -> dict[str, Column]:
    """The numbers of a text line of projections: medians before ranges ('1.5-2.0' or '1.5 to 2.0')."""
    ranges = F.regexp_extract_all(line, F.lit(r"(-?\d+\.\d+\s*(?:to|[-–])\s*-?\d+\.\d+)"), F.lit(1))
    rest = F.regexp_replace(line, r"-?\d+\.\d+\s*(?:to|[-–])\s*-?\d+\.\d+", " ")
    return {"medians": F.transform(F.regexp_extract_all(rest, F.lit(r"(-?\d+\.\d+)"), F.lit(1)), lambda x: x.cast("double")), "ranges": F.transform(ranges, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"((?<![\d.])-?\d+\.\d+)"), F.lit(1)), lambda y: y.cast("double")))}

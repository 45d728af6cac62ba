"""Dates and years of texts in several formats, and names of categories in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_date(text: Column) -> Column:
    """DATE of a text in one of the known formats, null for null, blank and unreadable ones."""
    s = F.trim(text)
    read = lambda fmt: F.to_date(F.try_to_timestamp(s, F.lit(fmt)))
    return (
        F.when(s.rlike(r"^\d{8}$"), read("yyyyMMdd"))
        .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), F.to_date(F.try_to_timestamp(F.regexp_extract(s, r"^(\S{8,10}?)([ T]|$)", 1), F.lit("yyyy-M-d"))))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), read("yyyy/M/d"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), read("M/d/yyyy"))
        .when(s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), read("d.M.yyyy"))
        .when(s.rlike(r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"), read("MMMM d, yyyy"))
        .when(s.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.coalesce(read("MMM d, yyyy"), read("MMMM d, yyyy")))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), read("d MMMM yyyy"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.coalesce(read("d MMM yyyy"), read("d MMMM yyyy")))
    )


def any_year(text: Column) -> Column:
    """The year of a date in a known format or of four digits, else the first year from 1900 to 2099 that stands by itself."""
    s = F.trim(text)
    year = lambda fmt: F.year(F.try_to_timestamp(F.substring(s, 1, 19), F.lit(fmt)))
    read = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.coalesce(year("yyyy-M-d H:m:s"), year("yyyy-M-d"))).when(s.rlike(r"^\d{8}$"), year("yyyyMMdd")).when(s.rlike(r"^\d{4}$"), s.try_cast("int"))
    return F.when(F.lower(s) != "unknown", F.coalesce(read, F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")))


def category_name(text: Column) -> Column:
    """Trimmed, in lower case, with _ for blanks and hyphens; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), r"[\s-]", "_"), F.lit(""))

"""Scans of the file shapes the pipelines start from. Schemas are explicit; nothing is inferred from the data but CSV headers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.dates import any_year

RECORD = "id string, sentence string, source string, doc_type string, date string, context_question string, top string, ten string, sen string, hor string, com string, ris string, wid string"
DOCUMENT = "date string, source string, title string, text string, content array<string>, contents string, prepared_remarks string, qa_session string, word_count int"


def dated_csv(spark: SparkSession, path: str, dates: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV with header; unnamed index columns dropped, `dates` as DATE (unreadable: null), other columns as text."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c and not c.startswith(("Unnamed", "_c"))])
    return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c))) for c in dates if c in df.columns})


def month_year(text: Column, this_year: int) -> Column:
    """'Jan-68' to the first of the month; years in the future are of the century before."""
    d = F.to_date(F.try_to_timestamp(text, F.lit("MMM-yy")))
    return F.when(F.year(d) > this_year, F.add_months(d, -1200)).otherwise(d)


def positional_csv(spark: SparkSession, path: str, this_year: int, sep: str = ";", date_at: int = 0, value_at: int = 2) -> DataFrame:
    """(day, value) by position from a file without a trusted header; rows without a date or number are left out, the last of a day stays."""
    df = spark.read.option("sep", sep).option("header", False).csv(path)
    few = df.select(month_year(F.col(df.columns[date_at]), this_year).alias("day"), F.col(df.columns[value_at]).try_cast("double").alias("value"), F.monotonically_increasing_id().alias("at")).filter("day IS NOT NULL AND value IS NOT NULL")
    return few.groupBy("day").agg(F.max_by("value", "at").alias("value"))


def topics_of(text: Column) -> Column:
    """A list given as JSON, as a quoted Python list or as one bare name; null and empty give an empty list."""
    t = F.trim(text)
    listed = F.from_json(F.regexp_replace(t, "'", '"'), "array<string>")
    return F.when(t.isNull() | t.isin("", "[]"), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(t)))


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def label_records(spark: SparkSession, path: str) -> DataFrame:
    """A directory of JSON arrays of label records; topics and flags of any spelling made uniform."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path).withColumns({"top": topics_of(F.col("top")), "hor": truth(F.col("hor"))})


def documents(spark: SparkSession, path: str, least: int = 50, one_per_day: bool = True) -> DataFrame:
    """(file, kind, date, source, text) of JSON documents; the text is the first of text, content, contents, remarks.

    kind: the name of the file's folder (speaker types). Texts of `least` characters or fewer are left out. one_per_day:
    of one folder and date the last file by name stays, the way a mapping by date keeps it.
    """
    df = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    remarks = F.when(F.trim("prepared_remarks").startswith("["), F.array_join(F.from_json("prepared_remarks", "array<string>"), " ")).otherwise(F.col("prepared_remarks"))
    text = F.coalesce("text", F.array_join("content", "\n\n"), "contents", remarks)
    df = df.select("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("kind"), "date", "source", text.alias("text")).filter(F.length("text") > least)
    if not one_per_day:
        return df
    return df.groupBy("kind", "date").agg(F.max_by(F.struct("file", "source", "text"), "file").alias("x")).select("x.file", "kind", "date", "x.source", "x.text")


def dated_texts(spark: SparkSession, path: str) -> DataFrame:
    """(day, text) of whole text files named YYYY-MM-DD.txt or with eight figures; others are left out."""
    df = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    name = F.regexp_extract("file", r"(\d{4})-?(\d{2})-?(\d{2})[^/]*$", 0)
    return df.select(F.to_date(F.try_to_timestamp(F.regexp_replace(F.substring(F.regexp_replace(name, "-", ""), 1, 8), r"\D", ""), F.lit("yyyyMMdd"))).alias("day"), F.col("value").alias("text")).filter("day is not null")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(series, date, realtime_start, value) of long observation files; '.' is null."""
    df = spark.read.schema("series string, date date, realtime_start date, value string").option("multiLine", True).json(path)
    return df.withColumn("value", F.nullif(F.trim("value"), F.lit(".")).try_cast("double"))


def corpus(spark: SparkSession, paths: Mapping[str, str], after_year: int = 2006) -> DataFrame:
    """(doc_type, file, kind, date, source, text) of the folders of each type, documents of later years only; every file counts.

    A document without a readable year or text is left out. A source without a name is named by its file.
    """
    parts = [documents(spark, path, 0, one_per_day=False).withColumn("doc_type", F.lit(kind)) for kind, path in paths.items()]
    all_ = reduce(lambda a, b: a.unionByName(b), parts)
    named = F.coalesce("source", F.regexp_extract("file", r"([^/]+)$", 1))
    return all_.filter(any_year(F.col("date")) > after_year).select("doc_type", "file", "kind", "date", named.alias("source"), "text")


def dated_index(spark: SparkSession, path: str) -> DataFrame:
    """(day, files) of the files whose name has eight figures that are a date; all files of a day, by name. Contents are not read."""
    names = spark.read.format("binaryFile").load(path).select("path")
    day = F.to_date(F.try_to_timestamp(F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), r"(\d{8})", 1), F.lit("yyyyMMdd")))
    return names.withColumn("day", day).filter("day IS NOT NULL").groupBy("day").agg(F.array_sort(F.collect_list("path")).alias("files"))


def first_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """The first field that exists and is not blank."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in fields if c in df.columns], F.lit(None).cast("string"))


#: Document sources by name: (folder, meetings by which their scores come later).
SOURCES = {"statements": ("structured_json_statements", 0), "minutes": ("structured_json_minutes", 1), "speeches": ("structured_json_speeches", 0), "press_conferences": ("structured_json", 0)}


def from_registry(spark: SparkSession, root: str, name: str, registry: Mapping[str, tuple[str, int]] = SOURCES) -> tuple[DataFrame, int]:
    """(documents, lag) of a registered source; an unknown name is refused."""
    if name not in registry:
        raise ValueError(f"no such source: {name}")
    folder, lag = registry[name]
    return documents(spark, f"{root}/{folder}"), lag

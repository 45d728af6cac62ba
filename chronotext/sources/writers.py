"""Sinks: overwrite to a new place, append, resume, batches, JSON, logs, reports, and an atomic swap on any file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path` if it was completely written, else computed, written and read."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not at `path` yet; returns how many. A rerun after a failure adds the rest."""
    try:
        left = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = rows
    before = left.count()
    left.write.mode("append").parquet(path)
    return before


def numbered(rows: DataFrame, by: str, order: str, size: int = 15) -> DataFrame:
    """rows with `batch`, from 1, of `size` rows in the order within each group."""
    return rows.withColumn("batch", F.ceil(F.row_number().over(Window.partitionBy(by).orderBy(order)) / size))


def batches(rows: DataFrame, path: str, by: str, order: str, size: int = 15) -> None:
    """Files of `size` rows per group, as folders by group and batch."""
    numbered(rows, by, order, size).write.mode("overwrite").partitionBy(by, "batch").json(path)


def swap(rows: DataFrame, path: str) -> None:
    """Replace the table at a path by rows that may be read from it: staged beside it, then renamed by the file system of the path.

    Where renaming is no single step (object stores), or readers must never miss the table, use `publish`.
    """
    fs, at = _files(rows.sparkSession, path)
    rows.write.mode("overwrite").parquet(f"{path}.staged")
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.staged"), at(path))
    fs.delete(at(f"{path}.old"), True)


def publish(rows: DataFrame, path: str) -> str:
    """Replace the versioned table at `path` by rows that may be read from it; returns the folder of the new version.

    A version is a folder of its own, and the small file CURRENT names the one that counts; it is written last. So no
    reader sees half a table, whatever the file system, and nothing is renamed. Earlier versions but the last go.
    """
    spark = rows.sparkSession
    fs, at = _files(spark, path)
    version = f"v{_number(current(spark, path)) + 1}"
    rows.write.mode("overwrite").parquet(f"{path}/{version}")
    out = fs.create(at(f"{path}/CURRENT"), True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    for s in fs.listStatus(at(path)):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < _number(version) - 1:
            fs.delete(s.getPath(), True)
    return f"{path}/{version}"


def _number(version: str | None) -> int:
    return int(version[1:]) if version else 0


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The version that counts at a published path, None before the first."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/CURRENT")):
        return None
    stream = fs.open(at(f"{path}/CURRENT"))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)}")


def json_array(rows: DataFrame, path: str) -> None:
    """One file that holds all rows as a JSON array, for small results: written by one task, never by the driver."""
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    first = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) == 1
    marked = lines.coalesce(1).select(F.concat(F.when(first, "[").otherwise(","), "value").alias("value"))
    end = rows.sparkSession.range(1).select(F.lit("]").alias("value"))
    start = lines.limit(1).count() == 0
    body = marked if not start else rows.sparkSession.range(1).select(F.lit("[").alias("value"))
    body.withColumn("o", F.lit(0)).unionByName(end.withColumn("o", F.lit(1))).coalesce(1).select("value").write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows below those of earlier runs, as CSV with one header per file; columns are those of the first run."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def markdown(rows: DataFrame, title: str, most: int = 50) -> str:
    """A small table as markdown, at most `most` rows in their order."""
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect()]) + "\n"

"""Incremental runs: high-water marks, and the same work as a stream of what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.joins import pending
from quarry.sources.tables import new_rows


def high_water(cursor: DataFrame, name: str, table: str) -> int:
    """The largest row of a cursor, 0 if it has none."""
    row = cursor.where((F.col("name") == name) & (F.col("table") == table)).agg(F.coalesce(F.max("row"), F.lit(0))).first()
    return row[0]


def checkpoints(cursor: DataFrame, name: str | None = None) -> DataFrame:
    """The log's entries, all or those of one run's name, the furthest first."""
    rows = cursor if name is None else cursor.where(F.col("name") == name)
    return rows.orderBy("name", "table", F.desc("row"))


def checkpoint(cursor: DataFrame, name: str, table: str):
    """The furthest entry of a run on a table with its comments, None if there is none."""
    return cursor.where((F.col("name") == name) & (F.col("table") == table)).orderBy(F.desc("row")).first()


def high_waters(cursor: DataFrame) -> DataFrame:
    return cursor.groupBy("name", "table").agg(F.max("row").alias("row"))


def advanced(cursor: DataFrame, name: str, table: str, row: int, comments: dict[str, str] | None = None) -> DataFrame:
    """The row to append to the cursor log; an older mark than the present one is kept in the log all the same."""
    spark = cursor.sparkSession
    return spark.createDataFrame([(name, table, row, comments or {})], "name string, `table` string, row long, comments map<string,string>")


def run_once(
    candidates: DataFrame,
    done: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    key: str = "id",
    done_key: str | None = None,
    last: int = 0,
    limit: int | None = None,
    mode: str = "continue",
) -> tuple[DataFrame, int]:
    """What ``work`` makes of the candidates beyond the mark that aren't done, and the new mark.

    mode: ``continue`` from the mark; ``redo`` from the start; ``remove`` as redo, nothing
    counting as done.
    """
    if mode not in ("continue", "redo", "remove"):
        raise ValueError(f"unknown mode {mode!r}")
    start = last if mode == "continue" else 0
    reached = candidates.where(F.col(key) > start)
    reached = reached if limit is None else reached.orderBy(key).limit(limit)
    mark = reached.agg(F.coalesce(F.max(key), F.lit(start))).first()[0]
    over = done.limit(0) if mode == "remove" else done
    return work(pending(candidates, over, key, start, limit, done_key)), mark


def stream_new(
    spark: SparkSession,
    source: str,
    schema,
    target: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame],
    key: list[str],
    files_per_batch: int | None = None,
):
    """Work through the files that have arrived in ``source`` and append what is new by key to ``target``.

    Returns the query; it ends when all that is there has been worked on. A batch that is
    run again appends nothing twice, as its keys are there by then.
    """

    def batch(rows: DataFrame, number: int) -> None:
        made = work(rows)
        # only a folder that isn't there counts as empty: any other failure ends the batch, which then runs again
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        there = spark.read.schema(made.schema).parquet(target) if exists else spark.createDataFrame([], made.schema)
        new_rows(made, there, key).write.mode("append").parquet(target)

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and group; on a stream, late rows beyond the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def observed(rows: DataFrame, name: str, passed) -> DataFrame:
    """rows whose run reports how many there were and how many passed."""
    return rows.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(passed).alias("passed"))

"""Streaming: retention roll-ups of data points, running corpus counts, and upserts of changed passages.

Every sink is idempotent: a batch that runs again writes the same files under the same names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemloom.operators import corpus as C
from stemloom.scratch import Scratch


@dataclass(frozen=True)
class Retention:
    """Metrics whose name the pattern finds keep a point for each ``step`` seconds; the first match counts."""

    pattern: str
    step: int


def step_of(name: str, rules: tuple[Retention, ...]) -> Column:
    out = None
    for r in rules:
        re.compile(r.pattern)
        hit = F.col(name).rlike(r.pattern)
        out = F.when(hit, F.lit(r.step)) if out is None else out.when(hit, F.lit(r.step))
    return out


def rollup(points: DataFrame, rules: tuple[Retention, ...], late: str = "5 hours", state: bool = True) -> DataFrame:
    """(name, ts, total, n, last) of each metric and step of points (name, time timestamp, value).

    As a stream, points later than ``late`` behind the newest are dropped and their steps forgotten."""
    d = points.withWatermark("time", late) if state else points
    ts = F.unix_timestamp("time")
    d = d.withColumn("step", step_of("name", rules).cast("long")).where("step IS NOT NULL")
    window = F.window("time", f"{max(r.step for r in rules)} seconds")
    got = d.groupBy(window.alias("w"), "name", (ts - F.pmod(ts, F.col("step"))).alias("ts")).agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.max_by("value", "time").alias("last"))
    return got.drop("w")


def run_updates(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Run a stream over what there is now, in update mode, and give the newest row of each key."""
    out, marks = scratch.path(name), scratch.path(f"{name}-marks")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    q = df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = df.schema.add("batch", "long")
    got = scratch.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return got.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """A table as a stream that takes at most ``files`` files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A table may be a file or a folder of files.
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def corpus_counts(stream: DataFrame) -> DataFrame:
    """Running count of every form of documents that arrive."""
    return C.tokens(C.segments(stream)).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def upsert_batches(stream: DataFrame, keys: list[str], path: str, marks: str) -> None:
    """Keep the table at ``path`` up to date with rows that arrive: each batch replaces rows of equal keys.

    Versions are written side by side; a batch that runs again replaces its own version."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in batch.columns if c not in keys))
        fresh = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        merged = fresh if number == 0 else spark.read.parquet(f"{path}/v{number - 1}").join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def apply_changes(stream: DataFrame, keys: list[str], version: str, deleted: str, path: str, marks: str) -> DataFrame:
    """The table that a stream of changes leaves: of each key the row of the highest version, unless that deletes it.

    Deleted keys stay in the files, so that an older change that comes late does not bring them back. A batch
    writes its own version of the table from the one before it: one that fails and runs again
    writes the same files, and changes that come twice change nothing."""
    spark, schema, done = stream.sparkSession, stream.schema, []
    whole = F.struct(version, *(F.col(c) for c in stream.columns if c not in (version, *keys)))

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch if number == 0 else spark.read.schema(schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        rows.groupBy(*keys).agg(F.max(whole).alias("x")).select(*keys, "x.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        done.append(number)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/v{max(done)}") if done else spark.createDataFrame([], schema)
    return rows.where(~F.col(deleted)).drop(deleted)

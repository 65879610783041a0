"""Streams over the driver's tables, run over what there is and given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.plans.series_queries import epoch
from stemloom.plans.text_queries import with_tokens
from stemloom.scratch import Scratch
from stemloom.streaming import jobs

RULES = (jobs.Retention(r"^ev\.click\.", 1800), jobs.Retention(r"^ev\.p", 3600), jobs.Retention("", 7200))


def _points(events: DataFrame) -> DataFrame:
    name = F.concat(F.lit("ev."), F.col("event_type"), F.lit(".u"), (F.col("user_id") % 4).cast("string"))
    return events.select(name.alias("name"), F.timestamp_seconds(epoch("ts")).alias("time"), F.col("value").cast("decimal(18,2)").alias("value"))


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = jobs.rollup(_points(jobs.stream_table(spark, sf, "events")), RULES)
    got = jobs.run_updates(d, ["name", "ts"], Scratch(spark, "rollup"), "points")
    return got.select("name", "ts", F.col("total").cast("double").alias("total"), "n")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_updates(jobs.corpus_counts(jobs.stream_table(spark, sf, "documents")), ["form"], Scratch(spark, "counts"), "terms")


_STEP = "CASE WHEN event_type = 'click' THEN 1800 WHEN starts_with(event_type, 'p') THEN 3600 ELSE 7200 END"
QUERIES = {"stream_retention_rollup": _rollup, "stream_corpus_counts": _counts}
SQL = {
    "stream_retention_rollup": f"SELECT 'ev.' || event_type || '.u' || (user_id % 4) AS name, (floor(epoch(ts))::BIGINT // {_STEP} * {_STEP})::BIGINT AS ts, sum(value::DECIMAL(18,2))::DOUBLE AS total, count(value) AS n FROM events GROUP BY 1, 2",
    "stream_corpus_counts": with_tokens("SELECT form, count(*) AS n FROM tok GROUP BY form"),
}

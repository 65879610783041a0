"""Writers: passages by volume, frequency dumps, and rendered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.operators import series as S


def replace_passages(passages: DataFrame, path: str) -> None:
    """Replace the passages of the volumes that ``passages`` has, and of no others: one folder a volume."""
    passages.repartition("volume_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id").parquet(path)


def dump_frequencies(counts: DataFrame, path: str) -> None:
    """"# count: <terms>", then term TAB count, most frequent first; files in order of their names."""
    rows = counts.select(F.lit(1).alias("k"), "n", "term", F.concat("term", F.lit("\t"), F.col("n").cast("string")).alias("value"))
    head = counts.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("k"), "n", F.lit("").alias("term"), F.concat(F.lit("# count: "), F.col("n").cast("string")).alias("value"))
    head.unionByName(rows).orderBy("k", F.desc("n"), "term").select("value").write.mode("overwrite").text(path)


def write_series(df: DataFrame, path: str, form: str = "csv") -> None:
    if form == "csv":
        S.series_csv(df).write.mode("overwrite").csv(path)
    elif form in ("json", "raw"):
        lines = (S.series_json if form == "json" else S.series_raw)(df).orderBy("ord")
        lines.select(lines.columns[1]).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").parquet(path)

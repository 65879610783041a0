"""Readers of text files, manifests, lexicons and stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemloom.operators import corpus as C

REQUIRED = ("language", "author", "title", "volumes")
OPTIONAL = ("online_source_name", "online_source_link", "print_source_name", "print_source_link")
WORKS = "language string, author string, title string, " + ", ".join(f"{c} string" for c in OPTIONAL) + ", volumes array<struct<name:string,path:string>>"


def read_tess(spark: SparkSession, path: str, sentences: bool = False) -> DataFrame:
    """Passages of ``.tess`` files: (file, n, text, line), or sentences as (file, s, sentence, start, end).

    A file is read by one task, whole lines in order; many files make many tasks."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"[\n\r]+")).alias("n", "value"))
    lines = raw.select(F.struct("file", F.col("n").alias("at")).alias("n"), "value")
    d = C.tess_lines(lines).select("n.file", F.col("n.at").alias("n"), "text", "line")
    return C.sentences(d, "file") if sentences else d


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Works of a YAML manifest, one a document; those marked ``skip`` or without ``auto_ingest`` stay out."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a manifest is a short file
    rows = []
    for doc in yaml.safe_load_all(text):
        if doc is None:
            continue
        missing = [k for k in REQUIRED if not doc.get(k)]
        if missing:
            raise ValueError(f"{path}: {', '.join(missing)} missing")
        if flag(doc.get("skip", False)) or not flag(doc.get("auto_ingest", True)):
            continue
        clean = lambda k: (str(doc[k]).strip() or None) if doc.get(k) is not None else None
        volumes = [(v["name"], v["path"]) for v in doc["volumes"] if not flag(v.get("skip", False))]
        rows.append((doc["language"].lower(), doc["author"], doc["title"], *(clean(k) for k in OPTIONAL), volumes))
    return spark.createDataFrame(rows, WORKS)


def flag(value: object) -> bool:
    low = str(value).strip().lower()
    if low in ("true", "t", "yes", "y", "1"):
        return True
    if low in ("false", "f", "no", "n", "0"):
        return False
    raise ValueError(f"not a boolean: {value!r}")


def read_lexicon(spark: SparkSession, path: str, how: str = "full") -> DataFrame:
    """(key, stems) of a CSV of token, part of speech and stem; another number of columns is an error."""
    rows = spark.read.schema("token string, pos string, stem string").option("escape", "\\").option("mode", "FAILFAST").csv(path)
    return C.build_lexicon(rows, how)


def unpivot_sources(wide: DataFrame, names: list[str]) -> DataFrame:
    """(name, ts, value) of a table with a column for each data source; the last row, still being filled, is dropped."""
    last = Window.partitionBy("file").orderBy(F.desc("ts"))
    done = wide.withColumn("_r", F.row_number().over(last)).where("_r > 1").drop("_r")
    return done.unpivot(["file", "ts"], names, "source", "value").select(F.concat_ws(".", "file", "source").alias("name"), "ts", "value")

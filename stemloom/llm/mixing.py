"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Tokens are summed by cell (source, language, topic). The cells' weights are raked: scaled to one
margin's targets after another until all margins fit. A cell's ratio of raked to present tokens,
times one factor for the whole corpus, is the probability with which each of its documents is kept.
Only sums by cell are exchanged, so a source with a third of all rows is one row a task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: Targets are each value's share of the tokens to this power, normalised: rare values gain.
TEMPERATURE = 0.7
#: The share of the corpus's tokens that is to be kept.
KEEP = 0.5
ROUNDS, ROUNDS_A_TABLE, CLOSE = 30, 3, 1e-9
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def form_topic(text: Column) -> Column:
    """A topic where the table has none: the form of the text."""
    words = F.regexp_count(text, F.lit(WORD))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(words < 50, "short").when(words >= 1000, "long").otherwise("prose")


def _shares(cells: DataFrame, margin: str, temperature: float) -> DataFrame:
    by = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    total = by.agg(F.sum(F.pow("t", F.lit(temperature)))).first()[0]
    return by.select(F.col(margin).alias("m"), (F.pow("t", F.lit(temperature)) / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``cells`` (the margins, ``tokens``) with ``w``: weights that sum to each margin's target shares.

    targets: for each margin (m, share); a null value is a value. A value without a target keeps
    the weight that the other margins give it no claim to: zero. Stops when no share is off by
    ``close``, or after ``rounds`` rounds; then a warning tells by how much the worst share is off."""
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        w = w.join(target.select(F.col("m").alias(f"m_{margin}"), F.col("share").alias(f"share_{margin}")), F.col(margin).eqNullSafe(F.col(f"m_{margin}")), "left").drop(f"m_{margin}")
    w = scratch.write(w.fillna(0.0, [f"share_{m}" for m in targets]), "raked-0")
    done, worst = 0, 0.0
    while done < rounds:
        n = min(ROUNDS_A_TABLE, rounds - done)
        for _ in range(n):
            for margin in targets:
                now = F.sum("w").over(Window.partitionBy(margin))
                w = w.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"share_{margin}") / now).otherwise(0.0))
        done += n
        w = scratch.write(w, f"raked-{done}")
        off = [w.groupBy(m).agg(F.abs(F.sum("w") - F.first(f"share_{m}")).alias("off")).agg(F.max("off")).first()[0] for m in targets]
        worst = max((x or 0.0) for x in off)
        if worst < close:
            break
    else:
        warnings.warn(f"margins are off by up to {worst:.3g} after {rounds} rounds", stacklevel=2)
    return w


def probabilities(raked: DataFrame, keep: float, scratch: Scratch) -> DataFrame:
    """Cells with ``probability``: proportional to w / tokens, at most 1, so that ``keep`` of all tokens are expected.

    Cells at 1 are found in order of their ratio: with those before a cell at 1, the factor for the
    rest follows from sums; the first cell that it leaves below 1 settles it. The running sums are
    over cells, of which there are as many as combinations of values, not documents."""
    r = raked.where("tokens > 0 AND w > 0").select(*MARGINS, "tokens", "w", (F.col("w") / F.col("tokens")).alias("ratio"))
    before = Window.orderBy(F.desc("ratio"), *(F.col(m).asc_nulls_first() for m in MARGINS)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    s = r.select("*", F.coalesce(F.sum("tokens").over(before).cast("double"), zero).alias("t0"), F.coalesce(F.sum("w").over(before), zero).alias("w0"))
    all_tokens, all_weight = raked.agg(F.sum("tokens").cast("double"), F.sum("w")).first()
    s = s.withColumn("factor", (F.lit(keep * (all_tokens or 0.0)) - F.col("t0")) / (F.lit(all_weight or 0.0) - F.col("w0")))
    factor = s.where("factor > 0 AND factor * ratio <= 1").agg(F.max_by("factor", "ratio")).first()[0]
    p = F.least(F.lit(1.0), F.lit(float("inf") if factor is None else factor) * F.col("w") / F.col("tokens"))
    return scratch.write(raked.select(*MARGINS, "tokens", "w", F.when(F.col("tokens") > 0, p).otherwise(1.0).alias("probability")), "cells")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """Every document as ``_row`` with ``_topic``, ``_tokens`` (its words), ``_weight`` (raked over present
    share of its cell), ``_probability`` and ``_sampled``.

    docs: doc_id, source, lang, text. Null sources, languages and topics are values of their own;
    a null text has no words. Cells without words are kept (probability 1: nothing is gained by
    leaving them out). Rows of equal ids are kept or left out together. Ties in ratio are ordered by the cell's
    values. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"),
                    (form_topic(text) if topic is None else topic).cast("string").alias("_topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"))
    names = dict(zip(MARGINS, ("_source", "_lang", "_topic")))
    cells = scratch.write(d.groupBy(*(F.col(c).alias(m) for m, c in names.items())).agg(F.sum("_tokens").alias("tokens")), "sums")
    shares = targets or {m: scratch.write(_shares(cells, m, temperature), f"target-{m}") for m in MARGINS}
    p = probabilities(rake(cells, shares, scratch), keep, scratch)
    every = F.lit(p.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
    p = p.select(*MARGINS, F.when(F.col("tokens") > 0, F.col("w") / (F.col("tokens") / every)).otherwise(1.0).alias("_weight"), F.col("probability").alias("_probability"))
    same = [F.col(c).eqNullSafe(F.col(m)) for m, c in names.items()]
    joined = d.join(p, same[0] & same[1] & same[2])  # Spark broadcasts the cells while they are few
    return joined.select("_row", "_topic", "_tokens", "_weight", "_probability", (uniform(F.col("_row.doc_id"), seed) < F.col("_probability")).alias("_sampled"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents of the sample, with their own columns."""
    return mix(docs, **options).where("_sampled").select("_row.*")


def mixing_query(spark, sf_dir: str) -> DataFrame:
    d = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return d.select("_row.doc_id", "_row.source", "_row.lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def mixing_sql(rounds: int = ROUNDS, keep: float = KEEP, temperature: float = TEMPERATURE) -> str:
    out = [rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
  contains(coalesce(text, ''), ' | ') AS bars FROM documents),
t AS MATERIALIZED (SELECT *, CASE WHEN bars THEN 'table' WHEN n_tokens < 50 THEN 'short' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY ALL)"""]
    for m in MARGINS:
        out.append(f"s_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens), {temperature}) AS p FROM c GROUP BY {m})")
    shares = ", ".join(f"(SELECT p FROM s_{m} s WHERE s.{m} IS NOT DISTINCT FROM c.{m}) / (SELECT sum(p) FROM s_{m}) AS share_{m}" for m in MARGINS)
    out.append(f"w0 AS MATERIALIZED (SELECT *, tokens AS w, {shares} FROM c)")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            out.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * share_{m} / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w) FROM w{n})")
            n += 1
    order = "ORDER BY w / tokens DESC, source NULLS FIRST, lang NULLS FIRST, topic NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    out.append(f"""r AS MATERIALIZED (SELECT w / tokens AS ratio, ({keep} * (SELECT sum(tokens) FROM c) - coalesce(sum(tokens) OVER ({order}), 0))
  / ((SELECT sum(w) FROM w{n}) - coalesce(sum(w) OVER ({order}), 0)) AS factor FROM w{n} WHERE tokens > 0 AND w > 0),
f AS MATERIALIZED (SELECT max_by(factor, ratio) AS factor FROM r WHERE factor > 0 AND factor * ratio <= 1),
p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / (tokens / (SELECT sum(tokens) FROM c)) ELSE 1 END AS weight,
  CASE WHEN tokens > 0 THEN least(1, (SELECT factor FROM f) * w / tokens) ELSE 1 END AS probability FROM w{n})""")
    return ",\n".join(out) + f"""
SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS sampled
FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source AND t.lang IS NOT DISTINCT FROM p.lang AND t.topic IS NOT DISTINCT FROM p.topic"""

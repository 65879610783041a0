"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from stemloom.plans import more_queries, series_queries, stream_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = text_queries.QUERIES | series_queries.QUERIES | stream_queries.QUERIES | more_queries.QUERIES
SQL = text_queries.SQL | series_queries.SQL | stream_queries.SQL | more_queries.SQL
SOME = ("compare_freq", "compare_span", "compare_userstop", "stem_frequencies", "lexicon_merge", "lexicon_lookup", "roman_numerals", "sentence_segments", "tess_lines", "index_search", "hash_ring", "quantize",
        "ts_sumSeries", "ts_keepLastValue", "ts_movingMedian", "ts_hitcount", "ts_smartSummarize", "ts_timeStack", "ts_useSeriesAbove", "ts_highestMax", "ts_nPercentile", "merge_cache", "glob_find", "stream_retention_rollup", "stream_corpus_counts",
        "compare_itself", "compare_fields", "ts_stacked_targets", "ts_areaBetween", "ts_holtWintersAberration", "ts_cactiStyle", *more_queries.QUERIES)


def shown(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    a, b = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(tuple(map(shown, r)) for r in d[cols].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "sdoc", "tdoc", "score", "distance", "terms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(s, str) for s in entry.oracle_sql().values())


def test_outputs_render_every_series_and_hour(spark):
    import json
    from collections import defaultdict

    from stemloom.plans import series_queries as Q

    sums = defaultdict(float)
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "user_id", "value", Q.epoch("ts").alias("t")).collect():
        if r.value is not None:
            sums[f"ev.{r.event_type}.u{r.user_id % 4}", r.t - r.t % 3600] += r.value
    names = sorted({n for n, _ in sums})
    hours = range(Q.START, Q.END, 3600)
    got = [json.loads(r.json) for r in Q.QUERIES["json_output"](spark, "/root/testdata/sf0.001").orderBy("ord").collect()]
    assert [g["target"] for g in got] == names
    for g in got:
        assert [t for _, t in g["datapoints"]] == list(hours)
        assert all((v is None) == ((g["target"], t) not in sums) and (v is None or abs(v - sums[g["target"], t]) < 1e-5) for v, t in g["datapoints"])
    lines = [r.line for r in Q.QUERIES["raw_output"](spark, "/root/testdata/sf0.001").orderBy("ord").collect()]
    assert [x.split("|")[0] for x in lines] == [f"{n},{Q.START},{Q.END},3600" for n in names]
    for n, x in zip(names, lines):
        values = x.split("|")[1].split(",")
        assert len(values) == len(hours)
        assert all((v == "None") == ((n, t) not in sums) and (v == "None" or abs(float(v) - sums[n, t]) < 1e-5) for v, t in zip(values, hours))

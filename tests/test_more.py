"""Analyzers, searches, drawing, sinks and change streams by hand."""

import os

import pytest
from pyspark.sql import functions as F

from stemloom.functions import analysis as A
from stemloom.functions import text as T
from stemloom.operators import corpus, drawing, finding
from stemloom.operators import series as S
from stemloom.sources import sinks
from stemloom.streaming import jobs


def frame(spark, *rows, start=0, step=10):
    """Series of the given values, in order."""
    data = [(o, f"s{o}", f"s{o}", start, start + step * len(v), step, "average", {}, start + step * i, x) for o, v in enumerate(rows) for i, x in enumerate(v)]
    return spark.createDataFrame(data, "ord long, name string, path string, start long, end long, step long, consolidate string, options map<string,string>, ts long, value double")


def test_analyzers(spark):
    d = spark.createDataFrame([("The Vivus xiv, jam IV",), (None,), ("",)], "t string")
    one = A.query_analyzer(("the",), {"jam": ("iam", "nunc")})
    got = [r.x and [tuple(t) for t in r.x] for r in d.select(one(F.col("t")).alias("x")).collect()]
    assert got == [[(1, "vivus"), (2, "14"), (3, "iam"), (3, "nunc"), (4, "4")], None, []]
    with pytest.raises(ValueError):
        A.replace_characters("ab", "c")
    shown = d.limit(1).select(A.Analyzer(A.whitespace_tokenizer, (A.replace_characters("Vx", " y"),))(F.col("t")).alias("x")).first().x
    assert [t.term for t in shown] == ["The", "ivus", "yiv,", "jam", "I"]


def test_golden_stems(spark):
    nouns = {"rosarum": "ros", "omnibus": "omn", "filius": "fil", "regem": "reg", "arma": "arm", "os": "os"}
    verbs = {"capiuntur": "capi", "amabunt": "amabi", "regunt": "regi", "amaberis": "amabi", "amabo": "amabi", "monemus": "mone", "amat": "ama"}
    words = {"virumque": "virum", "neque": None, "atque": None, "arma": "arma", "Populusque": "populus"}
    for rule, want in ((T.stem_noun, nouns), (T.stem_verb, verbs), (T.strip_que, words)):
        got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in want], "w string").selectExpr("w", f"{rule('w')} AS s").collect()}
        assert got == want


@pytest.mark.parametrize("mode, want", [("rhu", [1.0, 1.5, -1.5]), ("rhd", [1.0, 1.0, -1.0]), ("rhe", [1.0, 1.0, -1.0]), ("ru", [1.5, 1.5, -1.5]), ("rd", [1.0, 1.0, -1.0]), ("rf", [1.0, 1.0, -1.5]), ("r05u", [1.0, 1.0, -1.0])])
def test_quantize(spark, mode, want):
    """Multiples of a half: 1.2, and 1.25 and -1.25, which lie in the middle."""
    d = spark.createDataFrame([(0, "1.20"), (1, "1.25"), (2, "-1.25")], "i int, x string")
    got = d.selectExpr("i", f"cast({T.quantize('cast(x AS DECIMAL(10,4))', 'cast(0.5 AS DECIMAL(10,4))', mode)} AS DOUBLE) AS q").orderBy("i")
    assert [r.q for r in got.collect()] == want


def test_percentile_interpolates(spark):
    d = frame(spark, [1.0], [2.0], [4.0], [8.0])
    assert S.percentileOfSeries(d, 50, True).first().value == 3.0 and S.percentileOfSeries(d, 50).first().value == 4.0
    assert S.percentileOfSeries(d, 99, True).first().value == 8.0


def test_as_percent_of_a_series(spark):
    got = S.asPercent(frame(spark, [1.0, 3.0, None]), frame(spark, [4.0, 0.0, 2.0])).orderBy("ts").collect()
    assert [r.value for r in got] == [25.0, None, None] and got[0].name == "asPercent(s0, s0)"


def test_area_between_takes_two(spark):
    got = S.areaBetween(frame(spark, [1.0], [2.0])).orderBy("ord").collect()
    assert [(r.name, r.options) for r in got] == [("areaBetween(s1)", {"stacked": "true", "invisible": "true"}), ("areaBetween(s1)", {"stacked": "true"})]
    with pytest.raises(Exception, match="exactly two"):
        S.areaBetween(frame(spark, [1.0], [2.0], [3.0])).collect()


def test_holt_winters_by_formulas():
    """Against a direct transcription of the formulas with lists by index."""
    import random

    r = random.Random(3)
    values = [None if r.random() < 0.2 else r.random() * 9 for _ in range(90)]
    al, be, ga, n = 0.1, 0.0035, 0.1, 6
    s, dev, want, level, trend, pending = {}, {}, [], None, 0.0, None
    for i, a in enumerate(values):
        p = a if i == 0 else pending
        if a is None:
            s[i], dev[i], level, trend, pending = 0.0, 0.0, None, 0.0, None
        else:
            origin = a if level is None else level
            new = al * (a - s.get(i - n, 0.0)) + (1 - al) * (origin + trend)
            trend = be * (new - origin) + (1 - be) * trend
            s[i] = ga * (a - new) + (1 - ga) * s.get(i - n, 0.0)
            pending = new + trend + s.get(i + 1 - n, 0.0)
            dev[i] = ga * abs(a - (p or 0.0)) + (1 - ga) * dev.get(i - n, 0.0)
            level = new
        want.append((p, dev[i]))
    got = list(S.smoothed(values, n))
    for k in (0, 1):
        assert [x[k] is None for x in got] == [x[k] is None for x in want]
        assert [x[k] or 0.0 for x in got] == pytest.approx([x[k] or 0.0 for x in want])


def test_forecasts_are_rounded_as_in_sql(spark):
    import duckdb
    from stemloom.plans.series_queries import _coarsely

    values = [113.49849999999999, -113.49849999999999, 1.0005, 2.6755, 0.0004999999999999999, 12345.6785, None]
    got = [r.value for r in _coarsely(frame(spark, values)).orderBy("ts").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]
    assert got[0] == 113.499


def test_drawing(spark):
    inf = float("inf")
    d = frame(spark, [1.0, None, inf], [4.0, -2.0, float("nan")])
    assert tuple(drawing.y_range(d).first()) == (-2.0, 4.0)
    assert tuple(drawing.y_range(d, nulls_as_zero=True).first()) == (0.0, 4.0)
    assert tuple(drawing.y_range(d, stacked=True).first()) == (-2.0, 5.0)
    assert tuple(drawing.y_range(d, low=7, limit=3).first()) == (7.0, 8.0)
    assert tuple(drawing.y_range(d.limit(0)).first()) == (0.0, 1.0)
    assert [r.value for r in drawing.null_as_zero(d).orderBy("ord", "ts").collect()] == [1.0, 0.0, inf, 4.0, -2.0, 0.0]
    assert [r.value for r in drawing.log_scale(d, 2).orderBy("ord", "ts").collect()][:2] == [0.0, None]
    assert [r.ts for r in drawing.x_ticks(spark, 100, 260, "minute", 1).collect()] == [120, 180, 240]
    assert [r.ts for r in drawing.x_ticks(spark, 86400 + 5, 3 * 86400 + 1, "day", 1).collect()] == [2 * 86400, 3 * 86400]
    wide = frame(spark, [float(i) for i in range(10)])
    assert [r.value for r in drawing.to_pixels(wide, 4).orderBy("ts").collect()] == [1.0, 4.0, 7.0, 9.0]
    assert drawing.to_pixels(wide, 40).count() == 10


def test_queries_of_doc_sets(spark):
    rows = [(1, "a", "la", "Arma virumque cano"), (2, "a", "en", "Of arms and the man"), (3, "b", "la", "cano et arma"), (4, None, "la", None)]
    d = spark.createDataFrame(rows, "seg_id long, volume string, lang string, text string")
    ids = lambda q: sorted(r.seg_id for r in finding.doc_set(d, q).collect())
    assert ids("") == ids("*:*") == ids("*") == [1, 2, 3, 4]
    assert ids("arma") == [1, 3] and ids("arma volume:a") == [1] and ids('"arma virumque"') == [1] and ids("vir*") == [1]
    assert ids("volume:a OR volume:b") == [1, 2, 3] and ids("-volume:a") == [3, 4] and ids("lang:la AND NOT (volume:a OR volume:b)") == [4]
    assert ids("seg_id:[2 TO 3]") == [2, 3] and ids("seg_id:[* TO *]") == [1, 2, 3, 4] and ids("lang:l*") == [1, 3, 4]
    for bad in ("(a", "a)", "nope:x", "OR", "a AND"):
        with pytest.raises(finding.QueryError):
            finding.query_condition(bad)
    assert finding.page_links(1, 20) == list(range(1, 10)) and finding.page_links(10, 20) == list(range(6, 15)) and finding.page_links(20, 20) == list(range(12, 21)) and finding.page_links(1, 0) == []


def test_frequency_dump(spark, tmp_path):
    sinks.dump_frequencies(spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "term string, n long"), str(tmp_path / "d"))
    lines = [x for f in sorted((tmp_path / "d").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["# count: 3", "c\t5", "a\t2", "b\t2"]


def test_changes_are_idempotent_and_in_any_order(spark, tmp_path):
    schema = "key long, version long, price double, deleted boolean"
    parts = [[(1, 1, 1.0, False), (2, 5, 2.0, False)], [(1, 3, 0.0, True), (3, 1, 3.0, False)], [(1, 2, 9.0, False), (2, 6, 4.0, False), (2, 6, 4.0, False)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = jobs.apply_changes(stream, ["key"], "version", "deleted", str(tmp_path / "t"), str(tmp_path / "m"))
        assert got.columns == ["key", "version", "price"]
    assert sorted(map(tuple, got.collect())) == [(2, 6, 4.0), (3, 1, 3.0)]


def test_upsert_marks_what_is_written(spark):
    a = spark.createDataFrame([("la", "x", 1), ("la", "y", 2), (None, "z", 3)], "l string, t string, v int")
    b = spark.createDataFrame([("la", "x", 1), ("la", "y", 5), ("en", "x", 7), (None, "z", None)], a.schema)
    got = {(r.l, r.t): (r.v, r.written) for r in corpus.upsert_works(a, b, ["l", "t"]).collect()}
    assert got == {("la", "x"): (1, False), ("la", "y"): (5, True), ("en", "x"): (7, True), (None, "z"): (None, True)}


def test_term_vectors(spark):
    d = spark.createDataFrame([(1, "Arma, virum"), (2, ""), (3, "x")], "seg_id long, text string")
    got = sorted(map(tuple, corpus.term_vectors(d).collect()))
    assert got == [(1, "arma", 0, 0, 4), (1, "virum", 1, 6, 11), (3, "x", 0, 0, 1)]


def test_late_points_are_dropped(spark, tmp_path):
    schema = "name string, time timestamp, value double"
    seen = set()
    day = lambda h, v: ("m", f"2024-01-01 {h:02}:00:00", v)
    for i, rows in enumerate(([day(0, 1.0)], [day(12, 2.0)], [day(11, 32.0)], [day(1, 4.0), day(13, 8.0)], [day(0, 16.0)])):
        spark.createDataFrame(rows, "name string, t string, value double").selectExpr("name", "cast(t AS timestamp) AS time", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")) - seen:
            os.utime(f, (10**9 + 60 * i,) * 2)  # files are taken by their age
            seen.add(f)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from stemloom.scratch import Scratch

    got = jobs.run_updates(jobs.rollup(stream, (jobs.Retention("", 3600),)), ["name", "ts"], Scratch(spark, "late"), "p")
    assert sorted(r.total for r in got.collect()) == [1.0, 2.0, 8.0, 32.0]  # the mark of a batch holds from the second one after it

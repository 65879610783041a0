"""Rules held against golden values and straight loops."""

import math
import random
from datetime import datetime, timezone

import pytest

from stemloom.functions import text as T
from stemloom.operators import compare, corpus
from stemloom.operators import series as S
from stemloom.plans import language as L
from stemloom.plans.attime import offset_seconds, parse_time
from stemloom.sources import files, sinks


def frame(spark, *lists, step=60):
    rows = [(o, f"s{o}", f"s{o}", 0, step * len(v), step, "average", {}, step * i, None if x is None else float(x)) for o, v in enumerate(lists) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "ord long, name string, path string, start long, end long, step long, consolidate string, options map<string,string>, ts long, value double")


def values(df):
    out = {}
    for r in df.orderBy("ord", "ts").collect():
        out.setdefault(r.ord, []).append(r.value)
    return [out[k] for k in sorted(out)]


def test_highest_max(spark):
    d = frame(spark, range(20), range(50), range(30), range(40))
    for n, want in ((1, [50]), (2, [50, 40]), (3, [50, 40, 30]), (4, [50, 40, 30, 20]), (5, [50, 40, 30, 20])):
        assert [max(v) + 1 for v in values(S.highestMax(d, n))] == want


@pytest.mark.parametrize("given,want", [([None, None, 15, 20, 35, 40, 50], 20), (range(100), 30), (range(200), 60), (range(300), 90), (range(1, 101), 31), (range(1, 201), 61), (range(1, 301), 91), (range(102), 30), (range(1, 203), 61), (range(1, 303), 91)])
def test_percentile_30(spark, given, want):
    assert frame(spark, given).groupBy("ord").agg(S.percentile(30).alias("p")).first().p == want


def test_n_percentile(spark):
    lists = [[15, 35, 20, 40, 50], range(1, 101), range(1, 201), range(1, 301), range(100), range(200), range(300), [None] * 20 + list(range(300))]
    for n, want in ((30, [20, 31, 61, 91, 30, 60, 90, 90]), (90, [50, 91, 181, 271, 90, 180, 270, 270]), (95, [50, 96, 191, 286, 95, 190, 285, 285])):
        assert [v[0] for v in values(S.nPercentile(frame(spark, *lists), n))] == want


def test_keep_last_value(spark):
    rng = random.Random(3)
    for limit in (1, 2, math.inf):
        lists = [[rng.choice([None, None, 1.0, 2.0, 3.0]) for _ in range(25)] for _ in range(20)]
        want = []
        for v in lists:
            out, gap = list(v), 0
            for i, x in enumerate(v):
                if i == 0:
                    continue
                if x is None:
                    gap += 1
                    continue
                if 0 < gap <= limit and v[i - gap - 1] is not None:
                    out[i - gap : i] = [v[i - gap - 1]] * gap
                gap = 0
            if gap and gap < limit and v[len(v) - gap - 1] is not None:
                out[len(v) - gap :] = [v[len(v) - gap - 1]] * gap
            want.append(out)
        assert values(S.keepLastValue(frame(spark, *lists), limit)) == want


def test_diff_and_stacked(spark):
    d = frame(spark, [None, 10, 1], [5, 3, None], [2, None, None])
    assert values(S.diffSeries(d)) == [[3, 7, 1]]
    assert values(S.stacked(d)) == [[None, 10, 1], [5, 13, None], [7, None, None]]


def test_normalised_steps(spark):
    d = S.group(frame(spark, [1, 2, 3, 4, 5, 6]), frame(spark, [10, 20, 30], step=120))
    assert values(S.sumSeries(d)) == [[11.5, 23.5, 35.5]]


def test_holt_winters_starts_at_its_first_value():
    p, dev = zip(*S.smoothed([5.0, 6.0, None, 7.0], 24))
    assert p[0] == 5.0 and dev[0] == 0.0
    assert p[2] is not None and p[3] is None and dev[3] == pytest.approx(0.7)


def test_targets():
    t = L.parse('alias(scale(sumSeries(a.*.{b,c}), 0.5e1), "x y")')
    assert t == L.Call("alias", (L.Call("scale", (L.Call("sumSeries", (L.Path("a.*.{b,c}"),)), 5.0)), "x y"))
    for bad in ("f(", "f()", "a b", "f(x))"):
        with pytest.raises(ValueError):
            L.parse(bad)


def test_times():
    now = datetime(2024, 5, 15, 10, 30, tzinfo=timezone.utc)
    at = lambda s: parse_time(s, now).strftime("%Y-%m-%d %H:%M")
    assert at("now-1d") == "2024-05-14 10:30" and at("noon yesterday") == "2024-05-14 12:00" and at("16:00_20240102") == "2024-01-02 16:00"
    assert at("20240103") == "2024-01-03 00:00" and at("01/02/23") == "2023-01-02 00:00" and at("01/02/69") == "2069-01-02 00:00"
    assert at("yesterday") == "2024-05-14 00:00" and at("today") == "2024-05-15 00:00" and at("tomorrow-1h") == "2024-05-15 23:00"
    assert at("jan 5") == "2024-01-05 00:00" and at("monday") == "2024-05-13 00:00" and at("teatime monday") == "2024-05-13 16:00" and at("now") == "2024-05-15 10:30"
    with pytest.raises(ValueError):
        parse_time("january", now)
    assert offset_seconds("-1d12h") == -129600 and offset_seconds("2mon") == 60 * 86400
    with pytest.raises(ValueError):
        offset_seconds("1 day")




def test_roman(spark):
    words = ["", "i", "iv", "viv", "ix", "xiv", "xlix", "mcmxc", "dcd", "cmc", "mmxxiv", "iiii", "vx", "arma"]
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{T.roman('w')} AS n").collect()}
    want = {"": "0", "i": "1", "iv": "4", "viv": "9", "ix": "9", "xiv": "14", "xlix": "49", "mcmxc": "1990", "dcd": "900", "cmc": "1000", "mmxxiv": "2024", "iiii": "iiii", "vx": "vx", "arma": "arma"}
    assert got == want


def test_compare_by_hand(spark):
    toks = lambda rows: spark.createDataFrame([(d, p, f, f) for d, text in rows for p, f in enumerate(text.split())], "seg_id long, pos long, form string, stem string")
    s, t = toks([(1, "arma x virum"), (2, "arma solum")]), toks([(3, "virum y z arma"), (4, "solum arma q")])
    p = compare.Params(stop_words=0)
    got = [(r.sdoc, r.tdoc, r.distance, r.terms) for r in compare.compare(s, t, None, p).orderBy("sdoc").collect()]
    assert got == [(1, 3, 3 + 4, "arma|virum"), (2, 4, 2 + 2, "arma|solum")]
    score = math.log((1 / (2 / 5) + 1 / (1 / 5) + 1 / (2 / 7) + 1 / (1 / 7)) / 7)
    assert compare.compare(s, t, None, p).where("sdoc = 1").first().score == pytest.approx(score, abs=1e-6)
    with pytest.raises(ValueError):
        compare.Params(min_common=1)
    assert compare.Params(stop_list="a, b", stop_words=3).given_stops() == ["a", "", "b"]


def test_sentences_and_files(spark, tmp_path):
    (tmp_path / "x.tess").write_text("<v. a. 1.1>\tOne two. three\nnothing\n<v. a. 1.2-3>\tfour; five\n")
    lines = files.read_tess(spark, str(tmp_path / "x.tess")).orderBy("n").collect()
    assert [(r.text, r.line) for r in lines] == [("One two. three", "1"), ("four; five", "2")]
    got = files.read_tess(spark, str(tmp_path / "x.tess"), sentences=True).orderBy("s").collect()
    assert [(r.sentence.split(), r.start, r.end) for r in got] == [(["One", "two."], "1", "1"), (["three", "four;"], "1", "2")]
    (tmp_path / "l.csv").write_text("Jus,n,ius\njus,n,iura\nsum1,v,sum\nsum,n,x\n")
    assert {r.key: r.stems for r in files.read_lexicon(spark, str(tmp_path / "l.csv")).collect()} == {"ius": ["iura", "ius"], "sum": ["sum"]}


def test_replaced_passages(spark, tmp_path):
    path = str(tmp_path / "p")
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "passage_id long, sentence string, volume_id long")
    sinks.replace_passages(d, path)
    sinks.replace_passages(spark.createDataFrame([(3, "c", 2)], d.schema), path)
    assert sorted((r.passage_id, r.volume_id) for r in spark.read.parquet(path).collect()) == [(1, 1), (3, 2)]


def test_upsert_ignores_case(spark):
    a = spark.createDataFrame([("A", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, corpus.upsert(a, spark.createDataFrame([("a", 9)], a.schema), ["k"]).collect())) == [("a", 9), ("b", 2)]


def test_every_function_of_the_language_is_known():
    assert len(set(L.FUNCTIONS) | set(L.REENTRANT)) >= 91 - 3
    assert not set(L.FUNCTIONS) & set(L.REENTRANT)

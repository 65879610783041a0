"""Steps whose work must grow with their input, against the plain way of doing them."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stemloom.operators import compare, corpus
from stemloom.plans import more_queries, text_queries
from stemloom.scratch import Scratch


def texts(spark, n=120):
    """Passages of common words, some rare ones and a copy here and there."""
    rows = []
    for i in range(n):
        words = [f"w{chr(97 + i * j % 7)}x" for j in range(1, 6)] + [f"r{chr(97 + i // 4 % 26)}q{chr(97 + i // 104)}", f"s{chr(97 + i // 3 % 26)}z"]
        rows.append((i, " ".join(words[i % 3 :] + words[: i % 3])))
    return spark.createDataFrame(rows, "seg_id long, text string")


@pytest.mark.parametrize("metric,other", [("freq", 60), ("span_source", 60), ("span", 0)])
def test_bounded_pairs_are_all_pairs(spark, metric, other):
    """The page that is found by a bound is the page of all pairs, also where both sides hold the same passages."""
    d, p, scratch = texts(spark), compare.Params(metric=metric, rows=12), Scratch(spark, "test")
    one, two = compare.side_of_passages(d.where("seg_id >= " + str(other)), scratch), compare.side_of_tokens(corpus.with_stems(corpus.tokens(d.where(f"seg_id < {other} OR {other} = 0"))))
    stems, forms = compare._weights({"s": one, "t": two}, None, scratch)
    s, t = (compare._numbered(side, forms[x], x, scratch) for x, side in (("s", one), ("t", two)))
    plain = compare.best_pairs(s, t, stems, p, scratch).collect()
    assert len(plain) == 12
    assert sorted(map(tuple, compare.best_pairs(s, t, stems, p, scratch, at_once=40).collect())) == sorted(map(tuple, plain))
    least = min(r.score for r in plain)
    met = compare._bounded(s, t, p, least - 1e-6)
    got = {(r.sdoc, r.tdoc) for r in met.collect()}
    assert got >= {(r.sdoc, r.tdoc) for r in plain} and len(got) < s.select("sdoc").distinct().count() * t.select("tdoc").distinct().count() / 4


ODD = [
    (1, "arma arme arms\n\nvirum 12 cano viri", "en", "src0"), (1, "arma arme arms\n\nvirum 12 cano viri", "en", "src0"),
    (2, "una\nduo tria", "en", "src0"), (2, "quattuor una\nunius duo", "fr", "src1"), (None, "solus", "en", "src0"),
    (3, "\n".join(["", "a b"] * 50001), "en", "src0"), (4, "b c\nd", "en", "src1"), (5, "", "en", "src0"), (6, None, "en", "src0"), (7, "12 34 (a)", "de", "src2"),
]


@pytest.mark.parametrize("name", ["term_vectors", "stem_index", "stem_frequencies", "lexicon_lookup"])
def test_repeated_and_missing_ids(spark, tmp_path, name):
    """Ids that repeat, as a document of more than 100 000 lines makes them too, and null ones, count as in SQL."""
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = text_queries.QUERIES[name](spark, str(tmp_path))
    rows = con.execute(text_queries.SQL[name]).fetchall()
    assert Counter(map(tuple, got.select(*[c[0] for c in con.description]).collect())) == Counter(rows)


@pytest.mark.parametrize("name", ["term_vectors", "stem_index"])
def test_tokens_are_not_dealt_out(spark, name):
    """What is counted once a passage leaves its row as counts or distinct stems alone."""
    plan = text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning(seg_id" not in plan


def test_y_range_of_dense_series(spark, tmp_path):
    """Without a gap the least value may lie above the limit; the query shows both as they are, as its SQL does."""
    d = spark.range(720).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int))").alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("click").alias("event_type"), (F.col("id") + 200.0).alias("value"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(map(tuple, more_queries.QUERIES["draw_y_range"](spark, str(tmp_path)).select("low", "high").collect()))
    assert got == sorted(con.execute(more_queries.SQL["draw_y_range"]).fetchall()) and (200.0, 100.0) in got

"""Comparison of two sets of passages by the rare stems that they share."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.operators import corpus as C
from stemloom.scratch import Scratch

METRICS = ("freq", "freq_source", "freq_target", "span", "span_source", "span_target")


@dataclass(frozen=True)
class Params:
    metric: str = "freq"
    max_distance: int = 0
    stop_words: int = 10
    stop_list: str | None = None
    min_common: int = 2
    start: int = 0
    rows: int = 10

    def __post_init__(self):
        if self.min_common < 2:
            raise ValueError("at least two common terms are needed")
        if self.metric.lower().replace(" ", "_") not in METRICS:
            raise ValueError(f"unknown metric: {self.metric}")

    def given_stops(self) -> list[str] | None:
        """The caller's list: the first ``stop_words`` distinct entries; None asks for the corpus's own."""
        if self.stop_list is None or not self.stop_list.strip():
            return None
        parts = re.split(r",| ", self.stop_list)
        while parts and not parts[-1]:
            parts.pop()
        return list(dict.fromkeys(parts))[: self.stop_words]


@dataclass(frozen=True)
class Side:
    """What is compared of a set of passages.

    occurrences: (seg_id, stem, form, pos, span), the first occurrence of each stem in each passage, and the passage's
    span; edges: (form, stem, n), how many of these a form and a stem have; counts: (form, cw), all tokens by form."""

    occurrences: DataFrame
    edges: DataFrame
    counts: DataFrame


def side_of_tokens(toks: DataFrame) -> Side:
    """Of staged tokens with stems of any kind."""
    # A token that has several stems is several rows, of which the first counts as the token.
    plain = toks.where("nth = 0") if "nth" in toks.columns else toks.select("seg_id", "pos", "form").distinct()
    span = toks.groupBy(F.col("seg_id").alias("_id")).agg((F.max("pos") - F.min("pos") + 1).alias("span"))
    occ = C.stem_occurrences(toks)
    edges = occ.groupBy("form", "stem").agg(F.count(F.lit(1)).alias("n"))
    return Side(occ.join(span, F.col("seg_id") == F.col("_id")).drop("_id"), edges, plain.groupBy("form").agg(F.count(F.lit(1)).alias("cw")))


def side_of_passages(passages: DataFrame, scratch: Scratch) -> Side:
    """Of passages, with stems by the noun rules: tokens stay in their rows."""
    split = C.by_key(passages, scratch)
    forms = scratch.write(C.flagged(*split).groupBy("form", "stem").agg(F.count(F.lit(1)).alias("cw"), F.sum(F.col("first").cast("long")).alias("n")), "counts")
    # By these rules a form has one stem.
    return Side(C.flagged(*split, first=True).drop("first"), forms.where("n > 0").select("form", "stem", "n"), forms.select("form", "cw"))


def _weights(sides: dict[str, Side], stops: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(stem, k, w, m) of the stems that both sides have and that are no stops, and each side's (form, stem, k, w, f, q).

    w: the most that a common stem can add to a pair's score, of both sides; m: pairs of occurrences; f, q: the form's
    rank and frequency. Forms are numbered in the order of their frequency, then of their letters, by a sort: numbers
    alone go on, and the smallest is the rarest form."""
    forms = {}
    for x, one in sides.items():
        freq = C.shared_frequencies(one.counts, one.edges.select("form", "stem")).select("form", "freq")
        ranked = scratch.write(freq.orderBy("freq", "form").withColumn("f", F.monotonically_increasing_id()), f"{x}-ranks")
        forms[x] = scratch.write(one.edges.join(ranked, "form"), f"{x}-forms")
    s, t = (d.groupBy("stem").agg(F.max(1 / F.col("freq")).alias(f"{x}w"), F.sum("n").alias(f"{x}n")) for x, d in forms.items())
    both = s.join(t, "stem")
    if stops is not None:
        both = both.join(F.broadcast(stops.select("stem")), "stem", "left_anti")  # at most Params.stop_words rows
    stems = scratch.write(both.select("stem", F.monotonically_increasing_id().alias("k"), (F.col("sw") + F.col("tw")).alias("w"), (F.col("sn") * F.col("tn")).alias("m")), "stems")
    return stems, {x: d.join(stems.drop("m"), "stem").select("form", "stem", "k", "w", "f", F.col("freq").alias("q")) for x, d in forms.items()}


def _numbered(one: Side, forms: DataFrame, x: str, scratch: Scratch) -> DataFrame:
    """(k, w, {x}doc, {x}p, {x}f, {x}q, {x}span, {x}rest, {x}all): a side's occurrences of the stems in ``forms``.

    {x}rest: the weights of the stem and of the passage's lighter ones together, by (w, k); {x}all: of all its stems."""
    d = one.occurrences.join(forms, ["form", "stem"])
    of = Window.partitionBy("seg_id")
    rest = F.sum("w").over(of.orderBy("w", "k").rowsBetween(Window.unboundedPreceding, 0))
    named = {"seg_id": "doc", "pos": "p", "f": "f", "q": "q", "span": "span", "rest": "rest", "all": "all"}
    d = d.withColumn("rest", rest).withColumn("all", F.sum("w").over(of))
    return scratch.write(d.select("k", "w", *(F.col(c).alias(x + n) for c, n in named.items())), f"{x}-occurrences")


def pair_scores(met: DataFrame, p: Params) -> DataFrame:
    """(sdoc, tdoc, score, distance) of every pair of passages that passes the filters.

    met: the occurrences that meet, a row for each stem of a pair, with both sides' columns. They are dealt out once, by
    pair: all the aggregates that follow keep that partitioning."""
    met = met.where("sdoc != tdoc").repartition("sdoc", "tdoc")
    either = (F.struct(F.lit(k).alias("side"), *(F.col(f"{x}{c}").alias(c) for c in ("p", "f", "q", "span"))) for k, x in enumerate("st"))
    rows = met.select("sdoc", "tdoc", F.inline(F.array(*either)))
    pair = ["sdoc", "tdoc"]
    # A place that several stems share counts once.
    places = rows.groupBy(*pair, "side", "p").agg(F.first("f").alias("f"), F.first("q").alias("q"), F.first("span").alias("span"))
    forms = places.groupBy(*pair, "side", "f").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) / F.col("q")).alias("inverse"), F.first("span").alias("span"))
    sides = forms.groupBy(*pair, "side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.sum("inverse").alias("inverse"), F.first("span").alias("span"), F.sort_array(F.collect_list(F.struct("f", "p"))).alias("rarest"))
    sides = sides.where((F.col("n") >= p.min_common) & (F.col("forms") >= 2))
    # Distance between the first places of the two least frequent forms, or the passage's span.
    near = F.abs(F.get("rarest", F.lit(0))["p"] - F.get("rarest", F.lit(1))["p"]) + 1
    of = lambda k: F.max(F.when(F.col("side") == k, near if _near(p) else F.col("span")))
    pairs = sides.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.sum("inverse").alias("inverse"), of(0).alias("ds"), of(1).alias("dt")).where("n = 2")
    # Of (a, b) and (b, a), where both are left, the one whose source is the smaller.
    both = Window.partitionBy(F.least(*pair), F.greatest(*pair))
    pairs = pairs.withColumn("_n", F.count(F.lit(1)).over(both)).where("_n = 1 OR sdoc < tdoc")
    distance = _total(p, F.col("ds"), F.col("dt"))
    out = pairs.select(*pair, distance.cast("long").alias("distance"), F.ln(F.col("inverse") / distance).alias("score"))
    out = out.where("distance IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score >= 0")
    return out.where(F.col("distance") <= p.max_distance) if p.max_distance > 0 else out


def _near(p: Params) -> bool:
    return p.metric.lower().startswith("freq")


def _total(p: Params, ds: Column, dt: Column) -> Column:
    """A pair's distance, of the sides' own."""
    return ds if p.metric.lower().endswith("source") else dt if p.metric.lower().endswith("target") else ds + dt


def _best(scores: DataFrame, n: int) -> DataFrame:
    return scores.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "sdoc", "tdoc").limit(n)


def _matches(pairs: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """The occurrences that meet in each of ``pairs``, and in its mirror, which may decide whether it counts."""
    pairs = pairs.select("sdoc", "tdoc").unionByName(pairs.where("sdoc > tdoc").select(F.col("tdoc").alias("sdoc"), F.col("sdoc").alias("tdoc"))).distinct()
    return s.join(pairs, "sdoc").join(t.drop("w"), ["tdoc", "k"])


#: Pairs of occurrences that are met at once: as many or fewer are not worth a bound.
AT_ONCE = 1 << 21


def _cut(stems: DataFrame, most: int) -> float | None:
    """The least weight w so that all stems of w or more meet ``most`` times together, or nearly; None where all stems do."""
    step = F.floor(F.log2("w") * 8)
    steps = stems.groupBy(step.alias("x")).agg(F.sum("m").alias("m"), F.min("w").alias("w")).orderBy(F.desc("x")).collect()  # 8 rows a power of two at most
    met, cut = 0, None
    for r in steps:
        met += r.m
        if met > most and cut is not None:
            return cut
        cut = r.w
    return None


def _bounded(s: DataFrame, t: DataFrame, p: Params, least: float) -> DataFrame:
    """(sdoc, tdoc) of every pair that can score ``least`` or more, and of some others.

    A pair's weights must come to e^least times its distance, which is known or known to be 2 or more on a side, for
    either passage alone. Of a pair's common stems those that are not among the heavy ones of both passages
    come to less than a share SPARE of that bound, as they all lie behind the same place in the order of one passage; so
    the heavy ones that meet must come to the rest. The heavy ones alone are joined."""
    unit = math.exp(least) * (1 - 1e-9)
    two = F.lit(2)
    own = {x: _total(p, *((F.col(f"{x}span") if x == y and not _near(p) else two) for y in "st")) * unit for x in "st"}
    heavy = lambda d, x: d.where((F.col(f"{x}all") >= own[x]) & (F.col(f"{x}rest") >= own[x] * SPARE))
    met = heavy(s, "s").select("k", "w", "sdoc", "sspan").join(heavy(t, "t").select("k", "tdoc", "tspan"), "k").where("sdoc != tdoc")
    sums = met.groupBy("sdoc", "tdoc").agg(F.sum("w").alias("w"), F.first("sspan").alias("sspan"), F.first("tspan").alias("tspan"))
    ends = (two, two) if _near(p) else (F.col("sspan"), F.col("tspan"))
    return sums.where(F.col("w") >= _total(p, *ends) * unit * (1 - SPARE))


SPARE = 0.1


def best_pairs(s: DataFrame, t: DataFrame, stems: DataFrame, p: Params, scratch: Scratch, at_once: int = AT_ONCE) -> DataFrame:
    """The first ``start + rows`` pairs: sdoc, tdoc, score, distance.

    Where too many occurrences would meet, some pairs are scored first, whole, by their rarest stems. The last score among as
    many of these as are asked for is a bound that no pair on the page falls below, ties included; then
    all pairs that can reach it are scored."""
    n = p.start + p.rows
    while (cut := _cut(stems, at_once)) is not None:
        rare = pair_scores(s.where(F.col("w") >= cut).join(t.drop("w").where(F.col("w") >= cut), "k"), p)
        likely = scratch.write(_best(rare, 10 * n + 1000), f"likely-{at_once}")
        scores = [r.score for r in _best(pair_scores(_matches(likely, s, t), p), n).select("score").collect()]  # a page of numbers
        if len(scores) == n:
            pairs = scratch.write(_bounded(s, t, p, min(scores) - 1e-6), "bounded")
            return _best(pair_scores(_matches(pairs, s, t), p), n)
        at_once *= 16
    return _best(pair_scores(s.join(t.drop("w"), "k"), p), n)


def with_terms(page: DataFrame, s: DataFrame, t: DataFrame, stems: DataFrame) -> DataFrame:
    """A page of pairs with ``terms``: the stems matched at each place joined by "-", in order, those of all places by "|"."""
    few = page.select("sdoc", "tdoc")
    met = s.join(F.broadcast(few), "sdoc").join(t, ["tdoc", "k"]).join(stems.select("k", "stem"), "k")  # a page: at most Params.start + rows pairs
    each = met.select("sdoc", "tdoc", "stem", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("sp").alias("p")), F.struct(F.lit(1).alias("side"), F.col("tp").alias("p")))))
    joined = each.groupBy("sdoc", "tdoc", "side", "p").agg(F.array_join(F.array_sort(F.collect_set("stem")), "-").alias("x"))
    terms = joined.groupBy("sdoc", "tdoc").agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias("terms"))
    return page.join(terms, ["sdoc", "tdoc"])


def compare(source: DataFrame, target: DataFrame, corpus_counts: DataFrame, p: Params = Params()) -> DataFrame:
    """The page of pairs that ``p`` asks for: rank, sdoc, tdoc, score, distance, terms; source, target: staged tokens."""
    return compare_sides(side_of_tokens(source), side_of_tokens(target), corpus_counts, p)


def compare_sides(source: Side, target: Side, corpus_counts: DataFrame, p: Params = Params()) -> DataFrame:
    scratch = Scratch(source.counts.sparkSession, "pairs")
    stops = None
    if p.stop_words > 0:
        given = p.given_stops()
        if given is None:
            stops = scratch.write(C.top_terms(corpus_counts, p.stop_words).select(F.col("term").alias("stem")), "stops")
        else:
            stops = source.counts.sparkSession.createDataFrame([(w,) for w in given], "stem string")
    stems, forms = _weights({"s": source, "t": target}, stops, scratch)
    s, t = (_numbered(side, forms[x], x, scratch) for x, side in (("s", source), ("t", target)))
    best = best_pairs(s, t, stems, p, scratch)
    # The page alone is ranked: at most start + rows rows.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "sdoc", "tdoc"))
    page = scratch.write(best.withColumn("rank", (rank - 1).cast("long")).where(F.col("rank") >= p.start), "page")
    return with_terms(page, s, t, stems).select("rank", "sdoc", "tdoc", "score", "distance", "terms")


#: What a caller may ask to see of either passage of a pair.
FIELDS = ("volume", "lang", "text")


def with_fields(page: DataFrame, passages: DataFrame, source_fields: list[str], target_fields: list[str]) -> DataFrame:
    """A page of pairs with the stored fields that are asked for, as source_<field> and target_<field>.

    Fields are fetched late, for the passages of the page alone: its rows (Params.start + rows at most) are what is broadcast."""
    for side, fields in (("source", source_fields), ("target", target_fields)):
        if unknown := [f for f in fields if f not in FIELDS]:
            raise ValueError(f"unknown fields: {unknown}")
        key = side[0] + "doc"
        if fields:
            stored = passages.select(F.col("seg_id").alias("_id"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
            page = stored.join(F.broadcast(page), F.col("_id") == F.col(key)).drop("_id")
    first = ["rank", "sdoc", "tdoc", "score", "distance", "terms"]
    return page.select(*first, *(c for c in page.columns if c not in first))

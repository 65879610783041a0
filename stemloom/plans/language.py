"""The language of targets: calls of series functions over dotted metric patterns.

A target is parsed into a tree, and the tree is made into one lazy plan. Functions that look at
another range of time evaluate their argument's tree again in a shifted context."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators import series as S
from stemloom.plans.attime import offset_seconds


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Path:
    pattern: str


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?=\s*[,)]|\s*$)")
_BOOL = re.compile(r"(true|false)(?=\s*[,)]|\s*$)", re.I)
_NAME = re.compile(r"[A-Za-z_]\w*(?=\s*\()")
_STRING = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'""")


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.at} of {self.text!r}")

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, pattern: re.Pattern) -> re.Match | None:
        self.blanks()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def expression(self) -> Call | Path:
        if m := self.take(_NAME):
            self.take(re.compile(r"\("))
            args = [self.argument()]
            while self.take(re.compile(",")):
                args.append(self.argument())
            if not self.take(re.compile(r"\)")):
                raise self.fail("')' expected")
            return Call(m[0], tuple(args))
        self.blanks()
        begin, depth = self.at, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c.isspace() or c in "()" or (c == "," and not depth):
                break
            self.at += 1
        if begin == self.at:
            raise self.fail("an expression expected")
        return Path(self.text[begin : self.at])

    def argument(self) -> Any:
        if m := self.take(_BOOL):
            return m[1].lower() == "true"
        if m := self.take(_NUMBER):
            return int(m[0]) if re.fullmatch(r"[+-]?\d+", m[0]) else float(m[0])
        if m := self.take(_STRING):
            return m[1] if m[1] is not None else m[2]
        return self.expression()


def parse(target: str) -> Call | Path:
    p = _Parser(target)
    out = p.expression()
    p.blanks()
    if p.at != len(target):
        raise p.fail("end expected")
    return out


# Metric patterns.


def component_regex(glob: str) -> str:
    """A regular expression for one dotted component: *, ?, [...] and {a,b}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^.]*"
        elif c == "?":
            out += "[^.]"
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : j].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = j
        elif c == "{" and (j := glob.find("}", i)) > 0:
            out += "(?:" + "|".join(component_regex(x) for x in glob[i + 1 : j].split(",")) + ")"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def is_pattern(path: str) -> bool:
    return any(c in path for c in "*?[{")


def glob_regex(pattern: str) -> str:
    parts, depth, held = [], 0, ""
    for c in pattern + ".":
        if c == "." and not depth:
            parts.append(held)
            held = ""
            continue
        depth += (c == "{") - (c == "}")
        held += c
    return "^" + r"\.".join(component_regex(p) for p in parts) + "$"


def glob_find(metrics: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """Metrics whose dotted components match the pattern's, one by one; a literal path is an equality that a scan can use."""
    c = F.col(column)
    return metrics.where(c.rlike(glob_regex(pattern)) if is_pattern(pattern) else c == pattern)


@dataclass(frozen=True)
class Context:
    """What targets are evaluated over: points (name, ts, value) of one regular ``step``, in a range of time."""

    spark: SparkSession
    points: DataFrame
    start: int
    end: int
    step: int = 60
    events: DataFrame | None = None
    #: Frames that the targets have stacked so far, by the stack's name; shared by all contexts made of this one.
    stacks: dict[str, list[DataFrame]] = field(default_factory=dict)

    def shifted(self, by: int) -> Context:
        return replace(self, start=self.start + by, end=self.end + by)


def fetch(ctx: Context, pattern: str) -> DataFrame:
    """The matching series on the dense grid of the context's range, in the order of their names."""
    found = glob_find(ctx.points, pattern, "name")
    names = found.select("name").distinct()
    start = ctx.start - ctx.start % ctx.step
    grid = names.withColumn("ts", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(max(start, ctx.end - 1)).cast("long"), F.lit(ctx.step).cast("long"))))
    inside = found.where((F.col("ts") >= start) & (F.col("ts") < ctx.end))
    # One row a series: its place in the list.
    order = names.select("name", (F.row_number().over(S.Window.orderBy("name")) - 1).cast("long").alias("ord"))
    d = grid.join(inside.select("name", "ts", F.col("value").cast("double").alias("value")), ["name", "ts"], "left").join(order, "name")
    return d.withColumns({"path": F.lit(pattern), "start": F.lit(start).cast("long"), "end": F.lit(ctx.end).cast("long"), "step": F.lit(ctx.step).cast("long"), "consolidate": F.lit("average"), "options": F.create_map().cast(S.OPTIONS)}).select(*S.COLUMNS)


def evaluate(ctx: Context, node: Any) -> Any:
    if isinstance(node, str) and not isinstance(node, (Call, Path)):
        node = parse(node)
    if isinstance(node, Path):
        return fetch(ctx, node.pattern)
    if not isinstance(node, Call):
        return node
    if node.name in REENTRANT:
        return REENTRANT[node.name](ctx, *node.args)
    if node.name not in FUNCTIONS:
        raise KeyError(node.name)
    return FUNCTIONS[node.name](*(evaluate(ctx, a) if isinstance(a, (Call, Path)) else a for a in node.args))


def render(ctx: Context, *targets: str) -> DataFrame:
    """The targets' series, one list after the other."""
    ctx = replace(ctx, stacks={})
    return S.group(*(evaluate(ctx, parse(t)) for t in targets))


# Functions that evaluate their argument again.


def _look_back(ctx: Context, arg: Any, seconds: int) -> DataFrame:
    return evaluate(replace(ctx, start=ctx.start - seconds), arg)


def _trim(ctx: Context, df: DataFrame) -> DataFrame:
    return df.where(F.col("ts") >= ctx.start).withColumn("start", F.greatest("start", F.lit(ctx.start).cast("long")))


def _moving(fn):
    def run(ctx: Context, arg: Any, size: int | str) -> DataFrame:
        back = abs(offset_seconds(size)) if isinstance(size, str) else int(size) * ctx.step
        return _trim(ctx, fn(_look_back(ctx, arg, back), size))

    return run


def time_shift(ctx: Context, arg: Any, shift: str, resetEnd: bool = True) -> DataFrame:
    delta = offset_seconds(shift if shift[0] in "+-" else f"-{shift}")
    d = evaluate(ctx.shifted(delta), arg)
    shown = F.concat(F.lit("timeShift("), F.col("name"), F.lit(f", {shift if shift[0] in '+-' else '-' + shift})"))
    back = lambda c: (F.col(c) - delta).cast("long")
    end = F.lit(ctx.end).cast("long") if resetEnd else back("end")
    return d.withColumns({"ts": back("ts"), "start": back("start"), "end": end, "name": shown})


def time_stack(ctx: Context, arg: Any, unit: str, first: int, last: int) -> DataFrame:
    unit = unit if unit[0] in "+-" else f"-{unit}"
    delta = offset_seconds(unit)
    parts = []
    for k in range(int(first), int(last)):
        d = evaluate(ctx.shifted(k * delta), arg)
        parts.append(d.withColumns({"ts": (F.col("ts") - k * delta).cast("long"), "start": (F.col("start") - k * delta).cast("long"), "end": F.lit(ctx.end).cast("long"), "name": F.concat(F.lit("timeShift("), F.col("name"), F.lit(f", {unit}, {k})"))}))
    return S.group(*parts)


def smart_summarize(ctx: Context, arg: Any, interval: str, how: str = "sum", alignToFrom: bool = False) -> DataFrame:
    """Buckets from the start of the day, hour or minute in which the range begins; each series is read again from there."""
    n = abs(offset_seconds(interval))
    base = 86400 if n >= 86400 else 3600 if n >= 3600 else 60 if n >= 60 else 1
    d = evaluate(replace(ctx, start=ctx.start - ctx.start % base), arg)
    out = S.summarize(d, interval, how, True)
    return out.withColumn("name", F.regexp_replace(F.regexp_replace("name", r"^summarize\(", "smartSummarize("), r", true\)$", ")"))


def hit_count(ctx: Context, arg: Any, interval: str, alignToInterval: bool = False) -> DataFrame:
    if alignToInterval:
        n = abs(offset_seconds(interval))
        base = 86400 if n >= 86400 else 3600 if n >= 3600 else 60 if n >= 60 else 1
        ctx = replace(ctx, start=ctx.start - ctx.start % base)
    return S.hitcount(evaluate(ctx, arg), interval, alignToInterval)


def use_series_above(ctx: Context, arg: Any, value: float, search: str, repl: str) -> DataFrame:
    """For each series with a maximum above ``value``, the series of its renamed path."""
    d = evaluate(ctx, arg)
    new = F.regexp_replace("name", search, re.sub(r"\\(\d)", r"$\1", repl))
    wanted = S.per_series(d, x=F.max("value"), name=F.first("name")).where(F.col("x") > value).select("ord", new.alias("name"))
    return _all(ctx).drop("ord").join(wanted, "name").withColumn("path", F.col("name")).select(*S.COLUMNS)


def _all(ctx: Context) -> DataFrame:
    names = ctx.points.select("name").distinct()
    start = ctx.start - ctx.start % ctx.step
    grid = names.withColumn("ts", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(ctx.end - 1).cast("long"), F.lit(ctx.step).cast("long"))))
    d = grid.join(ctx.points.select("name", "ts", F.col("value").cast("double").alias("value")), ["name", "ts"], "left")
    return d.withColumns({"ord": F.lit(0).cast("long"), "path": F.col("name"), "start": F.lit(start).cast("long"), "end": F.lit(ctx.end).cast("long"), "step": F.lit(ctx.step).cast("long"), "consolidate": F.lit("average"), "options": F.create_map().cast(S.OPTIONS)}).select(*S.COLUMNS)


def stacked(ctx: Context, arg: Any, stackName: str = "__DEFAULT__") -> DataFrame:
    """On top of what the targets before have stacked under the name."""
    d = evaluate(ctx, arg)
    below = ctx.stacks.setdefault(stackName, [])
    out = S.stacked(d, stackName, tuple(below))
    below.append(d)
    return out


WEEK = 7 * 86400


def _hw(fn):
    def run(ctx: Context, arg: Any, *args: Any) -> DataFrame:
        return fn(S.holt_winters(_look_back(ctx, arg, WEEK), ctx.start), *args)

    return run


FUNCTIONS = {
    "sumSeries": S.sumSeries, "sum": S.sumSeries, "averageSeries": S.averageSeries, "avg": S.averageSeries, "stddevSeries": S.stddevSeries,
    "minSeries": S.minSeries, "maxSeries": S.maxSeries, "rangeOfSeries": S.rangeOfSeries, "countSeries": S.countSeries, "multiplySeries": S.multiplySeries,
    "sumSeriesWithWildcards": S.sumSeriesWithWildcards, "averageSeriesWithWildcards": S.averageSeriesWithWildcards, "group": S.group, "groupByNode": S.groupByNode,
    "scale": S.scale, "scaleToSeconds": S.scaleToSeconds, "offset": S.offset, "absolute": S.absolute, "derivative": S.derivative,
    "nonNegativeDerivative": S.nonNegativeDerivative, "integral": S.integral, "log": S.logarithm, "percentileOfSeries": S.percentileOfSeries,
    "summarize": S.summarize, "transformNull": S.transformNull, "keepLastValue": S.keepLastValue, "consolidateBy": S.consolidateBy, "cumulative": S.cumulative,
    "stdev": S.stdev, "asPercent": S.asPercent, "pct": S.asPercent, "diffSeries": S.diffSeries, "divideSeries": S.divideSeries,
    "maximumAbove": S.maximumAbove, "minimumAbove": S.minimumAbove, "maximumBelow": S.maximumBelow, "currentAbove": S.currentAbove, "currentBelow": S.currentBelow,
    "averageAbove": S.averageAbove, "averageBelow": S.averageBelow, "highestCurrent": S.highestCurrent, "lowestCurrent": S.lowestCurrent,
    "highestAverage": S.highestAverage, "lowestAverage": S.lowestAverage, "highestMax": S.highestMax, "mostDeviant": S.mostDeviant, "nPercentile": S.nPercentile,
    "limit": S.limit, "sortByMaxima": S.sortByMaxima, "sortByMinima": S.sortByMinima, "exclude": S.exclude,
    "removeAbovePercentile": S.removeAbovePercentile, "removeAboveValue": S.removeAboveValue, "removeBelowPercentile": S.removeBelowPercentile, "removeBelowValue": S.removeBelowValue,
    "alias": S.alias, "aliasSub": S.aliasSub, "aliasByNode": S.aliasByNode, "aliasByMetric": S.aliasByMetric, "substr": S.substr, "legendValue": S.legendValue, "cactiStyle": S.cactiStyle,
    "color": S.color, "alpha": S.alpha, "lineWidth": S.lineWidth, "dashed": S.dashed, "drawAsInfinite": S.drawAsInfinite, "secondYAxis": S.secondYAxis, "areaBetween": S.areaBetween,
}

_time = lambda ctx, name: S.timeFunction(ctx.spark, name, ctx.start, ctx.end)
_sin = lambda ctx, name, amplitude=1: S.sinFunction(ctx.spark, name, ctx.start, ctx.end, amplitude)
_walk = lambda ctx, name: S.randomWalkFunction(ctx.spark, name, ctx.start, ctx.end)
REENTRANT = {
    "movingAverage": _moving(S.movingAverage), "movingMedian": _moving(S.movingMedian), "timeShift": time_shift, "timeStack": time_stack,
    "stacked": stacked, "smartSummarize": smart_summarize, "hitcount": hit_count, "useSeriesAbove": use_series_above,
    "holtWintersForecast": _hw(S.forecast), "holtWintersConfidenceBands": _hw(S.confidence_bands), "holtWintersConfidenceArea": _hw(S.confidence_area), "holtWintersAberration": _hw(S.aberration),
    "constantLine": lambda ctx, v: S.constantLine(ctx.spark, v, ctx.start, ctx.end),
    "threshold": lambda ctx, v, label=None, color=None: S.threshold(ctx.spark, v, ctx.start, ctx.end, label, color),
    "identity": lambda ctx, name: S.alias(_time(ctx, name), f'identity("{name}")'), "time": _time, "timeFunction": _time, "sin": _sin, "sinFunction": _sin,
    "randomWalk": _walk, "randomWalkFunction": _walk, "events": lambda ctx, *tags: S.events_series(ctx.spark, ctx.events, tags, ctx.start, ctx.end),
}

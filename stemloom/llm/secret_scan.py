"""Secret scanning with built-in expressions: fixed patterns, and entropy windows over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
#: kind -> pattern; spans are the whole matches, leftmost and non-overlapping within the kind.
#: The look-ahead only saves trying five words at every character.
ASSIGN = rf"""(?=[PpSsTtAa])({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of at least so many characters of these is a match of the shorter pattern, and the other way round:
#: both take a whole run of the class, from the run's start or its only possible start. The look-behind
#: keeps the search from trying again inside a run that was too short.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Values of assignments of fewer characters are dropped, after matching.
ASSIGN_CHARS = 12


@dataclass(frozen=True)
class CharClass:
    """Candidates that consist of ``letters``, and the entropy in bits that a window needs."""

    name: str
    letters: str
    least_bits: float


#: The first class that holds all of a candidate's characters counts.
CLASSES = (
    CharClass("digits", "0-9", 9.0),  # digits alone are amounts and numbers, however mixed: never reached
    CharClass("hex", "0-9A-Fa-f", 3.0),
    CharClass("alphanumeric", "0-9A-Za-z", 3.7),
    CharClass("base64", "0-9A-Za-z+/_=-", 3.8),
)
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Candidates that match one of these are known not to be secrets: words without a digit, joined words,
#: dates and times, UUIDs, runs of one character, and published example keys.
ALLOW = (
    r"^[^0-9]+$",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*[0-9]{0,4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_T][0-9-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
    r"EXAMPLE",
)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """(start, end, kind number) of each match: the pieces between matches and the matches take turns."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _placed(pieces, found, kind)


def _placed(pieces: Column, found: Column, kind: str) -> Column:
    at = F.aggregate(
        F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("n")),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,kind:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["end"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("end"),
            F.when(x["n"].isNull(), acc["spans"])
            .otherwise(F.concat(acc["spans"], F.array(F.struct((acc["end"] + x["gap"]).alias("start"), (acc["end"] + x["gap"] + x["n"]).alias("end"), F.lit(KINDS.index(kind)).alias("kind")))))
            .alias("spans"),
        ),
    )
    return at["spans"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _peak_entropy(text: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of any ``WINDOW`` characters in a row.

    Counts of the candidate's own characters are kept up: a step takes one character's count down
    and another's up, and changes the sum of c * log2(c) by the difference of table entries."""
    table = F.array(*(F.lit(float(c * log2(c)) if c else 0.0) for c in range(WINDOW + 2)))
    log = lambda c: F.get(table, c)

    def of_codes(codes: Column, counts: Column) -> Column:
        def slide(acc: Column, i: Column) -> Column:
            out, new = F.get(codes, i - WINDOW), F.get(codes, i)
            less, more = F.get(acc["counts"], out), F.get(acc["counts"], new)
            total = acc["sum"] - log(less) + log(less - 1) - log(more) + log(more + 1)
            moved = F.struct(
                F.transform(acc["counts"], lambda c, k: F.when(k == out, c - 1).when(k == new, c + 1).otherwise(c)).alias("counts"),
                total.alias("sum"), F.least(acc["least"], total).alias("least"),
            )
            return F.when(out == new, acc).otherwise(moved)

        total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + log(c))
        steps = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(WINDOW), F.size(codes) - 1)).otherwise(F.array().cast("array<int>"))
        start = _let(total, lambda s: F.struct(counts.alias("counts"), s.alias("sum"), s.alias("least")))
        return F.lit(log2(WINDOW)) - F.aggregate(steps, start, slide)["least"] / WINDOW

    def of_letters(letters: Column, alphabet: Column) -> Column:
        codes = F.transform(letters, lambda c: F.array_position(alphabet, c).cast("int") - 1)
        first = lambda codes: F.transform(alphabet, lambda _, k: F.size(F.filter(F.slice(codes, 1, WINDOW), lambda c: c == k)))
        return _let(codes, lambda codes: _let(first(codes), lambda counts: of_codes(codes, counts)))

    return _let(F.split(text, ""), lambda letters: _let(F.array_distinct(letters), lambda alphabet: of_letters(letters, alphabet)))


def _needed_bits(text: Column) -> Column:
    out = F.when(text.rlike(rf"^[{CLASSES[0].letters}]+$"), F.lit(CLASSES[0].least_bits))
    for x in CLASSES[1:]:
        out = out.when(text.rlike(rf"^[{x.letters}]+$"), F.lit(x.least_bits))
    return out


def _allowed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | text.rlike(pattern)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``_row``, its whole text as ``_t`` (null: empty), and ``_spans``: (start, end, kind) in code points.

    Spans are sorted by start, then kind as listed in ``KINDS``; spans of different kinds may
    overlap. Nulls, empty texts, repeated rows, ties and clashing columns are all taken row by row."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    t = F.col("_t")
    assign = F.filter(
        F.transform(F.arrays_zip(_spans(t, ASSIGN, "assign").alias("s"), F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), F.length).alias("n")), lambda x: F.when(x["n"] >= ASSIGN_CHARS, x["s"])),
        lambda s: s.isNotNull(),
    )
    candidates = F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, "entropy")).otherwise(none)
    d = d.select(
        "*",
        F.when(t.rlike(ASSIGN), assign).otherwise(none).alias("_assign"),
        F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, "access")).otherwise(none).alias("_access"),
        F.when(t.rlike(HEX), _spans(t, HEX, "hex")).otherwise(none).alias("_hex"),
        F.when(t.rlike(CANDIDATE), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_words"),
        candidates.alias("_candidates"),
    )
    # The allow-list goes first: only what it leaves is measured.
    judged = F.transform("_words", lambda w: F.when(~_allowed(w), _peak_entropy(w) >= _needed_bits(w)))
    entropy = F.filter("_candidates", lambda _, i: F.coalesce(F.get(F.col("_judged"), i), F.lit(False)))
    d = d.select("*", judged.alias("_judged"))
    d = d.select("_row", "_t", "_assign", "_access", "_hex", entropy.alias("_entropy"))
    return d.select(
        "_row", "_t",
        F.array_sort(F.concat("_assign", "_access", "_hex"), _by_start).alias("_base"),
        F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy"), _by_start).alias("_spans"),
    )


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return d.select(
        "_row.doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping or touching spans of ``text`` replaced by ``mark``.

    A text without spans, null included, stays as it is. ``n_chars``, where there is such a column,
    follows the text. Columns and their order stay."""
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    cut = F.aggregate(
        "_merged",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
    )
    d = scan(docs).select("_row", "_t", "_spans", merged.alias("_merged")).select("*", F.when(F.size("_merged") > 0, cut).alias("_cut"))
    text = F.when(F.col("_cut").isNull(), F.col("_row.text")).otherwise(F.concat("_cut.out", F.substring(F.col("_t"), F.col("_cut.at") + 1, F.length("_t"))))
    d = d.select("_row", text.alias("_new"))
    kinds = dict(docs.dtypes)
    own = {"text": F.col("_new")} | ({"n_chars": F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return d.select(*(own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))

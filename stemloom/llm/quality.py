"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_EDGES = ".,;:!?\"()"
#: So many repeated windows are looked for one by one; of more, all windows are sorted.
FEW = 48

#: Frequent function words of the corpus's languages; a running text holds some of them.
STOP_WORDS = tuple(
    dict.fromkeys(
        "the of and to a in is that it for as with was on be by this are or from at an not have had has but his he they which "
        "le la les de des du un une et en que qui dans pour sur au par est pas ce il elle avec plus ne se "
        "der die das und in zu den von mit ist im für auf ein eine dem nicht des sich als auch es an werden aus er hat dass "
        "el los las y del con no su para al lo como más pero sus o".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A text fails where ``measure`` is known and lies outside ``least`` to ``most``, both allowed."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds, in the manner of the published rules for web text.
RULES = (
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2, 12),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_share", least=0.06),
    Rule("upper_letter_share", most=0.5),
    Rule("dup_line_share", most=0.5),
    Rule("bullet_line_share", most=0.9),
    Rule("ellipsis_line_share", most=0.3),
    Rule("repeat_word_share", most=0.5),
)

#: Counts of a text, in the order in which ``verdict`` has them.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper", "n_letters", "n_bullet_lines", "n_ellipsis_lines")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(x: Column, *heads: str) -> Column:
    return reduce(Column.__or__, (x.startswith(h) for h in heads))


def _ends(x: Column, *tails: str) -> Column:
    return reduce(Column.__or__, (x.endswith(t) for t in tails))


def _words(text: Column) -> Column:
    # Between runs of blanks lie the words, and an empty string before or behind blanks at the ends.
    return F.array_remove(F.split(text, _BLANKS, -1), "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text holds twice or more.

    Windows are grouped by a 64-bit hash and then compared word by word, so that different windows
    never count as equal."""
    window = lambda i: [F.get(words, i + k) for k in range(3)]

    def covered(hashes: Column, twice: Column) -> Column:
        all_ = F.sequence(F.lit(0), F.size(hashes) - 1)
        places = F.when(F.size(twice) <= FEW, F.filter(all_, lambda i: F.array_contains(twice, F.get(hashes, i)))).otherwise(all_)
        return _let(F.sort_array(F.transform(places, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))), marked)

    def marked(ranked: Column) -> Column:
        def equal(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & reduce(Column.__and__, (a == b for a, b in zip(window(x["i"]), window(y["i"])))), F.lit(False))

        hits = F.filter(ranked, lambda x, k: equal(x, F.get(ranked, k + 1)) | ((k > 0) & equal(x, F.get(ranked, k - 1))))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(*(x["i"] + k for k in range(3)))))))

    def among(hashes: Column) -> Column:
        # Only a text that repeats a hash looks for the places of those that it repeats.
        doubled = lambda ranked: F.array_distinct(F.filter(ranked, lambda x, k: x.eqNullSafe(F.get(ranked, k + 1))))
        repeats = _let(F.sort_array(hashes), lambda ranked: _let(doubled(ranked), lambda twice: covered(hashes, twice)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeats).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*window(i)))
    return F.when(F.size(words) > 3, _let(hashes, among)).otherwise(0)


def _measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    stops = F.filter(F.split(F.lower(F.regexp_replace(F.array_join(words, " "), F.lit(f"[{_EDGES}]+"), F.lit(""))), " ", -1), lambda x: x.isin(*STOP_WORDS))
    within = lambda letters: F.length(text) - F.length(F.regexp_replace(text, F.lit(f"{letters}+"), F.lit("")))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": within(f"[{_SYMBOLS}]"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(stops),
        "n_upper": within(r"\p{Lu}"),
        "n_letters": within(r"\p{L}"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: _starts(F.ltrim(x, F.lit(" \t")), *"-*•‣◦"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: _ends(F.rtrim(x, F.lit(" \t\r")), "...", "…"))),
    }


def ratios(m: Column) -> dict[str, Column]:
    """What the rules measure; null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(m[a].cast("double"), m[b].cast("double"))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "upper_letter_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "bullet_line_share": share("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
    }


def _judged(m: Column, rules: tuple[Rule, ...]) -> Column:
    known = ratios(m)
    broken = []
    for rule in rules:
        value = known[rule.measure]
        tests = ([value < rule.least] if rule.least is not None else []) + ([value > rule.most] if rule.most is not None else [])
        broken.append(F.when(reduce(Column.__or__, tests), F.lit(rule.measure)))
    base = (m["n_words"] < 50) | (F.lit(100) * m["n_repeat_words"] > F.lit(50) * m["n_words"])
    failed = F.concat_ws(",", *broken)
    return F.struct(*(m[n].alias(n) for n in MEASURES), base.alias("base_failed"), failed.alias("failed_rules"), (~base & (failed == "")).alias("kept"))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct for a text: its counts, ``base_failed``, ``failed_rules`` (comma-joined) and ``kept``.

    The rules and all they measure are a single expression of built-in functions; words and lines
    live while a row is evaluated and are never columns. Null is no words."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    counted = lambda t, w, ln: F.struct(*(c.cast("long").alias(n) for n, c in _measures(t, w, ln).items()))
    return _let(whole, lambda t: _let(_words(t), lambda w: _let(lines(t), lambda ln: _let(counted(t, w, ln), lambda m: _judged(m, rules)))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """Every document's columns (or those of ``carry``) as ``_row`` beside its ``_verdict``, in one projection.

    A null or empty text has no words and fails. Nulls elsewhere, repeated rows and ids, and extra
    columns (also of the same names as the counts) change nothing: each row is judged alone, so
    there are no ties. Very long texts are judged whole. An empty table gives no rows."""
    held = docs.columns if carry is None else carry
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in held)).alias("_row"), verdict(F.col("`text`"), rules).alias("_verdict"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    d = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return d.select("_row.doc_id", *(f"_verdict.{c}" for c in (*MEASURES[:5], "base_failed", "kept", "failed_rules")))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns; see ``judge`` for edge cases."""
    return docs.where(verdict(F.col("`text`"), rules)["kept"])


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    value = {
        "n_words": "n_words",
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbols_per_word": "n_symbols / nullif(n_words, 0)",
        "stop_word_share": "n_stop_words / nullif(n_words, 0)",
        "upper_letter_share": "n_upper / nullif(n_letters, 0)",
        "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
        "bullet_line_share": "n_bullet_lines / nullif(n_lines, 0)",
        "ellipsis_line_share": "n_ellipsis_lines / nullif(n_lines, 0)",
        "repeat_word_share": "n_repeat_words / nullif(n_words, 0)",
    }
    broken = []
    for x in rules:
        tests = ([f"{value[x.measure]} < {x.least}"] if x.least is not None else []) + ([f"{value[x.measure]} > {x.most}"] if x.most is not None else [])
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{x.measure}' END")
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS l FROM d),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
windows AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS s FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, s, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows WHERE s IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(translate(t, {spaces}, '')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: lower(translate(x, '.,;:!?"()', '')) IN ({stops}))) AS n_stop_words,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}\x{{2023}}\x{{25E6}}]'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN covered c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(broken)}) AS failed_rules FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""

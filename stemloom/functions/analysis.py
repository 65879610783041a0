"""Analyzers put together from parts: character filters, a tokenizer and token filters.

A part is a function from a column to a column; ``Analyzer`` chains them into one projection. Tokens are
an array of (pos, term): filters that drop a token leave its position, and those that give
several terms for a token give them the same position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemloom.functions import text as T

Part = Callable[[Column], Column]


def replace_characters(search: str, replacement: str) -> Part:
    """Each character of ``search`` becomes that of ``replacement`` at its place; a blank there deletes it."""
    if len(search) != len(replacement):
        raise ValueError("search and replacement need the same length")
    kept = [(a, b) for a, b in zip(search, replacement) if b != " "]
    gone = "".join(a for a, b in zip(search, replacement) if b == " ")
    return lambda c: F.translate(c, "".join(a for a, _ in kept) + gone, "".join(b for _, b in kept))


def replace_regex(pattern: str, replacement: str) -> Part:
    return lambda c: F.regexp_replace(c, pattern, replacement)


def _placed(terms: Column) -> Column:
    return F.transform(terms, lambda x, i: F.struct(i.alias("pos"), x.alias("term")))


def standard_tokenizer(c: Column) -> Column:
    return _placed(F.regexp_extract_all(c, F.lit(T.TOKEN), F.lit(0)))


def whitespace_tokenizer(c: Column) -> Column:
    return _placed(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def each(term: Part) -> Part:
    """Another term at each place."""
    return lambda tokens: F.transform(tokens, lambda x: F.struct(x["pos"].alias("pos"), term(x["term"]).alias("term")))


lowercase = each(F.lower)


def stop(words: tuple[str, ...]) -> Part:
    return lambda tokens: F.filter(tokens, lambda x: ~x["term"].isin(*words))


def _several(terms: Callable[[Column], Column]) -> Part:
    return lambda tokens: F.flatten(F.transform(tokens, lambda x: F.transform(terms(x["term"]), lambda t: F.struct(x["pos"].alias("pos"), t.alias("term")))))


def synonyms(groups: dict[str, tuple[str, ...]]) -> Part:
    """A word of the table becomes all words of its entry, at its place."""

    def part(tokens: Column) -> Column:
        if not groups:
            return tokens
        table = F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return _several(lambda t: F.coalesce(F.element_at(table, t), F.array(t)))(tokens)

    return part


def latin_numbers(c: Column) -> Column:
    """Strict Roman numerals as decimal numbers, other words as they are."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    digits = F.transform(F.split(F.lower(c), ""), lambda x: F.element_at(F.create_map(*(F.lit(y) for kv in values.items() for y in kv)), x))
    # A digit counts against what follows it where that is larger.
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, d: F.struct((a["sum"] + d - F.when(a["last"] < d, 2 * a["last"]).otherwise(0)).alias("sum"), d.alias("last")))
    return F.when(F.lower(c).rlike(T._ROMAN) & (c != ""), total["sum"].cast("string")).otherwise(c)


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Part = standard_tokenizer
    char_filters: tuple[Part, ...] = ()
    filters: tuple[Part, ...] = field(default_factory=tuple)

    def __call__(self, text: Column) -> Column:
        """The tokens of a text, an array of (pos, term); null for null."""
        raw = reduce(lambda c, part: part(c), self.char_filters, text)
        return reduce(lambda c, part: part(c), self.filters, self.tokenizer(raw))


def query_analyzer(stops: tuple[str, ...] = (), table: dict[str, tuple[str, ...]] | None = None) -> Analyzer:
    """What a query's words go through: stops and synonyms, whatever their case, lower case, Roman numerals as numbers."""
    return Analyzer(filters=(lowercase, stop(stops), synonyms(table or {}), each(latin_numbers)))

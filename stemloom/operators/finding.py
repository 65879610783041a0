"""Finding things by what people type: sets of passages by a query, nodes of the metric tree, pages of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.functions import text as T
from stemloom.plans.language import component_regex, is_pattern

_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND\b|&&)|(OR\b|\|\|)|(NOT\b|!|-(?=\S))|(?:(\*|[A-Za-z_]\w*):)?(?:"([^"]*)"|\[(\S+)\s+TO\s+(\S+)\]|([^\s()"]+)))')


class QueryError(ValueError):
    pass


def query_condition(query: str, fields: tuple[str, ...] = ("volume", "lang", "seg_id"), text: str = "text") -> Column:
    """A condition from a query: field:value, field:"a phrase", field:[a TO b] (* for open), words of the text,
    *:* for all, with AND (the default between terms), OR, NOT or -, and parentheses. Values may end in *."""
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"cannot read {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek(group: int) -> bool:
        return place < len(tokens) and tokens[place][group] is not None

    def take() -> re.Match:
        nonlocal place
        if place >= len(tokens):
            raise QueryError(f"{query!r} ends too early")
        place += 1
        return tokens[place - 1]

    def either() -> Column:
        out = both()
        while peek(4):
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while place < len(tokens) and not peek(2) and not peek(4):
            if peek(3):
                take()
            out = out & single()
        return out

    def single() -> Column:
        if peek(5):
            take()
            return ~single()
        m = take()
        if m[1]:
            out = either()
            if not take()[2]:
                raise QueryError(f"')' expected in {query!r}")
            return out
        if m[2] or m[3] or m[4]:
            raise QueryError(f"a term expected in {query!r}")
        return term(m)

    def term(m: re.Match) -> Column:
        name, phrase, low, high, value = m[6], m[7], m[8], m[9], m[10]
        if name == "*" or (name is None and value == "*"):
            return F.lit(True)
        if name is None or name == text:
            words = F.regexp_extract_all(F.lower(text), F.lit(T.TOKEN), F.lit(0))
            if phrase is not None:
                return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(re.findall(r'\w+', phrase.lower()))} "))
            if value and value.endswith("*"):
                return F.exists(words, lambda w: w.startswith(value[:-1].lower()))
            return F.array_contains(words, (value or "").lower())
        if name not in fields:
            raise QueryError(f"unknown field {name!r}")
        c = F.col(name)
        if low is not None:
            ends = [c >= low] * (low != "*") + [c <= high] * (high != "*")
            return F.coalesce(ends[0] & ends[-1], F.lit(False)) if ends else c.isNotNull()
        if value is not None and value.endswith("*"):
            return F.coalesce(c.cast("string").startswith(value[:-1]), F.lit(False))
        return c.eqNullSafe(F.lit(phrase if phrase is not None else value).cast("string")) if name != "seg_id" else c.eqNullSafe(F.lit(int(phrase or value)))

    if not tokens:
        return F.lit(True)
    out = either()
    if place != len(tokens):
        raise QueryError(f"too many parentheses in {query!r}")
    return out


def doc_set(passages: DataFrame, query: str, enabled_only: bool = False) -> DataFrame:
    """The passages that a query finds; ``enabled_only`` leaves out those whose volume is switched off (a column ``enabled``)."""
    out = passages.where(query_condition(query))
    return out.where(F.col("enabled")) if enabled_only else out


def search_response(found: DataFrame, order: list[str], start: int = 0, rows: int = 10) -> DataFrame:
    """One row: num_found, start, and docs, the page's rows as a json array in ``order``. A page is bounded by ``rows``."""
    page = found.orderBy(*order).limit(start + rows)
    docs = F.slice(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*found.columns)).alias("doc")))), start + 1, rows)
    listed = page.agg(F.concat(F.lit("["), F.array_join(F.transform(docs, lambda x: x["doc"]), ","), F.lit("]")).alias("docs"))
    return found.agg(F.count(F.lit(1)).alias("num_found")).withColumn("start", F.lit(start).cast("long")).crossJoin(listed)  # one row each


def page_links(active: int, pages: int, most: int = 9) -> list[int]:
    """The page numbers to show: at most ``most`` around the active one."""
    first = max(1, min(active - most // 2, pages - most + 1))
    return list(range(first, min(pages, first + most - 1) + 1))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values of ``key`` with the place at which each occurs first."""
    return df.groupBy(key).agg(F.min(order).alias(order))


# The metric tree.


def find_nodes(metrics: DataFrame, pattern: str) -> DataFrame:
    """(path, name, is_leaf): nodes of the tree whose components match the pattern's, each path once for each kind."""
    parts = pattern.split(".") if "{" not in pattern else re.split(r"\.(?![^{]*\})", pattern)
    at = F.split("path", r"\.")
    hit = F.size(at) >= len(parts)
    for i, part in enumerate(parts):
        c = F.get(at, F.lit(i))
        hit = hit & (c.rlike(f"^{component_regex(part)}$") if is_pattern(part) else c == part)
    # A literal head narrows the scan.
    head = re.match(r"[^*?\[{]*", pattern)[0]
    d = metrics.where(F.col("path").startswith(head)) if head else metrics
    node = F.array_join(F.slice(at, 1, len(parts)), ".")
    return d.where(hit).select(node.alias("path"), F.get(at, F.lit(len(parts) - 1)).alias("name"), (F.size(at) == len(parts)).alias("is_leaf")).distinct()


def find_first(metrics: DataFrame, path: str) -> DataFrame:
    """The node of a literal path: one row, a leaf before a branch, or none."""
    if is_pattern(path):
        raise ValueError("a literal path is needed")
    return find_nodes(metrics, path).orderBy(F.desc("is_leaf")).limit(1)


def tree_nodes(metrics: DataFrame, pattern: str, wildcards: bool = False) -> DataFrame:
    """(text, id, leaf): the nodes as a tree shows them, branches before leaves, by name; a name that is both is a
    branch alone. ``wildcards``: a node "*" first if there are several, a leaf if all are."""
    base = pattern.rsplit(".", 1)[0] + "." if "." in pattern else ""
    nodes = find_nodes(metrics, pattern).groupBy("name").agg(F.min("is_leaf").alias("is_leaf"))
    out = nodes.select(F.col("name").alias("text"), F.concat(F.lit(base), "name").alias("id"), F.col("is_leaf").cast("int").alias("leaf"), F.lit(1).alias("_k"))
    if wildcards:
        star = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("is_leaf").cast("int").alias("leaf")).where("n > 1")
        out = out.unionByName(star.select(F.lit("*").alias("text"), F.lit(base + "*").alias("id"), "leaf", F.lit(0).alias("_k")))
    return out.orderBy("_k", "leaf", "text").drop("_k")


def completions(metrics: DataFrame, query: str, variants: bool = False) -> DataFrame:
    """(path, name, is_leaf): what a query may be completed to; the path of a branch ends in a dot."""
    query = query.replace("..", "*.")
    query += "" if query.endswith("*") else "*"
    if variants:
        query = ".".join(f"{{{p}}}" if "," in p and "{" not in p else p for p in query.split("."))
    d = find_nodes(metrics, query)
    return d.select(F.concat("path", F.when(F.col("is_leaf"), "").otherwise(".")).alias("path"), "name", F.col("is_leaf").cast("int").cast("string").alias("is_leaf")).orderBy("name")


def expand(metrics: DataFrame, patterns: list[str], leaves_only: bool = False) -> DataFrame:
    """(query, path): the distinct nodes of each pattern."""
    out = None
    for p in patterns:
        d = find_nodes(metrics, p)
        d = (d.where("is_leaf") if leaves_only else d).select(F.lit(p).alias("query"), "path").distinct()
        out = d if out is None else out.unionByName(d)
    return out


def subtree_search(metrics: DataFrame, prefix: str, pattern: str, most: int = 25) -> DataFrame:
    """The first ``most`` distinct paths, by name, below a prefix that a regular expression finds in any case."""
    d = metrics.where(F.col("path").startswith(prefix + ".")) if prefix else metrics
    return d.where(F.col("path").rlike(f"(?i){pattern}")).select("path").distinct().orderBy("path").limit(most)


# Events.


def posted_events(lines: DataFrame, now: int) -> DataFrame:
    """(what, tags, when, data) of posted json objects (``value``); ``when`` defaults to now, and what is no object or has no "what" is refused."""
    fields = F.from_json("value", "what string, tags string, `when` double, data string")
    d = lines.select(fields.alias("e")).where("e.what IS NOT NULL")
    return d.select("e.what", "e.tags", F.timestamp_seconds(F.coalesce("e.when", F.lit(float(now)))).alias("when"), "e.data")


def naive(when: Column, zone: str) -> Column:
    """An instant as the wall clock of a zone shows it, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), when)

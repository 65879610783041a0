"""Passages, tokens, lexicon and corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions import text as T
from stemloom.scratch import Scratch


def segments(docs: DataFrame) -> DataFrame:
    """(seg_id, volume, lang, text): the lines with something on them, seg_id = doc_id * 100000 + line."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.trim("line") != "").select((F.col("doc_id") * 100000 + F.col("n")).alias("seg_id"), F.col("source").alias("volume"), "lang", F.col("line").alias("text"))


def tokens(passages: DataFrame, key: str = "seg_id") -> DataFrame:
    """``passages``' columns but text, with pos and form: lower-cased, folded, digits dropped.

    A token of digits alone leaves an empty form, which holds its position."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0))
    others = [c for c in passages.columns if c != "text"]
    d = passages.select(*others, F.posexplode(words).alias("pos", "w"))
    return d.select(*others, F.col("pos").cast("long").alias("pos"), F.translate("w", "vj0123456789", "ui").alias("form"))


def with_stems(toks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """A row per stem of each token, numbered ``nth`` from 0: of the lexicon (key, stems), else by the noun rules; a miss is its own stem."""
    if lexicon is None:
        return toks.withColumns({"stem": F.expr(T.stem_noun("form")), "nth": F.lit(0)})
    hit = toks.join(lexicon.select(F.col("key").alias("form"), "stems"), "form", "left")
    return hit.select(*toks.columns, F.posexplode(F.coalesce("stems", F.array("form"))).alias("nth", "stem"))


def forms_of(text: str = "text") -> Column:
    """The forms of a text in order, as an array: those of ``tokens``."""
    words = F.regexp_extract_all(F.lower(text), F.lit(T.TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.translate(w, "vj0123456789", "ui"))


def stems_of(forms: str) -> Column:
    """The stems of an array of forms by the noun rules, in its order."""
    return F.expr(f"transform({forms}, x -> {T.stem_noun('x')})")


def by_key(passages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``passages`` whose seg_id no other row has, and the others; None where there are none.

    What is counted once a passage is counted inside the row of the former, without dealing out a token.
    Ids repeat where a document's does, or where one has more than 100 000 lines."""
    often = passages.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("seg_id").alias("_id"))
    often = scratch.write(often, "repeated")
    if often.isEmpty():
        return passages, None
    same = F.col("seg_id").eqNullSafe(F.col("_id"))
    return passages.join(often, same, "left_anti"), passages.join(often, same, "left_semi")


def flagged(once: DataFrame, more: DataFrame | None, first: bool = False) -> DataFrame:
    """(seg_id, form, stem, pos, first, span) of every token by the noun rules, or of the first alone; once, more: passages ``by_key``.

    first: whether it is the first of its stem in its passage; span: from the passage's first token to its last, both included."""
    d = once.select("seg_id", forms_of().alias("_f")).select("seg_id", F.size("_f").cast("long").alias("span"), F.sort_array(F.expr(f"transform(_f, (x, i) -> struct({T.stem_noun('x')} AS stem, i AS pos, x AS form))")).alias("_a"))
    new = "i = 0 OR element_at(_a, i).stem != x.stem"
    each = f"filter(_a, (x, i) -> {new})" if first else "_a"
    d = d.select("seg_id", "span", F.expr(f"inline(transform({each}, (x, i) -> struct(x.form AS form, x.stem AS stem, cast(x.pos AS BIGINT) AS pos, {'true' if first else new} AS first)))"))
    d = d.select("seg_id", "form", "stem", "pos", "first", "span")
    if more is None:
        return d
    toks = with_stems(tokens(more))
    span = toks.groupBy(F.col("seg_id").alias("_id")).agg((F.max("pos") - F.min("pos") + 1).alias("span"))
    seen = stem_occurrences(toks).withColumn("first", F.lit(True))
    if not first:
        at = Window.partitionBy("seg_id", "stem").orderBy("pos", "form")
        seen = toks.withColumn("first", F.row_number().over(at) == 1)
    return d.unionByName(seen.join(span, F.col("seg_id").eqNullSafe(F.col("_id"))).select(*d.columns))


def latin_stems(words: DataFrame, column: str) -> DataFrame:
    """The columns of ``words`` with part and stem: of each word its noun's stem, then its verb's."""
    both = F.array(*(F.struct(F.lit(part).alias("part"), F.expr(stem(column)).alias("stem")) for part, stem in (("n", T.stem_noun), ("v", T.stem_verb))))
    return words.select(*words.columns, F.explode(both).alias("_s")).select(*words.columns, "_s.*")


def term_vectors(passages: DataFrame) -> DataFrame:
    """(seg_id, term, pos, start, end): every token of a passage with its place and its characters' offsets, end exclusive."""
    low = F.lower("text")
    words, gaps = F.regexp_extract_all(low, F.lit(T.TOKEN), F.lit(0)), F.split(low, T.TOKEN, -1)
    d = passages.select("seg_id", F.posexplode(F.arrays_zip(words.alias("term"), F.slice(gaps, 1, F.size(words)).alias("gap"))).alias("pos", "x")).select("seg_id", F.col("pos").cast("long").alias("pos"), "x.term", "x.gap")
    w = Window.partitionBy("seg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.length("term")).over(w)
    return d.withColumn("end", end).select("seg_id", "term", "pos", (F.col("end") - F.length("term")).alias("start"), "end")


def build_lexicon(rows: DataFrame, how: str = "full") -> DataFrame:
    """(key, stems) of (token, pos, stem) rows: distinct stems in order; "sum" stands alone wherever it occurs."""
    d = rows.select(F.expr(T.normalise("token", how)).alias("key"), F.expr(T.normalise("stem")).alias("stem"))
    stems = F.array_sort(F.collect_set("stem"))
    return d.groupBy("key").agg(F.when(F.array_contains(stems, "sum"), F.array(F.lit("sum"))).otherwise(stems).alias("stems"))


def term_counts(staged: DataFrame) -> DataFrame:
    """(term, n): occurrences of every stem, and of every form with "_" before it."""
    # A token's first row stands for its form: no shuffle is needed to take its other stems back.
    terms = F.when(F.col("nth") == 0, F.array("stem", F.concat(F.lit("_"), F.col("form")))).otherwise(F.array("stem"))
    return staged.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, n: int, forms: bool = False) -> DataFrame:
    is_form = F.col("term").startswith("_")
    return counts.where(is_form if forms else ~is_form).orderBy(F.desc("n"), "term").limit(n)


def stem_occurrences(staged: DataFrame) -> DataFrame:
    """One form for each (passage, stem): its first occurrence."""
    first = F.min_by(F.struct("form", "pos"), "pos")
    return staged.groupBy("seg_id", "stem").agg(first.alias("f")).select("seg_id", "stem", F.col("f.form").alias("form"), F.col("f.pos").alias("pos"))


def form_frequencies(toks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(form, cf, freq): occurrences of all forms that share a stem with the form, itself included, and their share of all occurrences."""
    return shared_frequencies(toks.groupBy("form").agg(F.count(F.lit(1)).alias("cw")), occurrences.select("form", "stem").distinct())


def shared_frequencies(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """The same of (form, cw), the occurrences of each form, and (form, stem), the distinct forms and stems of first occurrences."""
    pairs = edges.alias("a").join(edges.select(F.col("form").alias("other"), "stem"), "stem").select("form", "other").distinct()
    total = counts.agg(F.sum("cw").alias("total"))
    shared = pairs.join(counts.select(F.col("form").alias("other"), "cw"), "other").groupBy("form").agg(F.sum("cw").alias("cf"))
    d = shared.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    return d.select("form", "cf", (F.col("cf") / F.col("total")).alias("freq"))


def tess_lines(lines: DataFrame) -> DataFrame:
    """(n, text, line) of lines "<label> TAB text" in a file's order ``n``; other lines are skipped.

    The line's number is the end of its label, 0 where that is no number."""
    d = lines.select("n", F.trim(F.translate("value", "\r", "")).alias("v")).where(F.col("v").rlike(r"^<[^>]+>\t"))
    label, number = F.regexp_extract("v", r"^<([^>]+)>\t(.*)$", 1), r"([0-9]+)(-([0-9]+))?$"
    return d.select("n", F.regexp_extract("v", r"^<([^>]+)>\t(.*)$", 2).alias("text"), F.coalesce(F.nullif(F.regexp_extract(label, number, 1), F.lit("")), F.lit("0")).alias("line"))


def sentences(lines: DataFrame, key: str) -> DataFrame:
    """(key, sentence, start, end): lines (key, n, text, line) cut at . ? ! ; : inside each key.

    A sentence starts on the line of its first part, which is the line before where a delimiter
    ended that; what follows the last delimiter is not given."""
    cut = F.split(F.regexp_replace(F.trim("text"), "([.?!;:])", "\u0001$1\u0001"), "\u0001", -1)
    parts = lines.select(key, "n", "line", F.posexplode(cut).alias("p", "part"))
    mark = F.col("part").rlike("^[.?!;:]$")
    w = Window.partitionBy(key).orderBy("n", "p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("mark", mark).withColumn("s", F.coalesce(F.sum(F.col("mark").cast("int")).over(w), F.lit(0)))
    item = F.struct("n", "p", "part", "line")
    texts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("mark"), item))), lambda x: x["part"])
    g = parts.groupBy(key, "s").agg(
        F.array_join(texts, " ").alias("t"), F.min_by("line", F.when(~F.col("mark"), F.struct("n", "p"))).alias("start"),
        F.max(F.when(F.col("mark"), F.col("part"))).alias("d"), F.max_by("line", F.when(F.col("mark"), F.struct("n", "p"))).alias("end"),
    )
    return g.where("d IS NOT NULL AND trim(t) != ''").select(key, F.col("s").cast("long").alias("s"), F.trim(F.concat("t", "d")).alias("sentence"), "start", "end")


def ngrams(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """``gram``: every substring of ``least`` to ``most`` characters of the lower-cased value."""
    low = f"lower({column})"
    grams = f"flatten(transform(sequence({least}, {most}), n -> transform(CASE WHEN length({low}) >= n THEN sequence(1, length({low}) - n + 1) ELSE cast(array() AS array<int>) END, i -> substr({low}, i, n))))"
    return df.withColumn("gram", F.explode(F.expr(grams)))


def edge_ngrams(df: DataFrame, column: str, most: int = 15) -> DataFrame:
    """``gram``: the first 1 to ``most`` characters of each part of the value, cut where case or kind changes."""
    parts = F.regexp_extract_all(F.col(column), F.lit("([A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))
    d = df.withColumn("_part", F.explode(parts))
    grams = f"transform(sequence(1, least({most}, length(_part))), n -> lower(substr(_part, 1, n)))"
    return d.withColumn("gram", F.explode(F.expr(grams))).drop("_part")


def autocomplete(df: DataFrame, column: str, query: str, n: int = 5) -> DataFrame:
    """The values that hold the query in any case, nearest by edit distance first."""
    d = df.where(F.lower(column).contains(query.lower())).select(F.col(column).alias("value")).distinct()
    return d.withColumn("distance", F.levenshtein("value", F.lit(query)).cast("long")).orderBy("distance", "value").limit(n)


def suggest_terms(toks: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return toks.where(F.col("form").startswith(prefix)).groupBy("form").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "form").limit(n)


def more_like_this(toks: DataFrame, seg_id: int, n: int = 10) -> DataFrame:
    """Other passages by the number of distinct forms that they share with one."""
    own = toks.where(F.col("seg_id") == seg_id).select("form").distinct()
    others = toks.where(F.col("seg_id") != seg_id).select("seg_id", "form").distinct()
    return others.join(own, "form").groupBy("seg_id").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "seg_id").limit(n)


def match_all(passages: DataFrame, query: str) -> DataFrame:
    """Passages that hold every word of the query."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0))
    out = passages.withColumn("_w", words)
    for w in query.lower().split():
        out = out.where(F.array_contains("_w", w))
    return out.drop("_w")


def find_events(events: DataFrame, start: str, until: str, tags: list[str]) -> DataFrame:
    """Events from ``start`` to ``until``, both included, with all of the tags."""
    d = events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(until).cast("timestamp_ntz")))
    for t in tags:
        d = d.where(F.array_contains("tags", t))
    return d


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming``, and those of ``current`` whose key (in any case) it has not."""
    low = lambda d: d.select(*(F.lower(F.col(k).cast("string")).alias(k) for k in keys)).distinct()
    new = low(incoming).select(*(F.col(k).alias(f"_{k}") for k in keys))
    on = [F.lower(F.col(k).cast("string")).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return current.join(new, cond, "left_anti").unionByName(incoming)


def upsert_works(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` put in by their exact keys, and ``written``: whether a row is new or has changed.

    incoming: each key once. A row that comes again as it is counts as not written."""
    rest = [c for c in current.columns if c not in keys]
    a = current.select(*(F.col(c).alias(f"a_{c}") for c in current.columns), F.lit(True).alias("_a"))
    b = incoming.select(*(F.col(c).alias(f"b_{c}") for c in current.columns), F.lit(True).alias("_b"))
    on = reduce(lambda x, y: x & y, (F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys))
    d = a.join(b, on, "full")
    changed = reduce(lambda x, y: x | y, (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in rest), F.lit(False))
    new = F.col("_b").isNotNull()
    return d.select(*(F.when(new, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in current.columns), (new & (F.col("_a").isNull() | changed)).alias("written"))


def index_search(metrics: DataFrame, patterns: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` paths, by name, that any of the regular expressions finds, in any case."""
    hit = F.lit(False)
    for x in patterns:
        hit = hit | F.col("path").rlike(f"(?i){x}")
    return metrics.where(hit).select("path").distinct().orderBy("path").limit(n)


def name_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose name holds every word of the query."""
    for w in query.lower().split():
        df = df.where(F.lower(column).contains(w))
    return df


def tree_children(metrics: DataFrame, prefix: str) -> DataFrame:
    """(node, is_leaf): the next level of the dotted tree below ``prefix``, branches and leaves apart."""
    depth = len(prefix.split(".")) if prefix else 0
    below = metrics.where(F.col("path").startswith(prefix + ".")) if prefix else metrics
    parts = F.split("path", r"\.")
    return below.select(F.get(parts, F.lit(depth)).alias("node"), (F.size(parts) == depth + 1).alias("is_leaf")).distinct()


def ring_nodes(keys: DataFrame, nodes: list[str], replicas: int = 100) -> DataFrame:
    """(key, node) on a consistent-hash ring: the node of the first replica at or after the key's place.

    The ring is a table of at most 65 536 places; a key finds its node by an equality join on its place."""
    spark = keys.sparkSession
    place = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("long")
    ring = spark.createDataFrame([(n,) for n in nodes], "node string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    ring = ring.groupBy(place(F.concat_ws(":", "node", F.col("i").cast("string"))).alias("at")).agg(F.min("node").alias("node"))
    first = ring.agg(F.min_by("node", "at").alias("first"))
    w = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    places = spark.range(0, 1 << 16).withColumnRenamed("id", "at").join(ring, "at", "left")
    places = places.select("at", F.last("node", True).over(w).alias("node")).crossJoin(F.broadcast(first))  # one row
    return keys.withColumn("at", place(F.col("key"))).join(F.broadcast(places), "at").select("key", F.coalesce("node", "first").alias("node"))


def unescape_html(c: Column) -> Column:
    """The named references of markup as characters, and no control characters."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")

"""Queries over passages, stems, lexicons and names made of the driver's tables, each with its SQL.

Passages are the lines of ``documents``; the lexicon is made of the words' own noun and verb stems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import text as T
from stemloom.operators import compare as CMP
from stemloom.operators import corpus as C
from stemloom.scratch import Scratch

LANG, SOURCE, TARGET = "en", "src0", "src1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments(table(spark, sf_dir, "documents"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_stems(C.tokens(passages(spark, sf_dir)))


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n) of stems alone, written: tokens are counted by form, and no filter on stems is pushed down to them."""
    forms = C.tokens(passages(spark, sf_dir)).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return Scratch(spark, "stems").write(C.with_stems(forms).groupBy(F.col("stem").alias("term")).agg(F.sum("n").alias("n")), "counts")


def side(spark: SparkSession, sf_dir: str, volume: str) -> DataFrame:
    return passages(spark, sf_dir).where((F.col("lang") == LANG) & (F.col("volume") == volume))


def compared(p: CMP.Params, source: str = SOURCE, target: str = TARGET) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sides = {v: CMP.side_of_passages(side(spark, sf_dir, v), Scratch(spark, "compare")) for v in (source, target)}
        return CMP.compare_sides(sides[source], sides[target], stem_counts(spark, sf_dir) if p.given_stops() is None else None, p)

    return run


def _with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of pairs with what is stored of both passages."""
    page = Scratch(spark, "page").write(COMPARED["compare_freq"](spark, sf_dir), "page")
    return CMP.with_fields(page, passages(spark, sf_dir), ["volume", "text"], ["lang", "text"])


TOKENS = rf"""seg AS (SELECT doc_id * 100000 + i - 1 AS seg_id, source AS volume, lang, l AS text FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l, ' ') <> ''),
tok AS (SELECT seg_id, volume, lang, pos, translate(w, 'vj0123456789', 'ui') AS form FROM (SELECT seg_id, volume, lang, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT seg_id, volume, lang, regexp_extract_all(lower(text), '{T.TOKEN}') AS w FROM seg))),
st AS MATERIALIZED (SELECT *, {T.stem_noun('form')} AS stem FROM tok)"""


def with_tokens(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([TOKENS, *more]) + "\n" + body


def compare_sql(p: CMP.Params, source: str = SOURCE, target: str = TARGET, body: str = "SELECT * FROM page") -> str:
    given = p.given_stops()
    if p.stop_words <= 0:
        stops = "SELECT NULL AS stem WHERE false"
    elif given is None:
        stops = f"SELECT stem FROM st GROUP BY stem ORDER BY count(*) DESC, stem LIMIT {p.stop_words}"
    else:
        stops = "SELECT unnest([" + ", ".join(f"'{w}'" for w in given) + "]) AS stem"
    parts = [f"stops AS ({stops})"]
    for x, volume in (("s", source), ("t", target)):
        parts += [
            f"{x}_tok AS (SELECT * FROM st WHERE lang = '{LANG}' AND volume = '{volume}')",
            f"{x}_occ AS (SELECT seg_id, stem, arg_min(form, pos) AS form, min(pos) AS pos FROM {x}_tok GROUP BY ALL)",
            f"{x}_cw AS (SELECT form, count(*) AS cw FROM {x}_tok GROUP BY form)",
            f"{x}_edge AS (SELECT DISTINCT form, stem FROM {x}_occ)",
            f"{x}_freq AS (SELECT form, sum(cw) / (SELECT sum(cw) FROM {x}_cw) AS freq FROM (SELECT DISTINCT a.form, b.form AS other FROM {x}_edge a JOIN {x}_edge b USING (stem)) p JOIN (SELECT form AS other, cw FROM {x}_cw) USING (other) GROUP BY form)",
            f"{x}_left AS (SELECT o.*, freq FROM {x}_occ o LEFT JOIN {x}_freq USING (form) WHERE stem NOT IN (SELECT stem FROM stops))",
        ]
    parts.append("met AS MATERIALIZED (SELECT s.seg_id AS sdoc, t.seg_id AS tdoc, stem, s.pos AS spos, s.form AS sform, s.freq AS sfreq, t.pos AS tpos, t.form AS tform, t.freq AS tfreq FROM s_left s JOIN t_left t USING (stem) WHERE s.seg_id <> t.seg_id)")
    for x in "st":
        parts += [
            f"{x}_at AS (SELECT sdoc, tdoc, {x}pos AS pos, {x}form AS form, {x}freq AS freq, string_agg(DISTINCT stem, '-' ORDER BY stem) AS stems FROM met GROUP BY ALL)",
            f"{x}_pair AS (SELECT sdoc, tdoc, sum(1 / freq) AS inv, list(stems) AS stems FROM {x}_at GROUP BY ALL HAVING count(*) >= {p.min_common} AND count(DISTINCT form) >= 2)",
            f"{x}_near AS (SELECT sdoc, tdoc, max(pos) - min(pos) + 1 AS d FROM (SELECT sdoc, tdoc, form, min(pos) AS pos, row_number() OVER (PARTITION BY sdoc, tdoc ORDER BY freq, form) AS r FROM {x}_at GROUP BY sdoc, tdoc, form, freq) WHERE r <= 2 GROUP BY ALL)",
            f"{x}_span AS (SELECT seg_id AS {x}doc, max(pos) - min(pos) + 1 AS d FROM {x}_tok GROUP BY ALL HAVING count(DISTINCT pos) > 1)",
        ]
    metric = p.metric.lower().replace(" ", "_")
    near = "s_near s USING (sdoc, tdoc) LEFT JOIN t_near t USING (sdoc, tdoc)" if metric.startswith("freq") else "s_span s USING (sdoc) LEFT JOIN t_span t USING (tdoc)"
    distance = "s.d" if metric.endswith("source") else "t.d" if metric.endswith("target") else "s.d + t.d"
    cap = f"AND distance <= {p.max_distance}" if p.max_distance > 0 else ""
    parts += [
        "both_ AS (SELECT sdoc, tdoc, a.inv + b.inv AS inv, list_sort(list_distinct(list_concat(a.stems, b.stems))) AS terms FROM s_pair a JOIN t_pair b USING (sdoc, tdoc))",
        "one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY least(sdoc, tdoc), greatest(sdoc, tdoc)) AS n FROM both_) WHERE n = 1 OR sdoc < tdoc)",
        f"far AS (SELECT one.sdoc, one.tdoc, inv, terms, {distance} AS distance FROM one LEFT JOIN {near})",
        f"scored AS (SELECT sdoc, tdoc, round(ln(inv / distance), 6) AS score, distance, array_to_string(terms, '|') AS terms FROM far WHERE distance IS NOT NULL AND inv / distance >= 1 {cap})",
        "ranked AS (SELECT row_number() OVER (ORDER BY score DESC, sdoc, tdoc) - 1 AS rank, * FROM scored)",
    ]
    page = f"page AS (SELECT rank::BIGINT AS rank, sdoc::BIGINT AS sdoc, tdoc::BIGINT AS tdoc, score, distance::BIGINT AS distance, terms FROM ranked WHERE rank >= {p.start} AND rank < {p.start + p.rows})"
    return with_tokens(body, *parts, page)


COMPARES = {f"compare_{m}": CMP.Params(metric=m, rows=50) for m in CMP.METRICS} | {
    "compare_mct3": CMP.Params(min_common=3, rows=50),
    "compare_maxdist": CMP.Params(max_distance=6, rows=50),
    "compare_userstop": CMP.Params(stop_list="th and, of", stop_words=3, rows=50),
    "compare_paged": CMP.Params(start=20, rows=15),
}


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct forms of the corpus."""
    return C.tokens(passages(spark, sf_dir)).select("form").distinct()


_WORDS = "w AS (SELECT DISTINCT form FROM tok)"


def scalar(**columns: str) -> tuple:
    """Expressions over every distinct form, the same text in both engines."""
    run = lambda spark, sf: words(spark, sf).select("form", *(F.expr(e).alias(n) for n, e in columns.items()))
    return run, with_tokens("SELECT form, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM w", _WORDS)


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_of(words(spark, sf_dir))


def lexicon_of(w: DataFrame) -> DataFrame:
    """(token, pos, stem) of distinct forms: a noun's and a verb's stem of each."""
    return w.select(F.col("form").alias("token"), F.lit("n").alias("pos"), F.expr(T.stem_noun("form")).alias("stem")).unionByName(w.select(F.col("form").alias("token"), F.lit("v").alias("pos"), F.expr(T.stem_verb("form")).alias("stem")))


_LEX = [_WORDS, f"lr AS (SELECT form AS token, {T.stem_noun('form')} AS stem FROM w UNION ALL SELECT form, {T.stem_verb('form')} FROM w)",
        f"lex AS (SELECT {T.normalise('token')} AS key, CASE WHEN list_contains(list({T.normalise('stem')}), 'sum') THEN ['sum'] ELSE list_sort(list_distinct(list({T.normalise('stem')}))) END AS stems FROM lr GROUP BY 1)"]


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_lexicon(lexicon_rows(spark, sf)).select("key", F.array_join("stems", "|").alias("stems"))


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens are counted by form first: the lexicon is made of, and joined to, the distinct forms."""
    scratch = Scratch(spark, "lookup")
    forms = scratch.write(C.tokens(passages(spark, sf)).groupBy("form").agg(F.count(F.lit(1)).alias("n")), "forms")
    return C.with_stems(forms, C.build_lexicon(lexicon_of(forms))).groupBy("stem").agg(F.sum("n").alias("n"))


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    one = CMP.side_of_passages(passages(spark, sf), Scratch(spark, "frequencies"))
    return C.shared_frequencies(one.counts, one.edges.select("form", "stem")).select("form", "cf", F.round("freq", 9).alias("freq"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Counted inside each passage's row; passages that share an id are taken together by their tokens."""
    once, more = C.by_key(passages(spark, sf), Scratch(spark, "vectors"))
    d = once.select("seg_id", C.forms_of().alias("f")).where(F.size("f") > 0)
    of = lambda x: F.size(F.array_distinct(x)).cast("long")
    out = d.select("seg_id", of("f").alias("n_forms"), of(C.stems_of("array_distinct(f)")).alias("n_stems"), F.size("f").cast("long").alias("n"))
    if more is None:
        return out
    toks = C.with_stems(C.tokens(more))
    return out.unionByName(toks.groupBy("seg_id").agg(F.countDistinct("form").alias("n_forms"), F.countDistinct("stem").alias("n_stems"), F.count(F.lit(1)).alias("n")))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage gives each of its stems once; passages that share an id are taken together by their tokens, and those without an id count for none."""
    once, more = C.by_key(passages(spark, sf), Scratch(spark, "index"))
    d = once.select("seg_id", C.forms_of().alias("f")).select("seg_id", F.explode(F.array_distinct(C.stems_of("array_distinct(f)"))).alias("stem"))
    if more is not None:
        d = d.unionByName(C.with_stems(C.tokens(more)).select("seg_id", "stem").distinct())
    return d.groupBy("stem").agg(F.count("seg_id").alias("n_passages"))


def _tess(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    label = F.concat(F.lit("<"), "volume", F.lit(" "), (F.col("seg_id") % 100000).cast("string"), F.lit(">"))
    lines = p.select(F.col("seg_id").alias("n"), F.concat(F.when(F.col("seg_id") % 7 == 0, F.lit("no label")).otherwise(label), F.lit("\t"), F.trim("text")).alias("value"))
    return C.tess_lines(lines).select("n", F.col("line"), F.length("text").cast("long").alias("n_chars"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    lines = p.select(F.floor(F.col("seg_id") / 100000).alias("doc"), (F.col("seg_id") % 100000).alias("n"), "text", (F.col("seg_id") % 100000).cast("string").alias("line"))
    return C.sentences(lines, "doc")


_SENTENCES = with_tokens(
    "SELECT doc, s::BIGINT AS s, trim(t || d, ' ') AS sentence, a AS start, z AS \"end\" FROM g WHERE d IS NOT NULL AND trim(t, ' ') <> ''",
    f"li AS (SELECT CAST(floor(seg_id / 100000) AS BIGINT) AS doc, seg_id % 100000 AS n, string_split(regexp_replace(trim(text, ' '), '([.?!;:])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS cut FROM seg)",
    "pa AS (SELECT doc, n, unnest(cut) AS part, unnest(range(len(cut))) AS p FROM li)",
    "ma AS (SELECT *, regexp_matches(part, '^[.?!;:]$') AS mark FROM pa)",
    "nu AS (SELECT *, coalesce(sum(mark::INT) OVER (PARTITION BY doc ORDER BY n, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ma)",
    "g AS (SELECT doc, s, coalesce(string_agg(part, ' ' ORDER BY n, p) FILTER (WHERE NOT mark), '') AS t, (arg_min(n, n * 1000000 + p) FILTER (WHERE NOT mark))::VARCHAR AS a, max(part) FILTER (WHERE mark) AS d, (arg_max(n, n * 1000000 + p) FILTER (WHERE mark))::VARCHAR AS z FROM nu GROUP BY doc, s)",
)


def _grams(spark: SparkSession, sf: str) -> DataFrame:
    return C.ngrams(table(spark, sf, "part").select("p_type"), "p_type", 3, 15).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return C.edge_ngrams(table(spark, sf, "part").select("p_type"), "p_type").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def tagged_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("tags", F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))))


def _denormalised(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the many side with the columns of both of their parents: two N:1 joins."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    d = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("c_custkey", "c_name", "n_name", "r_name")


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    fresh = s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.upper("s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return C.upsert(s, fresh, ["s_name"])


def _units(v: str, base: int, names: str) -> str:
    shown = [f"WHEN abs({v}) >= {base}e0 * {float(base) ** (k - 1)!r} THEN concat(cast(cast(floor({v} / {float(base) ** k!r}) AS BIGINT) AS STRING), '{n}')" for k, n in zip((5, 4, 3, 2, 1), names.split())]
    return f"CASE {' '.join(shown)} ELSE cast(cast(floor({v}) AS BIGINT) AS STRING) END"


_PRICE = "cast(o_totalprice AS DECIMAL(18,4))"
_QUANTIZED = {m: f"cast({T.quantize(_PRICE, 'cast(0.05 AS DECIMAL(18,4))', m)} AS DOUBLE)" for m in ("ru", "rd", "rf")}
_TAG = "concat(CASE o_orderstatus WHEN 'F' THEN 'v:' WHEN 'O' THEN 'n:' ELSE 'zz' END, o_orderpriority)"


def _orders(**columns: str) -> tuple:
    run = lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", *(F.expr(e).alias(n) for n, e in columns.items()))
    return run, "SELECT o_orderkey, " + ", ".join(f"{e.replace(' AS STRING', ' AS VARCHAR')} AS {n}" for n, e in columns.items()) + " FROM orders"


def ring_position(x: str) -> str:
    """A key's place on the ring: the first four hex digits of its md5."""
    return f"cast(conv(substr(md5({x}), 1, 4), 16, 10) AS BIGINT)"


def _ring(spark: SparkSession, sf: str) -> DataFrame:
    return C.ring_nodes(table(spark, sf, "customer").select(F.col("c_name").alias("key")), ["node-a", "node-b", "node-c"])


_RING = """WITH r AS (SELECT ('0x' || substr(md5(n || ':' || i), 1, 4))::BIGINT AS pl, n FROM (SELECT unnest(['node-a', 'node-b', 'node-c']) AS n), (SELECT unnest(range(100)) AS i)),
u AS (SELECT pl, min(n) AS n FROM r GROUP BY pl), k AS (SELECT c_name AS key, ('0x' || substr(md5(c_name), 1, 4))::BIGINT AS p FROM customer)
SELECT key, coalesce((SELECT arg_min(n, pl) FROM u WHERE pl >= p), (SELECT arg_min(n, pl) FROM u)) AS node FROM k"""

_EVENTS = "SELECT event_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00' AND event_type = 'click' AND user_id % 4 = 2"

DEFINED: dict[str, tuple] = {
    "term_vectors": (
        _vectors,
        with_tokens(f"SELECT seg_id, count(DISTINCT form) AS n_forms, count(DISTINCT stem) AS n_stems, count(*) AS n FROM st GROUP BY seg_id"),
    ),
    "stem_index": (
        _index,
        with_tokens("SELECT stem, count(DISTINCT seg_id) AS n_passages FROM st GROUP BY stem"),
    ),
    "stem_frequencies": (_frequencies, with_tokens("SELECT form, sum(cw)::BIGINT AS cf, round(sum(cw) / (SELECT sum(cw) FROM cw), 9) AS freq FROM (SELECT DISTINCT a.form, b.form AS other FROM ed a JOIN ed b USING (stem)) p JOIN (SELECT form AS other, cw FROM cw) USING (other) GROUP BY form",
        "x AS (SELECT * FROM st)", "oc AS (SELECT seg_id, stem, arg_min(form, pos) AS form FROM x GROUP BY ALL)", "cw AS (SELECT form, count(*) AS cw FROM x GROUP BY form)", "ed AS (SELECT DISTINCT form, stem FROM oc)")),
    "corpus_counts": (lambda spark, sf: C.term_counts(staged(spark, sf)), with_tokens("SELECT '_' || form AS term, count(*) AS n FROM st GROUP BY form UNION ALL SELECT stem, count(*) FROM st GROUP BY stem")),
    "stop_list_topn": (lambda spark, sf: C.top_terms(C.term_counts(staged(spark, sf)), 25), with_tokens("SELECT stem AS term, count(*) AS n FROM st GROUP BY stem ORDER BY n DESC, stem LIMIT 25")),
    "stop_list_forms": (lambda spark, sf: C.top_terms(C.term_counts(staged(spark, sf)), 25, True), with_tokens("SELECT '_' || form AS term, count(*) AS n FROM st GROUP BY form ORDER BY n DESC, term LIMIT 25")),
    "lexicon_merge": (_merge, with_tokens("SELECT key, array_to_string(stems, '|') AS stems FROM lex", *_LEX)),
    "lexicon_lookup": (_lookup, with_tokens("SELECT stem, count(*) AS n FROM (SELECT unnest(coalesce(stems, [form])) AS stem FROM tok LEFT JOIN lex ON key = form) GROUP BY stem", *_LEX)),
    "stem_noun": scalar(stem=T.stem_noun("form")),
    "stem_verb": scalar(stem=T.stem_verb("form")),
    "strip_que": scalar(stem=T.strip_que("form")),
    "fold_vj": scalar(folded=T.fold_vj("concat('V', form, 'vj')"), cased=T.fold_vj_cased("concat('VJ', form)"), key=T.normalise("concat(form, '1J')")),
    "tagged_stems": scalar(part=T.tagged_part("concat('n:', form)"), text=T.tagged_text("concat('x:', form)")),
    "roman_numerals": (
        lambda spark, sf: words(spark, sf).select("form").unionByName(spark.sql("SELECT explode(split('xiv mcmxc dcd viv cmc iiii xlix mmxxiv ix vx', ' ')) AS form")).distinct().select("form", F.expr(T.roman("form")).alias("number")),
        with_tokens(f"SELECT form, {T.roman('form', 'duckdb')} AS number FROM (SELECT form FROM w UNION SELECT unnest(string_split('xiv mcmxc dcd viv cmc iiii xlix mmxxiv ix vx', ' ')))", _WORDS),
    ),
    "tess_lines": (_tess, with_tokens("SELECT seg_id AS n, (seg_id % 100000)::VARCHAR AS line, length(trim(text, ' '))::BIGINT AS n_chars FROM seg WHERE seg_id % 7 <> 0")),
    "sentence_segments": (_sentences, _SENTENCES),
    "ngram": (_grams, "SELECT substr(lower(p_type), i, n) AS gram, count(*) AS n FROM (SELECT p_type, unnest(range(3, 16)) AS n FROM part), LATERAL (SELECT unnest(range(1, length(p_type) - n + 2)) AS i) GROUP BY 1"),
    "edge_ngram": (_edges, "SELECT lower(substr(x, 1, n)) AS gram, count(*) AS n FROM (SELECT unnest(regexp_extract_all(p_type, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)')) AS x FROM part), LATERAL (SELECT unnest(range(1, least(15, length(x)) + 1)) AS n) GROUP BY 1"),
    "autocomplete": (lambda spark, sf: C.autocomplete(table(spark, sf, "customer"), "c_name", "er#00000012"), "SELECT DISTINCT c_name AS value, levenshtein(c_name, 'er#00000012')::BIGINT AS distance FROM customer WHERE contains(lower(c_name), 'er#00000012') ORDER BY distance, value LIMIT 5"),
    "suggest_terms": (lambda spark, sf: C.suggest_terms(C.tokens(passages(spark, sf)), "re"), with_tokens("SELECT form, count(*) AS n FROM tok WHERE starts_with(form, 're') GROUP BY form ORDER BY n DESC, form LIMIT 10")),
    "more_like_this": (lambda spark, sf: C.more_like_this(C.tokens(passages(spark, sf)), 100000), with_tokens("SELECT seg_id, count(DISTINCT form) AS shared FROM tok WHERE seg_id <> 100000 AND form IN (SELECT form FROM tok WHERE seg_id = 100000) GROUP BY seg_id ORDER BY shared DESC, seg_id LIMIT 10")),
    "full_text_all": (lambda spark, sf: C.match_all(passages(spark, sf), "the of").select("seg_id"), with_tokens("SELECT seg_id FROM (SELECT seg_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM seg) WHERE list_contains(w, 'the') AND list_contains(w, 'of')")),
    "facets": (lambda spark, sf: passages(spark, sf).where(F.col("text").contains("a")).groupBy("volume", "lang").agg(F.count(F.lit(1)).alias("n")), with_tokens("SELECT volume, lang, count(*) AS n FROM seg WHERE contains(text, 'a') GROUP BY ALL")),
    "field_query": (lambda spark, sf: passages(spark, sf).where(F.col("volume") == "src3").select("seg_id", "volume"), with_tokens("SELECT seg_id, volume FROM seg WHERE volume = 'src3'")),
    "denormalise": (_denormalised, "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "upsert": (_upserted, "WITH f AS (SELECT s_suppkey + 1 AS s_suppkey, upper(s_name) AS s_name, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) SELECT s_suppkey, s_name, s_acctbal FROM supplier s WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM f) UNION ALL SELECT * FROM f"),
    "events_filter": (lambda spark, sf: C.find_events(tagged_events(spark, sf), "2024-01-05 00:00:00", "2024-01-09 12:00:00", ["click", "u2"]).select("event_id", "ts", "event_type", "value"), _EVENTS),
    "index_search": (lambda spark, sf: C.index_search(table(spark, sf, "part").select(F.col("p_name").alias("path")), ["bolt", "^g.*e"]), "SELECT DISTINCT p_name AS path FROM part WHERE regexp_matches(p_name, '(?i)bolt') OR regexp_matches(p_name, '(?i)^g.*e') ORDER BY path LIMIT 100"),
    "name_search": (lambda spark, sf: C.name_search(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "a e"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e')"),
    "expand_paths": (lambda spark, sf: C.tree_children(table(spark, sf, "events").select(F.concat_ws(".", F.lit("ev"), "event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("path")), "ev"),
                     "SELECT DISTINCT event_type AS node, false AS is_leaf FROM events"),
    "quantize": (_orders(**_QUANTIZED)[0], "SELECT o_orderkey, ((c + 4) // 5 * 5) / 100.0 AS ru, (c // 5 * 5) / 100.0 AS rd, (c // 5 * 5) / 100.0 AS rf FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)"),
    "format_units": _orders(si=_units("o_totalprice", 1000, "P T G M K"), binary=_units("o_totalprice", 1024, "Pi Ti Gi Mi Ki")),
    "part_of_speech": _orders(part=T.tagged_part(_TAG), text=T.tagged_text(_TAG)),
    "parse_bool": _orders(flag=T.parse_bool("CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'n' ELSE o_orderstatus END"), cleaned=T.clean_optional("CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE o_orderstatus END")),
    "cache_keys": (lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.md5(F.concat_ws("&", "p_brand", "p_type")).alias("key")), "SELECT p_partkey, md5(p_brand || '&' || p_type) AS key FROM part"),
    "hash_ring": (_ring, _RING),
    "unescape_html": (lambda spark, sf: table(spark, sf, "part").select("p_partkey", C.unescape_html(F.concat(F.lit("&lt;b&gt;"), "p_name", F.lit("&amp;amp; &quot;x&quot;\u0001"))).alias("text")), "SELECT p_partkey, '<b>' || p_name || '&amp; \"x\"' AS text FROM part"),
}

COMPARED = {k: compared(p) for k, p in COMPARES.items()} | {"compare_itself": compared(CMP.Params(rows=50), SOURCE, SOURCE)}
QUERIES = COMPARED | {"compare_fields": _with_fields} | {k: q for k, (q, _) in DEFINED.items()}
SQL = {k: compare_sql(p) for k, p in COMPARES.items()} | {
    "compare_itself": compare_sql(CMP.Params(rows=50), SOURCE, SOURCE),
    "compare_fields": compare_sql(COMPARES["compare_freq"], body="SELECT page.*, a.volume AS source_volume, a.text AS source_text, b.lang AS target_lang, b.text AS target_text FROM page JOIN seg a ON a.seg_id = sdoc JOIN seg b ON b.seg_id = tdoc"),
} | {k: s for k, (_, s) in DEFINED.items() if s}

"""Near-duplicates by exact similarity: SimHash candidates from the trie, verified by Jaccard.

At a similarity of 0.8 a SimHash bit differs with a chance of about 0.15, so 64 bits differ in about
ten. Each text gets eight fingerprints, and ``TABLES`` signatures of ``WIDTH`` bits drawn from their
512 bits. Texts with a signature at most one bit apart are candidates: one half of it is equal, so
the groups are the halves, and each group is joined by the trie. Per signature a pair of similarity
0.8 is found with a chance of 0.06, by all of them with 0.98; the chance grows with similarity.
Candidates count only where the sets of word shingles are similar enough, shingles compared as
64-bit hashes.

Equal sets are one node. In a class of equal signatures each node is paired with the next ``near`` in
an order that each group draws anew, and with the ``near`` nodes that have the most verified links so
far: a text that many are copies of, but less like one another, is found by all of them. Classes of up
to near + 1 give all their pairs, larger ones rows in proportion to their members. There are several
passes (``PASSES``), each over other tables; a pass gives only the pairs whose components
still differ, so a large group of near copies that the first passes
have joined makes no more pairs.

What chance and ``near`` leave out is found exactly by a last pass: in one order of all shingles, rare
ones first, two sets of similarity ``least`` have a shingle in common among the first n - least * n + 1
of each. All pairs with such a shingle are candidates, unless their components are one, or their
sizes and the shingle's places leave too few to have in common. No group is cut. Which shingles
are frequent is told by a sample of ``SAMPLE`` texts; it decides how many candidates there are, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.simhash import _BLANKS, _FOLD, components, trie_links
from stemloom.llm.workers import lean
from stemloom.scratch import Scratch

PRINTS, TABLES, WIDTH = 8, 64, 28
HALF = WIDTH // 2
#: Each pass: its tables (from, to), and a node's partners in a class of equal signatures.
PASSES = ((0, 2, 1), (2, 12, 1), (12, 36, 1), (36, TABLES, 1))
#: Texts that tell which shingles are frequent, shingles that are told so, and pairs that are looked at together.
SAMPLE, FREQUENT, TOGETHER = 8192, 1 << 17, 1 << 18

_CHOSEN = np.stack([np.random.default_rng([7, t]).permutation(64 * PRINTS)[:WIDTH] for t in range(TABLES)])
_STEPS = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; of the whole text if it has fewer, none without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).translate(_BLANKS).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        spans = {joined}
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = {joined[a:b] for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in spans), np.uint64, len(spans)))


def _name(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 43)).view(np.int64))


def fingerprints(found: np.ndarray) -> np.ndarray:
    """The 512 bits, as 64 bytes, of a set of shingles."""
    counts = np.zeros(64 * PRINTS, np.int64)
    for at in range(0, len(found), 255):
        some = _mixed(found[at : at + 255, None] + _STEPS)
        counts += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _pairs(g: np.ndarray, rest: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, degree: np.ndarray, least: float, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (a, b) in whole groups: other halves at most one bit apart, sizes that allow ``least``, roots that differ."""
    draw = _mixed(node.view(np.uint64) + g.astype(np.uint64) * _STEPS[0])
    order = np.lexsort((draw, rest, g))
    g, rest, node, size, root, degree, draw = (x[order] for x in (g, rest, node, size, root, degree, draw))
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (rest[1:] != rest[:-1])])
    count = np.diff(np.r_[starts, len(g)])
    cls = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(g))
    hubs = np.lexsort((draw, -degree, cls))  # each class's members, most links first
    a, b = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        keep = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
        a.append(node[i[keep]])
        b.append(node[j[keep]])

    for s in range(1, near + 1):
        i = at[: len(at) - s]
        i = i[cls[i] == cls[i + s]]
        if not len(i):
            break
        add(i, i + s)
    crowd = at[count[cls] > near + 1]
    for s in range(near):
        add(crowd, hubs[starts[cls[crowd]] + s])

    class Found:
        def __call__(self, x: np.ndarray, y: np.ndarray) -> None:
            # Each member of either class asks one of the other, every second one the other's member of most
            # links, if that has as many links as itself: a class has up to HALF others around it.
            for x, y in ((x, y), (y, x)):
                many = np.repeat(np.arange(len(x)), count[x])
                nth = np.arange(len(many)) - np.repeat(np.cumsum(count[x]) - count[x], count[x])
                own, other = starts[x[many]] + nth, y[many]
                ask = np.where(nth % 2 == 0, hubs[starts[other]], starts[other] + nth % count[other])
                fewer = degree[own] <= degree[ask]
                add(own[fewer], ask[fewer])

        def same(self, alo, ahi, blo, bhi):
            return np.zeros(len(alo), bool)

    values = rest[starts].astype(np.uint64) << np.uint64(64 - HALF)
    own = g[starts]
    lo = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    hi = np.r_[lo[1:], len(own)]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    if len(lo):
        trie_links(values, np.stack([lo, hi, lo, hi], 1), 1, Found())
    if not a:
        return node[:0], node[:0]
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def candidates(nodes: DataFrame, least: float, tables: range, near: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, size, bits, root, degree) with a signature in one of ``tables`` in common, whose roots differ."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(HALF)
        for whole in batches:
            for k in range(0, len(whole), 1024):
                batch = whole.slice(k, 1024)
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(-1, 8 * PRINTS), axis=1, bitorder="little")
                halves = bits[:, _CHOSEN[tables.start : tables.stop]].reshape(len(batch), len(tables), 2, HALF).astype(np.int64) @ weight
                key = (np.arange(tables.start, tables.stop)[:, None] * 2 + np.arange(2)) << HALF
                times = 2 * len(tables)
                yield pa.record_batch(
                    [
                        pa.array((halves + key).ravel().astype(np.int32)),
                        pa.array(halves[:, :, ::-1].ravel().astype(np.int16)),
                        pa.array(np.repeat(batch.column("node").to_numpy(), times)),
                        pa.array(np.repeat(batch.column("size").to_numpy(), times)),
                        pa.array(np.repeat(batch.column("root").to_numpy(), times)),
                        pa.array(np.repeat(batch.column("degree").to_numpy(), times)),
                    ],
                    names=["g", "rest", "node", "size", "root", "degree"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("g", "rest", "node", "size", "root", "degree")] for b in batches if len(b)]
        if not parts:
            return
        cols = [np.concatenate(x) for x in zip(*parts)]
        del parts
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        at, g = 0, cols[0]
        while at < len(g):
            to = min(len(g), at + (1 << 18))
            to = int(np.searchsorted(g, g[to - 1], "right"))
            a, b = _pairs(*(c[at:to] for c in cols), least, near)
            for k in range(0, len(a), 1 << 18):
                yield pa.record_batch([pa.array(x[k : k + (1 << 18)]) for x in (a, b)], names=["a", "b"])
            at = to

    dealt = nodes.mapInArrow(lean(signed), "g int, rest short, node long, size int, root long, degree int").repartition("g")
    return dealt.mapInArrow(lean(joined), "a long, b long").distinct()


def frequent(texts: DataFrame, words: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that three or more of each ``every``-th text have, the ``FREQUENT`` most frequent, and how many have them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(shingles(t.as_py(), words) for t in batch.column("text"))]), return_counts=True)
            for k in range(0, len(found), 1 << 18):
                yield pa.record_batch([pa.array(found[k : k + (1 << 18)].view(np.int64)), pa.array(n[k : k + (1 << 18)])], names=["shingle", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    most = some.mapInArrow(lean(counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    found, n = most.column("shingle").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _weight(found: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(known[0]):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(known[0], found), len(known[0]) - 1)
    return np.where(known[0][at] == found, known[1][at], 0)


def prefix(found: np.ndarray, least: float, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles, rare ones first, of which a set that is similar enough has one among its own."""
    n = len(found)
    return found[np.argsort(_weight(found, known), kind="stable")][: n - int(np.ceil(least * n - 1e-6)) + 1]


def enough(x: np.ndarray, y: np.ndarray, m: int, n: int, least: float, known: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether sets of m and n shingles with the prefixes x and y can be similar enough: those of the prefix that ends first
    are met in the other prefix or not at all."""
    ends = list(zip(_weight(np.array([x[-1], y[-1]]), known).tolist(), (int(x[-1]), int(y[-1]))))
    left = m - len(x) if ends[0] <= ends[1] else n - len(y)
    return len(np.intersect1d(x, y, assume_unique=True)) + left >= least / (1 + least) * (m + n) - 1e-6


def _ranges(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each j from first[i] to last[i], ``TOGETHER`` or little more at a time."""
    count = np.maximum(last - first, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + TOGETHER, "right")))
        n = count[at:to]
        if n.any():
            yield np.repeat(np.arange(at, to), n), np.arange(n.sum()) + np.repeat(first[at:to] - (np.cumsum(n) - n), n)
        at = to


def _sharing(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (a, b) with a key in common, in whole groups of equal keys: sizes and places that allow ``least``, roots that differ."""
    order = np.lexsort((root, key))
    key, node, size, place, root = (x[order] for x in (key, node, size, place, root))
    new = np.r_[True, key[1:] != key[:-1]]
    runs = np.flatnonzero(new | np.r_[True, root[1:] != root[:-1]])
    length = np.diff(np.r_[runs, len(key)])
    group = np.cumsum(new) - 1
    # In each group the root with most members is left to the others: a crowd that is joined is not paired with itself.
    best = np.lexsort((-length, group[runs]))
    best = best[np.r_[True, np.diff(group[runs][best]) > 0]]
    minor = np.ones(len(runs), bool)
    minor[best] = False
    minor = np.repeat(minor, length)
    several = np.bincount(group, minor) > 0
    keep = several[group]
    group, node, size, place, root, minor = (x[keep] for x in (group, node, size, place, root, minor))
    if not len(group):
        return
    order = np.lexsort((size, group))
    group, node, size, place, root, minor = (x[order] for x in (group, node, size, place, root, minor))
    # Sets of x and y have at most x - place in common from here on, and need (x + y) * least / (1 + least).
    allowed = np.floor((size - place) * (1 + least) / least - size + 1e-6).astype(np.int64)
    wide = int(size.max()) + 2
    value = group * wide + size
    limit = group * wide + np.clip(np.minimum(allowed, np.floor(size / least + 1e-6).astype(np.int64)), 0, wide - 1)
    few = np.flatnonzero(minor)
    some = np.flatnonzero(~minor)
    after = np.searchsorted(value, limit, "right")
    parts = (
        (few, np.arange(len(value)), few + 1, after[few]),
        (some, few, np.searchsorted(few, some), np.searchsorted(value[few], limit[some], "right")),
    )
    for own, other, first, last in parts:
        for i, j in _ranges(first, last):
            i, j = own[i], other[j]
            fits = (root[i] != root[j]) & (size[i] <= allowed[j])
            x, y = node[i[fits]], node[j[fits]]
            if len(x):
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pairs[:, 0], pairs[:, 1]


def all_candidates(texts: DataFrame, nodes: DataFrame, words: int, least: float, known: tuple[np.ndarray, np.ndarray], scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, root), those of similarity ``least`` or more among them, whose roots differ; ``texts`` has their texts.

    Candidates are held against each other by their prefixes, which are a fifth of the sets at 0.8."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for t in batch.column("text"):
                found = shingles(t.as_py(), words)
                if len(found) and (name := _name(found)) not in seen:
                    seen.add(name)
                    out.append((name, len(found), prefix(found, least, known).tobytes()))
            if out:
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["node", "size", "first"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                first = [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
                times = np.fromiter(map(len, first), np.int64, len(first))
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cols = [np.concatenate(first), *(np.repeat(batch.column(c).to_numpy(), times) for c in ("node", "root", "size")), place.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["key", "node", "root", "size", "place"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("key", "node", "size", "place", "root")] for b in batches if len(b)]
        if not parts:
            return
        cols = [np.concatenate(x) for x in zip(*parts)]
        del parts
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        at, key = 0, cols[0]
        while at < len(key):
            to = min(len(key), at + (1 << 18))
            to = int(np.searchsorted(key, key[to - 1], "right"))
            for a, b in _sharing(*(c[at:to] for c in cols), least):
                for k in range(0, len(a), 1 << 18):
                    yield pa.record_batch([pa.array(x[k : k + (1 << 18)]) for x in (a, b)], names=["a", "b"])
            at = to

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(f, np.uint64) for f in batch.column(c).to_pylist()] for c in ("x", "y"))
            keep = [enough(*of, least, known) for of in zip(x, y, batch.column("m").to_pylist(), batch.column("n").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    firsts = scratch.write(texts.select("text").mapInArrow(lean(marked), "node long, size int, first binary").dropDuplicates(["node"]), "firsts")
    rows = firsts.join(nodes.select("node", "root"), "node").select("node", "root", "size", "first").mapInArrow(lean(dealt), "key long, node long, root long, size int, place int")
    met = scratch.write(rows.repartition("key").mapInArrow(lean(joined), "a long, b long").distinct(), "met")
    both = met.join(firsts.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("first").alias("x")), "a")
    both = both.join(firsts.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("first").alias("y")), "b")
    return both.select("a", "b", "x", "y", "m", "n").mapInArrow(lean(compared), "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("x", "y")]
            keep = pa.array([jaccard(x, y) >= least for x, y in zip(*of)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    return both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(lean(each), "a long, b long")


def similar_texts(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, ``node`` (its set of shingles), ``root`` and ``component_id``, the smallest doc_id reachable
    by texts of similarity ``least`` or more.

    Texts without words are one component. Rows without an id take no part; repeated rows and ids
    each count; texts are taken whole; an empty table gives no rows; other columns are not read."""
    scratch = Scratch(docs.sparkSession, "similar")
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column("text")]
            cols = [batch.column("doc_id"), pa.array([_name(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int32()), pa.array([fingerprints(f).tobytes() for f in found], pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "node", "size", "bits"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column("text")]
            out = pa.record_batch([batch.column("node"), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "found"])
            yield out.filter(pa.array([_name(f) == n for f, n in zip(found, batch.column("node").to_pylist())], pa.bool_()))

    rows = scratch.write(texts.mapInArrow(lean(marked), f"doc_id {kind}, node long, size int, bits binary"), "rows")
    nodes = scratch.write(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits")), "nodes")
    worded = nodes.where("size > 0").select("node", "size", "bits")
    links = roots = None
    for k, spec in enumerate((*PASSES, None)):
        known = worded.withColumns({"root": F.col("node"), "degree": F.lit(0)})
        if roots is not None:
            count = lambda c: links.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n"))
            degrees = count("a").unionByName(count("b")).groupBy("node").agg(F.sum("n").cast("int").alias("degree"))
            known = worded.join(roots, "node", "left").join(degrees, "node", "left").withColumns({"root": F.coalesce("root", "node"), "degree": F.coalesce("degree", F.lit(0))})
        if spec:
            pairs = candidates(known, least, range(*spec[:2]), spec[2])
        else:
            pairs = all_candidates(texts, known, words, least, frequent(texts, words, max(1, rows.count() // SAMPLE)), scratch)
        pairs = scratch.write(pairs, f"pairs-{k}")
        ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        held = nodes.select("node", F.col("least").alias("doc_id")).join(ends, "node", "left_semi")
        sets = scratch.write(texts.join(held, "doc_id").select("node", "text").mapInArrow(lean(again), "node long, found binary").dropDuplicates(["node"]), f"sets-{k}")
        new = scratch.write(_similar(pairs, sets, least), f"links-{k}")
        scratch.drop(f"sets-{k}", *(() if spec else ("firsts", "met")))
        links = new if links is None else links.unionByName(new)
        roots = scratch.write(components(links, scratch, f"stars-{k}"), f"roots-{k}")

    classes = nodes.select(F.col("node").alias("own"), "least").join(roots, F.col("own") == F.col("node"), "left").select("own", "least", F.coalesce("root", "own").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select(F.col("own").alias("node"), "root", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each component, that with the component's id, with its own columns; rows without an id are kept.

    Of rows that repeat an id one stays for each component that they are in: any of those that are
    equal, of others that whose columns have the least hash. Null, empty and blank texts are one
    component. Columns and their order stay."""
    kind = dict(docs.dtypes)["doc_id"]
    keepers = Scratch(docs.sparkSession, "keepers").write(similar_texts(docs, words, least).where("doc_id = component_id").select("doc_id", "node", "root"), "ids")
    counted = keepers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    once = docs.join(counted.where("n = 1"), "doc_id", "left_semi")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pa.array([_name(shingles(t, words)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), node, batch.column("row")], names=["doc_id", "node", "row"])

    again = docs.join(counted.where("n > 1"), "doc_id", "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = again.select("doc_id", F.col("text").cast("string").alias("text"), whole.alias("row"))
    again = again.mapInArrow(lean(named), f"doc_id {kind}, node long, row {again.schema['row'].dataType.simpleString()}")
    again = again.join(keepers.distinct(), ["doc_id", "node"]).groupBy("doc_id", "root").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.select(*docs.columns).unionByName(again).unionByName(docs.where("doc_id IS NULL"))

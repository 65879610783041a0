"""SimHash near-duplicates: fingerprints, a binary-trie self-join and connected components.

Fingerprints that differ are few bits apart only for near copies, so equal ones are collapsed
first. Two that differ in at most three bits agree in one of four blocks of bits, in two of five and
in three of six: each fingerprint goes to a group for each such choice of blocks, of the coarsest
kind under which groups stay small (see ``BLOCKINGS``). Each group is joined with itself by traversing
the binary trie of its sorted fingerprints in pairs of nodes, all pairs of one depth at once in numpy.
A pair of nodes carries its count of differing bits and is dropped once the count exceeds the budget.

A group that holds more than ``GROUP`` fingerprints is dealt out in salted chunks, each pair of
chunks a task's own join, so no task grows with the hottest block. A task reports its links as a
spanning forest: no link between different texts is lost to the components, and a ball of near
copies costs rows in proportion to its members. Components are found by alternating stars, with
each round's links written, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.scratch import Scratch

BITS = 64
#: Blocks that agree in a pair's group. Groups have about n / 2 ** (64 * agreeing / blocks) members; all choices find all pairs.
BLOCKINGS = (1, 2, 3, 4)
#: Members of a group that are joined in one piece, and members on average from which on more blocks must agree.
GROUP, CROWD = 4096, 64
#: Node pairs that are traversed at once.
FRONTIER = 1 << 20
#: Shingles of a text that are held at once.
CHUNK = 1 << 16

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANKS = bytes(32 if b in b"\t\n\x0b\f\r " else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a whole text; 0 for a text without words. Shingles are made and counted in chunks."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).translate(_BLANKS).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = parts[at : at + CHUNK + words - 1]
        joined = b" ".join(some)
        if n == 1:
            spans = [joined]
        else:
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            spans = [joined[a:b] for a, b in zip(starts[: len(some) - words + 1].tolist(), ends[words - 1 :].tolist())]
        hashes = np.fromiter((digest(x, 42) for x in spans), np.uint64, len(spans))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint's 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), np.uint64, len(batch))
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def _roots(labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = labels[x]
        if (up == x).all():
            return x
        x = up


class _Forest:
    """Components of a task's fingerprints, by pointer jumping; ``edges`` is a spanning forest."""

    def __init__(self, n: int):
        self.labels = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = _roots(self.labels, a), _roots(self.labels, b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            top, first = np.unique(hi, return_index=True)  # one link for each root that ends here
            self.labels[top] = lo[first]
            self.a.append(a[first])
            self.b.append(b[first])
        flat = _roots(self.labels, self.labels)
        self.labels = flat

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return (np.concatenate(self.a), np.concatenate(self.b)) if self.a else (none, none)


def trie_links(values: np.ndarray, roots: list[tuple[int, int, int, int]], budget: int, found) -> None:
    """Traverse pairs of subtries of ``values`` (sorted inside each root's ranges).

    roots: (a from, a to, b from, b to); equal ranges join a subtrie with itself. found(i, j): gets
    the index pairs within the budget, equal values left out; ``found.same(alo, ahi, blo, bhi)``
    tells which node pairs need no further look."""
    start = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(63, start[:, 0], start[:, 1], start[:, 2], start[:, 3], np.zeros(len(start), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            for at in range(0, len(alo), FRONTIER // 2):
                stack.append((bit, *(x[at : at + FRONTIER // 2] for x in (alo, ahi, blo, bhi, err))))
            continue
        one = (ahi - alo == 1) & (bhi - blo == 1)
        if one.any():
            i, j = alo[one], blo[one]
            d = np.bitwise_count(values[i] ^ values[j])
            hit = (d <= budget) & (d > 0)
            found(i[hit], j[hit])
            alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or bit < 0:
            continue
        done = found.same(alo, ahi, blo, bhi)
        if done.any():
            alo, ahi, blo, bhi, err = (x[~done] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        amid, bmid = _split(values, alo, ahi, bit), _split(values, blo, bhi, bit)
        itself = alo == blo
        parts = []
        for x0, x1, y0, y1, more, only in (
            (alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~itself),
        ):
            keep = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            keep &= only if only is not None else True
            keep &= ~((x0 == y0) & (x1 - x0 == 1))
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], err[keep] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts))))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """In each sorted range, where the given bit turns to 1 (ranges agree in all higher bits)."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        set_ = (values[mid] & mask) != 0
        hi[open_[set_]] = mid[set_]
        lo[open_[~set_]] = mid[~set_] + 1


class _Links:
    """Collects a task's links into a forest and tells node pairs whose members are linked already."""

    def __init__(self, n: int):
        self.forest = _Forest(n)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.forest.link(i, j)

    def same(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(alo), bool)
        if not self.forest.a:
            return out
        labels = self.forest.labels
        some = np.flatnonzero((labels[alo] == labels[blo]) & (labels[ahi - 1] == labels[bhi - 1]) & (labels[alo] == labels[ahi - 1]))
        if len(some):
            turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])  # equal inside a range of one label
            out[some] = (turns[ahi[some] - 1] == turns[alo[some]]) & (turns[bhi[some] - 1] == turns[blo[some]])
        return out


def _join_partition(groups: np.ndarray, side: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group: of all members, or where both sides occur of those of side 0 with side 1."""
    order = np.lexsort((fps, side, groups))
    groups, side, fps = groups[order], side[order], fps[order]
    key = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1])])
    ends = np.r_[key[1:], len(groups)]
    roots = []
    for a, b in zip(key.tolist(), ends.tolist()):
        mid = a + int(np.searchsorted(side[a:b], 1))
        if mid == b:
            if b - a > 1:
                roots.append((a, b, a, b))
        elif mid > a:
            roots.append((a, mid, mid, b))
    links = _Links(len(fps))
    if roots:
        trie_links(fps, roots, budget, links)
    i, j = links.forest.edges()
    return fps[i], fps[j]


def masks(budget: int, agreeing: int) -> list[int]:
    """The bits of each choice of ``agreeing`` of ``agreeing + budget`` blocks, as signed longs."""
    blocks = agreeing + budget
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    of = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    found = (sum(c) for c in combinations(of, agreeing))
    return [m - (1 << 64) if m >> 63 else m for m in found]


def blocks_to_agree(n: int, budget: int) -> int:
    """The fewest blocks under which groups of n fingerprints have CROWD members on average, or nearly."""
    return next((k for k in BLOCKINGS if n <= CROWD * 2 ** (BITS * k / (k + budget))), BLOCKINGS[-1])


def near_links(distinct: DataFrame, budget: int, scratch: Scratch, agreeing: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: a spanning forest of each task's links.

    Of k + budget blocks, ``budget`` differing bits leave k equal. ``agreeing`` is that k, by default by
    the number of fingerprints: every choice finds all links."""
    if agreeing is None:
        agreeing = blocks_to_agree(distinct.count(), budget)
    chosen = masks(budget, agreeing)
    assert len(chosen) == comb(agreeing + budget, agreeing)
    keyed = distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(chosen)))).alias("key"))
    sizes = keyed.groupBy("key").count()
    hot = scratch.write(sizes.where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks")), "hot")
    # At most (groups of a fingerprint / GROUP) keys a fingerprint are hot; Spark broadcasts them while they are few.
    keyed = keyed.join(hot, "key", "left").withColumn("chunk", F.pmod(F.xxhash64("fp", "key"), F.coalesce("chunks", F.lit(1))).cast("int"))
    # A chunk meets itself (side 0) and each other chunk: the smaller number is side 0 of the pair.
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1),
        lambda c: F.struct(F.least(c, F.col("chunk")).alias("x"), F.greatest(c, F.col("chunk")).alias("y"), F.when(c < F.col("chunk"), 1).otherwise(0).alias("side")),
    )
    dealt = keyed.select("fp", "key", F.explode(pairs).alias("p")).select("fp", F.xxhash64("key", "p.x", "p.y").alias("g"), "p.side")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("g").to_numpy(), b.column("side").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches if len(b)]
        if not parts:
            return
        g, side, fp = (np.concatenate(x) for x in zip(*parts))
        del parts
        # Whole groups at a time, so that what the traversal holds is bounded.
        order = np.argsort(g, kind="stable")
        g, side, fp = g[order], side[order], fp[order]
        at = 0
        while at < len(g):
            to = min(len(g), at + (1 << 18))
            to = int(np.searchsorted(g, g[to - 1], "right"))
            a, b = _join_partition(g[at:to], side[at:to], fp[at:to], budget)
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            at = to

    return dealt.repartition("g").mapInArrow(joined, "a long, b long")


def components(links: DataFrame, scratch: Scratch, prefix: str = "links") -> DataFrame:
    """(node, root) of every node that has a link, root the smallest node reachable.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to its
    smallest neighbour, until every link leads to a root. Each round is written."""
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{prefix}-0")
    marked = lambda d: d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    n, before = 0, marked(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = scratch.write(small, f"{prefix}-{n + 1}")
        # Done when a round changes no link: they are stars then. Sets of links are compared by their
        # number and two 64-bit sums of hashes.
        mark = marked(after)
        scratch.drop(f"{prefix}-{n}")
        edges, n, moved, before = after, n + 1, mark != before, mark
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = 3, words: int = 3) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs`` (doc_id, text).

    Fingerprints within ``budget`` bits are linked; a component's id is the smallest doc_id
    reachable. A null, empty or blank text has fingerprint zero and is linked like any other. Null
    ids are kept and give a component its id only if it has no other. Repeated rows stay; equal
    fingerprints are one component. Whole texts are read; an empty table gives no rows; other
    columns are not read."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, words), "fingerprints")
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = scratch.write(components(near_links(distinct.select("fp"), budget, scratch), scratch), "roots")
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = 3, words: int = 3) -> DataFrame:
    """The documents whose id is their component's, with their own columns. Needs distinct, non-null ids to keep one each;
    rows without an id are kept."""
    keep = near_duplicates(docs, budget, words).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def simhash_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

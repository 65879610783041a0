"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts, and a small
classifier learns to tell a vector's part. The classifier then gives every vector of the table a
part and every query its most probable parts. A part that is still large is partitioned in the same
way, by a sample and a classifier of its own, so parts keep their size however many rows there are.
The members of the parts that a query reaches are ranked by the exact measure. How many parts a
query visits is set by the recall on sample queries that the classifier has not seen.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.scratch import Scratch

#: A classifier is fitted on about so many rows of what it partitions, those whose hash is least; every row is indexed.
SAMPLE = 12_000
#: Rows of a part that are aimed at, and most parts of one classifier.
LEAF, FAN = 500, 80
#: Members of a part that one task holds, and queries that are ranked against them in one task: larger parts are dealt out in blocks.
BLOCK, ASKED = 4096, 16_384
#: Queries that are ranked against a block at once.
QUERIES = 512
#: Beyond so many classifiers at a level rows are dealt out by them, so that a task needs few.
MODELS = 256


@dataclass
class Router:
    """Part probabilities from one hidden layer; ``probes`` parts are visited."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(self.w1.dtype)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, in that order; ties to the smaller part."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k rows of largest inner product, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-s, axis=1)[:, :k]
    return out


def _halve(x: np.ndarray, graph: np.ndarray, members: np.ndarray, share: float, rounds: int = 12) -> np.ndarray:
    """Which members go to the first side, ``share`` of them: a cut of the graph that is begun along
    the main axis and improved by moving whole ranks of members to the side of their neighbours."""
    n = round(len(members) * share)
    inside = np.full(len(x), -1)
    inside[members] = np.arange(len(members))
    near = inside[graph[members]]
    there = near >= 0
    y = x[members] - x[members].mean(0)
    axis = np.linalg.eigh(y.T @ y)[1][:, -1]
    score = y @ axis
    side = np.zeros(len(members), bool)
    side[np.argsort(score, kind="stable")[:n]] = True
    degree = np.maximum(there.sum(1), 1)
    back = np.zeros(len(members))
    flat = near[there]
    indegree = np.bincount(flat, minlength=len(members))
    for _ in range(rounds):
        votes = ((side[np.where(there, near, 0)] * 2.0 - 1) * there).sum(1)
        back = np.bincount(flat, weights=np.repeat(side * 2.0 - 1, there.sum(1)), minlength=len(members))
        pull = (votes + back) / (degree + indegree) + 0.05 * (side * 2.0 - 1)
        after = np.zeros(len(members), bool)
        after[np.argsort(-pull, kind="stable")[:n]] = True
        if (after == side).all():
            break
        side = after
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, all of nearly equal size, by halving the neighbour graph again and again."""
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        members, first, n = todo.pop()
        if n == 1 or len(members) < 2:
            out[members] = first
            continue
        left = n // 2
        side = _halve(x, graph, members, left / n)
        todo += [(members[side], first, left), (members[~side], first + left, n - left)]
    return out


def fit_router(x: np.ndarray, parts: int, k: int, least_recall: float, seed: int = 7, hidden: int = 256, epochs: int = 30) -> Router:
    """Partition the sample's graph, train the classifier, and set the number of parts to visit.

    The classifier's target is how a row's neighbours spread over the parts. A tenth of the sample
    is held out of training; the fewest parts with ``least_recall`` on those rows are visited."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    if n <= 10 * parts or parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    graph = neighbour_graph(x, min(k, n - 1))
    label = balanced_parts(unit, graph, parts)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1.0)
    np.add.at(target, (np.arange(n), label), 2.0)
    target /= target.sum(1, keepdims=True)
    held = rng.random(n) < 0.1
    train = np.flatnonzero(~held)
    u = unit.astype(np.float32)
    w = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            rows = train[at : at + 256]
            h = np.maximum(u[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for i, g in enumerate((u[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(*w, parts, 1.0)
    rows = np.flatnonzero(held)[:1000]
    own = router.parts(x, 1)[:, 0]
    order = router.parts(x[rows], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], 1)
    need = np.take_along_axis(rank, own[graph[rows]], 1)
    for probes in range(1, parts + 1):
        found = float((need < probes).mean()) if len(rows) else 1.0
        if found >= least_recall or probes == parts:
            router.probes, router.recall = probes, found
            return router
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part: an id, and a vector with only finite components, not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components: the same for a pair in any block."""
    out = np.zeros((len(q), len(c)))
    part = np.empty_like(out)
    ct = np.ascontiguousarray(c.T)
    for d in range(q.shape[1]):
        np.multiply(q[:, d, None], ct[None, d], out=part)
        out += part
    return out


def without_needless_copies(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Of a vector with more than BLOCK rows only those that can be among a query's k: the k + 1 smallest
    ids (the query's own is left out) and k rows of each. The others would make ties that are lost."""
    counted = rows.withColumn("h", F.xxhash64("v"))
    hot = scratch.write(counted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "hot")
    if not hot.limit(1).count():
        return rows
    ids = counted.join(hot, "h").groupBy("h", "n", "v", "vec_id").agg(F.count(F.lit(1)).alias("c"))
    least = lambda lists: F.slice(F.array_sort(lists), 1, k + 1)
    some = ids.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).alias("s")).agg(least(F.collect_list(F.struct("vec_id", "c"))).alias("x"))
    kept = some.groupBy("v").agg(least(F.flatten(F.collect_list("x"))).alias("x")).select("v", F.explode("x").alias("x"))
    kept = kept.withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.col("x.c"), F.lit(k))))).select(F.col("x.vec_id").alias("vec_id"), "v")
    return counted.join(hot, "h", "left_anti").select("vec_id", "v").unionByName(kept)


@lru_cache(MODELS)
def _model(root: str, node: int) -> Router:
    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/{node:x}", compression=None) as f:
        return pickle.loads(f.read())


def fit_nodes(rows: DataFrame, sizes: DataFrame, root: str, k: int, least_recall: float, sample: int) -> DataFrame:
    """A classifier for each node of ``sizes`` (node, n), fitted on a sample of its ``rows`` and written under ``root``.

    Gives (node, parts, probes, recall)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n = int(pdf["node"].iloc[0]), int(pdf["n"].iloc[0])
        picked = pdf.sort_values(["r", "vec_id"], kind="stable")["v"].to_numpy()[:sample]
        x = np.stack(picked).astype(np.float64)
        parts = int(np.clip(n // LEAF, 2, min(FAN, max(2, len(x) // 60))))
        router = fit_router(x, parts, min(2 * k, max(1, len(x) // parts)), least_recall)
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{node:x}", compression=None) as f:
            f.write(pickle.dumps(router))
        return pd.DataFrame({"node": [node], "parts": [router.b2.size], "probes": [router.probes], "recall": [router.recall]})

    # A hash that is uniform over the rows: those below a share of its range are the sample.
    r = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    picked = rows.join(sizes, "node").withColumn("r", r).where(F.col("r") * F.col("n") <= float(sample) * (1 << 40))
    return picked.groupBy("node").applyInPandas(fit, "node long, parts int, probes int, recall double")


def routed(d: DataFrame, nodes: DataFrame, n_nodes: int, root: str, many: bool) -> DataFrame:
    """``d`` with ``node`` replaced by the most probable part of it (``many``: by all that are to be visited, a row each)."""
    names = d.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, probes = batch.column("node").to_numpy(), batch.column("probes").fill_null(0).to_numpy()
            vectors = batch.column("v")
            took, into = [np.flatnonzero(probes == 0)], [node[probes == 0]]  # what was small enough stays as it is
            order = np.flatnonzero(probes > 0)
            order = order[np.argsort(node[order], kind="stable")]
            for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(at):
                    x = np.stack(vectors.take(pa.array(at)).to_numpy(zero_copy_only=False))
                    found = _model(root, int(node[at[0]])).parts(x, int(probes[at[0]]) if many else 1)
                    took.append(np.repeat(at, found.shape[1]))
                    into.append(node[at[0]] * (FAN + 1) + 1 + found.ravel())
            rows = batch.select(names).take(pa.array(np.concatenate(took)))
            yield rows.set_column(names.index("node"), "node", pa.array(np.concatenate(into).astype(np.int64)))

    joined = d.join(nodes.select("node", "probes"), "node", "left").select(*names, "probes")
    if n_nodes > MODELS:
        joined = joined.repartition("node")
    return joined.mapInArrow(each, ", ".join(f"{c} {kind}" for c, kind in d.dtypes))


def index(rows: DataFrame, asked: DataFrame, k: int, least_recall: float, sample: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the part (``node``) of each, and ``asked`` with each part to visit."""
    rows, asked = rows.withColumn("node", F.lit(0).cast("long")), asked.withColumn("node", F.lit(0).cast("long"))
    # A part of more than twice LEAF is partitioned; one that cannot be (equal vectors) is left after as many levels as others need.
    n = rows.count()
    levels = math.ceil(math.log(max(1.0, n / LEAF), FAN)) + 1 if n > 2 * LEAF else 0
    for level in range(levels):
        sizes = scratch.write(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * LEAF), f"sizes-{level}")
        if not sizes.limit(1).count():
            break
        root = scratch.path(f"models-{level}")
        nodes = scratch.write(fit_nodes(rows, sizes, root, k, least_recall ** (1 / max(1, levels - 1)), sample), f"nodes-{level}")
        n_nodes = nodes.count()
        rows = scratch.write(routed(rows, nodes, n_nodes, root, False), f"rows-{level}")
        asked = scratch.write(routed(asked, nodes, n_nodes, root, True), f"asked-{level}")
    return rows, asked


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, least_recall: float = 0.94, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    vectors, queries: (vec_id, embedding), all vectors of one length. A query's own vec_id is left
    out. Rows without an id, or whose vector is null, zero or not finite, take no part. Ties go to
    the smaller vec_id; repeated rows are candidates each, and repeated query rows get their k each. With k or fewer other rows all are
    returned; an empty table gives no rows; other columns are not read."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.write(usable(vectors), "rows")
    rows = without_needless_copies(rows, k, scratch)
    # Each query row has a number of its own: a repeated one is searched for, and answered, by itself.
    asked = scratch.write(usable(queries).withColumn("row", F.monotonically_increasing_id()), "asked")
    rows, asked = index(rows, asked, k, least_recall, sample, scratch)
    count = lambda d, size, name: d.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = scratch.write(count(rows, BLOCK, "blocks").join(count(asked, ASKED, "shares"), "node"), "sizes")  # a row a part that is visited
    deal = lambda d, key, name: d.withColumn(name[:-1], F.pmod(F.xxhash64(key), F.col(name)).cast("int"))
    each = lambda d, name: d.withColumn(name[:-1], F.explode(F.sequence(F.lit(0), F.col(name) - 1)))
    members = each(deal(rows.join(sizes, "node"), "vec_id", "blocks"), "shares")
    wanted = each(deal(asked.join(sizes, "node"), "row", "shares"), "blocks")
    group = F.xxhash64("node", "block", "share")
    both = members.select(group.alias("g"), F.lit(0).alias("q"), "vec_id", "v", F.lit(None).cast("long").alias("row")).unionByName(wanted.select(group.alias("g"), F.lit(1).alias("q"), "vec_id", "v", "row"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of members come before the queries that visit them."""
        group, ids, mat, same = None, None, None, None
        held: list[tuple] = []

        def close() -> None:
            nonlocal ids, mat, same
            if held and ids is None:
                ids, mat = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.argsort(ids, kind="stable")
                ids, mat = ids[order], mat[order]
                # Of equal vectors only the k + 1 smallest ids, and k rows of each, can come among a
                # query's k (its own id is left out): the others would only make ties that are lost.
                _, same = np.unique(mat, axis=0, return_inverse=True)
                by = np.argsort(same, kind="stable")
                at = np.arange(len(by))
                vector = np.r_[True, same[by][1:] != same[by][:-1]]
                one = vector | np.r_[True, ids[by][1:] != ids[by][:-1]]
                copy = at - np.maximum.accumulate(np.where(one, at, 0))
                other = np.cumsum(one)
                other -= np.maximum.accumulate(np.where(vector, other, 0))
                keep = np.empty(len(by), bool)
                keep[by] = (other <= k) & (copy < k)
                ids, mat = ids[keep], mat[keep]
                held.clear()

        for batch in batches:
            g, q = batch.column("g").to_numpy(), batch.column("q").to_numpy()
            v = batch.column("v")
            bounds = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (q[1:] != q[:-1]), True])
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                if g[a] != group:
                    group, ids, mat = g[a], None, None
                    held.clear()
                vec = batch.column("vec_id").slice(a, b - a).to_numpy()
                x = np.stack(v.slice(a, b - a).to_numpy(zero_copy_only=False))
                if q[a] == 0:
                    held.append((vec, x))
                    continue
                row = batch.column("row").slice(a, b - a).to_numpy()
                close()
                if ids is None:
                    continue
                for at in range(0, len(vec), QUERIES):
                    s = _scores(x[at : at + QUERIES], mat)
                    s[vec[at : at + QUERIES, None] == ids[None, :]] = -np.inf
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k] if len(ids) <= 4 * k else _best(s, k)
                    val = np.take_along_axis(s, best, 1)
                    keep = val > -np.inf
                    ends = np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)
                    lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                    yield pa.record_batch([pa.array(row[at : at + QUERIES]), pa.array(vec[at : at + QUERIES]), lists(ids[best][keep]), lists(-val[keep])], names=["row", "query_id", "ids", "s"])

    kinds = dict(rows.dtypes)["vec_id"]
    found = both.repartition("g").sortWithinPartitions("g", "q").mapInArrow(ranked, f"row long, query_id {dict(asked.dtypes)['vec_id']}, ids array<{kinds}>, s array<double>")
    # A row a query row and block, of k candidates each: (probes x blocks) rows of a query meet here.
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("s", F.col("ids").alias("vec_id"))))), 1, k)
    top = found.groupBy("row", "query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "b"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, largest first, ties to the smaller column."""
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(s), k), np.int64)
    for i in range(len(s)):
        at = np.flatnonzero(s[i] >= kth[i])
        out[i] = at[np.argsort(-s[i, at], kind="stable")[:k]]
    return out


def ann_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 20 = 0"))

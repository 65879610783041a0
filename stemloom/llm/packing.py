"""Mixture-controlled packing of token streams into fixed windows by deficit round-robin.

Each source is a queue: its documents in order, as one stream of tokens. In every round each
queue earns its quantum, ``window`` tokens times its target share, and sends whole cuts of
``cut`` tokens while its deficit counter covers them; what is left of the counter is carried to
the next round. A queue that runs dry leaves its share to the others. The rounds, one after the
other, make one stream, which is cut into windows.

Nothing here is simulated: what a queue has sent by the end of round r is
``min(length, floor(r * quantum / cut) * cut)``, so a piece's place in the stream follows from
its place in its queue and the queues' lengths. Deficits thereby carry across windows and across
Spark partitions alike, and no token moves through a shuffle: the texts are encoded once, written
with their counts, and placed where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.tokenizing import default_vocabulary, encoder, forget
from stemloom.llm.workers import lean
from stemloom.scratch import Scratch

#: More sources than this share queues by hash, so that the driver's table of queues is bounded.
MAX_QUEUES = 4096
#: Quanta are counted in these parts of a token.
UNIT_BITS = 16

PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Plan:
    """The queues, in the order of their turns: how many tokens each holds, and its quantum."""

    def __init__(self, names: list[str], lengths: list[int], shares: list[float], window: int, cut: int):
        self.names = {n: i for i, n in enumerate(names)}
        self.length = np.array(lengths, np.int64)
        total = sum(shares) or 1
        self.quantum = np.maximum(1, np.array([round((window << UNIT_BITS) * s / total) for s in shares], np.int64))
        self.window, self.cut = window, cut
        self.total = int(self.length.sum())
        full, rest = divmod(self.total, window)
        self.full = full * window
        #: The rest is cut at powers of two, which need no padding.
        self.tail = np.cumsum([0, *(1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1)]) + self.full

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """By queue and round: tokens sent before the round."""
        earned = (rounds[None, :] * self.quantum[:, None]) >> UNIT_BITS
        return np.minimum(self.length[:, None], earned // self.cut * self.cut)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round in which a queue sends its given token."""
        need = (token // self.cut + 1) * self.cut << UNIT_BITS
        return -(-need // self.quantum[queue]) - 1

    def place(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of a queue, as pieces: (run, start in the run, length, window, offset, window's length)."""
        first, last = self.round_of(queue, begin), self.round_of(queue, begin + length - 1)
        # A queue that sends in most rounds is gone through by rounds, any other by its cuts.
        cuts = (begin + length - 1) // self.cut - begin // self.cut + 1
        by_cut = cuts < last - first + 1
        n = np.where(by_cut, cuts, last - first + 1)
        run = np.repeat(np.arange(len(queue)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        q = queue[run]
        r = np.where(by_cut[run], self.round_of(q, (begin[run] // self.cut + step) * self.cut), first[run] + step)
        rounds, at = np.unique(r, return_inverse=True)
        start, length_, pos = np.empty(len(r), np.int64), np.empty(len(r), np.int64), np.empty(len(r), np.int64)
        for lo in range(0, len(rounds), 4096):
            some = rounds[lo : lo + 4096]
            before, after = self.sent(some), self.sent(some + 1)
            turn = np.cumsum(after - before, 0) - (after - before)
            base = before.sum(0)
            here = np.flatnonzero((at >= lo) & (at < lo + 4096))
            k, qq = at[here] - lo, q[here]
            a, b = before[qq, k], after[qq, k]
            cut_from = np.where(by_cut[run[here]], (begin[run[here]] // self.cut + step[here]) * self.cut, a)
            cut_to = np.where(by_cut[run[here]], cut_from + self.cut, b)
            s = np.maximum(np.maximum(a, cut_from), begin[run[here]])
            e = np.minimum(np.minimum(b, cut_to), begin[run[here]] + length[run[here]])
            start[here], length_[here] = s, e - s
            pos[here] = base[k] + turn[qq, k] + s - a
        keep = length_ > 0
        run, start, length_, pos = run[keep], (start - begin[run])[keep], length_[keep], pos[keep]
        done = []
        while len(run):  # a piece that crosses the end of a window goes on in the next
            in_tail = np.clip(np.searchsorted(self.tail, pos, "right") - 1, 0, len(self.tail) - 1)
            lo = np.where(pos < self.full, pos // self.window * self.window, self.tail[in_tail])
            hi = np.where(pos < self.full, lo + self.window, self.tail[np.minimum(in_tail + 1, len(self.tail) - 1)])
            seq = np.where(pos < self.full, pos // self.window, self.full // self.window + in_tail)
            here = np.minimum(length_, hi - pos)
            done.append((run, start, here, seq, pos - lo, hi - lo))
            more = length_ > here
            run, start, length_, pos = run[more], (start + here)[more], (length_ - here)[more], (pos + here)[more]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 6


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Whole texts as ids (16-bit where the vocabulary allows) and ``end_id``, with each queue's running count in the partition."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        end = np.array([end_id], coder.dtype).tobytes()
        held: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                ids = [x + end for x in coder.encode(some.column("text").to_pylist())]
                sizes = [len(x) // coder.dtype.itemsize for x in ids]
                before = []
                for queue, n in zip(some.column("queue").to_pylist(), sizes):
                    before.append(held.get(queue, 0))
                    held[queue] = before[-1] + n
                yield pa.record_batch(
                    [*(some.column(c) for c in keep), some.column("queue"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array([part] * len(ids), pa.int64())],
                    names=[*keep, "queue", "ids", "n_tokens", "before", "part"],
                )
        del coder
        forget(vocabulary)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", queue string, ids binary, n_tokens long, before long, part long"
    return docs.select(*keep, "queue", F.col("text").cast("string").alias("text")).mapInArrow(lean(encoded), schema)


def pack(docs: DataFrame, window: int = 2048, shares: dict[str | None, float] | None = None, cut: int = 1, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of the documents (doc_id, source, text), each at its place in a sequence.

    shares: target share of each source; by default its share of all tokens, so that every window
    has the corpus's own mixture to within ``cut`` tokens a source. A source without a share gets
    none until the others have run dry. cut: documents are cut for a turn at multiples of it in
    their queue; larger cuts make fewer, longer pieces and a coarser mixture in each window.

    Null texts are empty: the end id alone. A null source is a queue of its own. Repeated rows
    and ids are packed each on its own; ties do not arise, as every row has its own place. Other
    columns are not read. An empty table gives no rows. Sequences have ``window`` tokens, but for
    the last few, which have a power of two each and so need no padding. Without ``shares``, more than
    ``MAX_QUEUES`` sources are hashed into that many queues: the mixture of a window then holds per
    queue, not per source; all tokens are packed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    vocabulary = vocabulary or default_vocabulary()
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("?"))
    names = docs.select(queue.alias("q")).distinct().limit(MAX_QUEUES + 1).count() if shares is None else 0
    if names > MAX_QUEUES:
        queue = F.concat(F.lit("#"), F.pmod(F.xxhash64(queue), F.lit(MAX_QUEUES)).cast("string"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").withColumn("queue", queue)
    tokens = scratch.write(encode_documents(rows, vocabulary, end_id), "tokens")
    parts = scratch.write(tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "parts")
    lengths = dict(parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    ordered = sorted(lengths)
    target = {"?" if k is None else f"={k}": v for k, v in (shares or {}).items()}
    plan = Plan(ordered, [lengths[q] for q in ordered], [target.get(q, 0) if shares else lengths[q] for q in ordered], window, cut)
    base = parts.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    code = {2: "<u2", 4: "<u4"}[encoder(vocabulary).dtype.itemsize]
    forget(vocabulary)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                n = batch.column("n_tokens").to_numpy()
                begin = batch.column("before").to_numpy() + batch.column("base").to_numpy()
                queues = np.array([plan.names[q] for q in batch.column("queue").to_pylist()], np.int64)
                run, start, length, seq, offset, size = plan.place(queues, begin, n)
                ids = [np.frombuffer(x, code).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(run)), batch.column("source").take(pa.array(run)), pa.array(start), pa.array(length),
                        pa.array([ids[i][4 * s : 4 * (s + k)] for i, s, k in zip(run.tolist(), start.tolist(), length.tolist())], pa.binary()),
                        pa.array(n[run]), pa.array(seq), pa.array(offset), pa.array(size),
                    ],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = PIECES.replace("doc_id long", f"doc_id {kind}")
    return tokens.join(base, ["queue", "part"]).select("doc_id", "source", "queue", "ids", "n_tokens", "before", "base").mapInArrow(lean(placed), schema)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def pack_query(spark, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))

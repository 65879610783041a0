"""Removal of long byte strings that occur more than once, exactly and over the whole corpus.

The method asked for, external induced sorting of all suffixes, carries tuples of some tens of
bytes for every byte of text; see the README for why it is not used here. What it is asked to find
is found by an anchoring that is exact as well:

1. Every window of ``length`` bytes has an anchor: of the ``GRAM``-byte strings inside it, the one
   of least hash (the leftmost of equal ones). Equal windows have equal anchors at equal places.
   Neighbouring windows mostly share theirs, so a text is a sequence of runs of windows, one for
   each anchor, about ``length / 2`` windows long. Only runs are exchanged, as two hashes each: of
   the anchor, and of all the bytes that the run's windows cover.
2. Runs that are equal in whole are repeated in every window. Counting does not need them together.
3. An anchor that lies in several different runs may share some windows and not others. One run of
   each kind is taken apart into hashes of its windows, and windows that two kinds hold are repeated.

Texts stay where they are: pass 1 writes them in files of its own, and later passes open those
files instead of moving texts through a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.scratch import Scratch

LENGTH, GRAM = 400, 128
#: Bytes of text that are hashed at once; longer texts go through in pieces that overlap by a window.
PIECE = 1 << 20
_VALUE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "power"
    if key not in _tables or len(_tables[key]) < n:
        base = pow(_P, -1, 1 << 64) if inverse else _P
        with np.errstate(over="ignore"):
            _tables[key] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, PIECE + 4096), base, np.uint64))])
    return _tables[key]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(len(data), False)[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, its length included."""
    with np.errstate(over="ignore"):
        return _mixed((sums[ends] - sums[starts]) * _power(len(sums), True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row: of the tail of one block of w and the head of the next."""
    n = len(h) - w + 1
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a text's windows: first window, number of windows, anchor's hash, hash of the bytes covered.

    A very long text is done in pieces; at a cut a run is split in two, which merely makes two kinds
    of what would have been one, at a place that step 3 then compares window by window."""
    parts = []
    step = PIECE - length
    for at in range(0, max(1, len(data) - length + 1), step):
        some = data[at : at + step + length - 1]
        if len(some) < length:
            break
        with np.errstate(over="ignore"):
            sums = _sums(some)
            n = len(some) - gram + 1
            grams = _mixed((sums[gram:] - sums[:n]) * _power(n, True)[:n])
        w = length - gram + 1
        least = _least_in_windows(grams, w)
        # The anchor of a window is the first gram with that hash at or after the window's start.
        if len(least) > 1:
            place = _first_at_or_after(grams, least)
        else:
            place = np.array([int(np.argmin(grams[:w]))])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        parts.append((first + at, count, grams[place[first]], _hashes(sums, first, first + count - 1 + length), place[first] - first))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    first, count, anchor, whole, lead = (np.concatenate(x) for x in zip(*parts))
    # The whole's key includes where its anchor lies: equal bytes then have equal windows.
    return first, count, anchor, _mixed(whole ^ (lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _first_at_or_after(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For window i, the first place p >= i with grams[p] == least[i]."""
    i = np.arange(len(least))
    # Anchors only move right: candidates are the places whose gram is the least of the window that
    # ends or starts there, so take each change of value and settle equal grams by searching.
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    out = np.empty(len(least), np.int64)
    ends = np.r_[new[1:], len(least)]
    lo = np.searchsorted(ranked, least[new], "left")
    hi = np.searchsorted(ranked, least[new], "right")
    single = hi - lo == 1
    out[:] = np.repeat(order[lo], ends - new)
    for k in np.flatnonzero(~single).tolist():
        places = order[lo[k] : hi[k]]
        span = i[new[k] : ends[k]]
        out[new[k] : ends[k]] = places[np.searchsorted(places, span)]
    return out


#: Texts in a row group of the written files; a file ends before its numbers run out of bits.
ROWS, FILE_ROWS = 128, 1 << 22
#: Kinds of an anchor's runs that one task compares at once; anchors with more are taken apart row by row.
KINDS = 20_000
#: A kind of run with more occurrences is looked up apart from the others.
OFTEN = 10_000
#: Most tasks that files are dealt to.
TASKS = 20_000


def _code(seq: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's place in its file: the text's number, the first window, and how many windows."""
    return (np.int64(seq) << 41) | (first.astype(np.int64) << 9) | (count.astype(np.int64) - 1)


def _path(base: str, file: int) -> str:
    return f"{base}/{file:x}.parquet"


def write_texts(docs: DataFrame, root: str, length: int, gram: int) -> DataFrame:
    """Pass 1. Per document: file, seq (null for texts too short to hold a window), doc_id, n_bytes, sha256, and its runs."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        file, out, seq, held = 0, None, 0, []
        schema = pa.schema([("text", pa.binary())])

        def flush() -> None:
            if held:
                out.write_table(pa.table([pa.array(held, pa.binary())], schema=schema), row_group_size=ROWS)
                held.clear()

        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                ids = batch.column("doc_id").slice(at, 256)
                for text in batch.column("text").slice(at, 256).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    sha = hashlib.sha256(raw).hexdigest()
                    if len(raw) < length:
                        rows.append((0, None, len(raw), sha, [], [], []))
                        continue
                    if out is None or seq >= FILE_ROWS:
                        if out is not None:
                            flush()
                            out.close()
                        file, seq = (task << 32) | (uuid.uuid4().int & 0xFFFFFFFF), 0
                        out = pq.ParquetWriter(_path(base, file), schema, filesystem=store, compression="zstd", use_dictionary=False, write_statistics=False)
                    first, count, anchor, whole = runs_of(np.frombuffer(raw, np.uint8), length, gram)
                    rows.append((file, seq, len(raw), sha, _code(seq, first, count), anchor.view(np.int64), whole.view(np.int64)))
                    held.append(raw)
                    seq += 1
                    if len(held) == ROWS:
                        flush()
                file_, seq_, n, sha, code, anchor, whole = zip(*rows)
                longs = pa.list_(pa.int64())
                yield pa.record_batch(
                    [pa.array(file_, pa.int64()), pa.array(seq_, pa.int64()), ids, pa.array(n, pa.int64()), pa.array(sha), pa.array(code, longs), pa.array(anchor, longs), pa.array(whole, longs)],
                    names=["file", "seq", "doc_id", "n_bytes", "sha256", "code", "anchor", "whole"],
                )
        if out is not None:
            flush()
            out.close()

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(written, f"file long, seq long, doc_id {kind}, n_bytes long, sha256 string, code array<long>, anchor array<long>, whole array<long>")


class _Texts:
    """Texts of the written files, asked for in order; one row group is held."""

    def __init__(self, root: str):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.file, self.reader, self.group, self.rows = None, None, None, None

    def get(self, file: int, seq: int) -> bytes:
        if file != self.file:
            if self.reader is not None:
                self.reader.close(force=True)
            self.reader = pq.ParquetFile(self.store.open_input_file(_path(self.base, file)))
            self.file, self.group = file, None
        if seq // ROWS != self.group:
            self.group = seq // ROWS
            self.rows = self.reader.read_row_group(self.group).column("text")
        return self.rows[seq % ROWS].as_py()


def _contexts(runs: DataFrame, root: str, length: int, tasks: int) -> DataFrame:
    """Pass 2. (anchor, file, code, bytes): the bytes that a run's windows cover.

    Files are dealt out by their number: the rows that ask for their texts say nothing of their size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(root)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                out = []
                for file, code in zip(some.column("file").to_pylist(), some.column("code").to_pylist()):
                    first = code >> 9 & 0xFFFFFFFF
                    out.append(texts.get(file, code >> 41)[first : first + (code & 511) + length])
                yield pa.record_batch([some.column("anchor"), some.column("file"), some.column("code"), pa.array(out, pa.binary())], names=["anchor", "file", "code", "bytes"])

    rows = runs.select("anchor", "file", "code").repartition(tasks, "file").sortWithinPartitions("file", "code")
    return rows.mapInArrow(each, "anchor long, file long, code long, bytes binary")


def _windows(context: bytes, length: int) -> np.ndarray:
    data = np.frombuffer(context, np.uint8)
    with np.errstate(over="ignore"):
        sums = _sums(data)
    starts = np.arange(len(data) - length + 1)
    return _hashes(sums, starts, starts + length)


def _shared_in_groups(contexts: DataFrame, length: int) -> DataFrame:
    """(file, first, last): windows of a run that another kind of run with its anchor has too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        anchor = None

        def settle() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            windows = [_windows(b, length) for _, _, b in held]
            sizes = np.array([len(w) for w in windows])
            all_ = np.concatenate(windows)
            _, inverse, count = np.unique(all_, return_inverse=True, return_counts=True)
            # A run has no window twice under one anchor place, so a count of two is of two kinds.
            twice = (count > 1)[inverse]
            edge = np.cumsum(sizes)[:-1]
            start = twice & np.r_[True, ~twice[:-1]]
            stop = twice & np.r_[~twice[1:], True]
            if len(edge):
                start[edge] |= twice[edge]
                stop[edge - 1] |= twice[edge - 1]
            a, b = np.flatnonzero(start), np.flatnonzero(stop)
            run = np.repeat(np.arange(len(sizes)), sizes)[a]
            base = np.cumsum(sizes) - sizes
            code = np.array([c for _, c, _ in held], np.int64)[run]
            file = np.array([f for f, _, _ in held], np.int64)[run]
            first = code >> 9 & 0xFFFFFFFF
            return pa.record_batch([pa.array(file), pa.array(code >> 41), pa.array(first + a - base[run]), pa.array(first + b - base[run])], names=["file", "seq", "first", "last"])

        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                for key, file, code, raw in zip(*(some.column(c).to_pylist() for c in ("anchor", "file", "code", "bytes"))):
                    if key != anchor:
                        if (out := settle()) is not None and len(out):
                            yield out
                        held, anchor = [], key
                    held.append((file, code, raw))
        if (out := settle()) is not None and len(out):
            yield out

    rows = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(compare, "file long, seq long, first long, last long")


def _shared_one_by_one(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The same for anchors with very many kinds of runs: each window a row, so that no task holds an anchor's kinds together."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                w = [_windows(x, length) for x in some.column("bytes").to_pylist()]
                run = np.repeat(np.arange(len(some)), [len(x) for x in w])
                nth = np.arange(len(run)) - np.concatenate([[0], np.cumsum([len(x) for x in w])])[run]
                anchor, file, code = (some.column(c).to_numpy()[run] for c in ("anchor", "file", "code"))
                yield pa.record_batch([pa.array(x) for x in (anchor, np.concatenate(w).view(np.int64), file, code >> 41, (code >> 9 & 0xFFFFFFFF) + nth)], names=["anchor", "window", "file", "seq", "first"])

    windows = scratch.write(contexts.mapInArrow(apart, "anchor long, window long, file long, seq long, first long"), "windows")
    # A window is hot where many kinds hold it; counts are combined before the exchange, and the join's skew is Spark's to split.
    twice = scratch.write(windows.groupBy("anchor", "window").count().where("count > 1").select("anchor", "window"), "twice")
    return windows.join(twice, ["anchor", "window"], "left_semi").select("file", "seq", "first", F.col("first").alias("last"))


def repeated_runs(texts: DataFrame, root: str, length: int, scratch: Scratch, tasks: int) -> DataFrame:
    """(file, seq, first, last) of runs of windows that occur elsewhere; runs may touch or overlap."""
    runs = texts.where("size(code) > 0").select("file", F.explode(F.arrays_zip("code", "anchor", "whole")).alias("r")).select("file", "r.*")
    # Anchors that occur twice or more, and whether all their runs are of one kind.
    met = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    # Written, so that the join below deals both of its sides anew and Spark can split a hot anchor's rows.
    met = scratch.write(met.where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "met")
    again = scratch.write(runs.join(met, "anchor"), "again")
    mixed = again.where("mixed")
    kinds = scratch.write(mixed.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "code")).alias("r")), "kinds")
    # The few kinds that occur very often are met by a join of their own, so that none of them is a hot key of the other.
    often = scratch.write(kinds.where(F.col("n") > OFTEN).select("anchor", "whole"), "often")
    key = ["anchor", "whole"]
    rest = mixed.join(often, key, "left_anti").join(kinds.where((F.col("n") > 1) & (F.col("n") <= OFTEN)), key, "left_semi")
    whole = reduce(DataFrame.unionByName, (d.select("file", "code") for d in (again.where("NOT mixed"), mixed.join(often, key, "left_semi"), rest)))
    first = F.shiftright("code", 9).bitwiseAND(F.lit(0xFFFFFFFF))
    whole = whole.select("file", F.shiftright("code", 41).alias("seq"), first.alias("first"), (first + F.col("code").bitwiseAND(F.lit(511))).alias("last"))
    many = scratch.write(kinds.groupBy("anchor").count().where(F.col("count") > KINDS).select("anchor"), "many")
    reps = kinds.select("anchor", "r.file", "r.code")
    found = whole.unionByName(_shared_in_groups(_contexts(reps.join(many, "anchor", "left_anti"), root, length, tasks), length))
    if many.limit(1).count():
        found = found.unionByName(_shared_one_by_one(_contexts(reps.join(many, "anchor", "left_semi"), root, length, tasks), length, scratch))
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (the maximal removed runs, [start, end) in bytes),
    kept_sha256, and the remaining bytes (``kept``; left out without ``kept_text``, null for texts without removals).

    Every byte of the UTF-8 text that a ``length``-byte string covers which also starts at another
    place, in the same or another document, is removed; strings are judged on the input. Null and
    empty texts have no bytes. Repeated rows and ids are documents of their own, so the texts of
    repeated rows go in every row, as the rule has it. Null ids are kept; other columns are not
    read; an empty table gives no rows."""
    if not 32 <= gram < length or length - gram + 1 > 512:
        raise ValueError("an anchor's runs must have at most 512 windows")
    scratch = Scratch(docs.sparkSession, "repeats")
    root = scratch.path("bytes")
    texts = scratch.write(write_texts(docs, root, length, gram), "texts")
    files = texts.where("seq IS NOT NULL").select("file").distinct().count()
    tasks = max(1, min(TASKS, 2 * files))
    found = scratch.write(repeated_runs(texts, root, length, scratch, tasks), "found")
    scratch.drop("met", "again", "kinds", "often", "many", "windows", "twice")
    # A document's own runs meet here, and no others.
    spans = found.groupBy("file", "seq").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))
    rows = texts.select("file", "seq", "doc_id", "n_bytes", "sha256").join(spans, ["file", "seq"], "left")
    rows = rows.select("file", "seq", "doc_id", "n_bytes", "sha256", F.transform("s", lambda x: x["first"]).alias("first"), F.transform("s", lambda x: x["last"]).alias("last"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Texts(root)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                out = []
                for file, seq, n, sha, first, last in zip(*(some.column(c).to_pylist() for c in ("file", "seq", "n_bytes", "sha256", "first", "last"))):
                    if not first:
                        out.append((0, [], sha, None))
                        continue
                    a, b = np.array(first), np.maximum.accumulate(np.array(last) + length)
                    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    starts, ends = a[new].tolist(), b[np.r_[new[1:] - 1, len(b) - 1]].tolist()
                    raw = source.get(file, seq)
                    kept = b"".join(raw[x:y] for x, y in zip([0, *ends], [*starts, n]))
                    out.append((n - len(kept), [{"start": x, "end": y} for x, y in zip(starts, ends)], hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
                removed, runs, digest, kept = zip(*out)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([some.column("doc_id"), some.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, span), pa.array(digest), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    # Short texts have no file; they are dealt out by their hashes instead.
    dealt = rows.repartition(tasks, F.when(F.col("seq").isNull(), F.xxhash64("sha256")).otherwise(F.col("file"))).sortWithinPartitions("file", "seq")
    return dealt.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def repeats_query(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept_text=False)
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

"""Exact substring deduplication with a logarithmic family of suffix indexes.

Every byte covered by a `length`-byte string that also starts elsewhere is removed.
Suffixes are sampled by content: each window of `length` bytes chooses the place in
it whose short gram has the least hash, so equal windows choose the same place and
the sampled suffixes (about 1.7 % of all) meet every repeat. A suffix is kept with
the run of windows that chose it and the hash of the bytes that they cover.

Chunks of texts are the batches. A batch's suffixes are sorted (gram first, covered
bytes second) and dealt by gram to tasks; each task scans a new batch against the
sorted levels it has, reports matches, and merges levels of equal size, so that
their number grows with the logarithm of the batches. A suffix whose whole run has
an equal is settled there. One that shares only its gram has its windows compared
one by one, by a second family with the windows' own hashes.

Copies within a batch are settled in the batch and represented by one suffix, so a
hot passage costs a task one entry a batch. Equality is by hashes of 96 bits
(runs) or 64 bits within a task's bounded share (windows).

Nulls, ties, empties: a null text is empty; texts under `length` bytes stay whole;
all copies of a repeat go, the first too, and so do repeated rows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import BASE, BYTE, U64, chunks, having, load, materialised, mix, partitions_for, powers, repeated, texts
from ._blobs import ragged

LENGTH, GRAM = 200, 80
CHUNK = 8 << 20
_BLOCK = 1 << 19
_SIZE = _BLOCK + 1024
_POW = powers(BASE, _SIZE)
_INV = powers(pow(BASE, -1, 1 << 64), _SIZE)
_LOCAL = U64((1 << 20) - 1)
#: What is known of a suffix: its run repeats whole; the same, and others share its gram; only its gram is shared.
SETTLED, BOTH, OPEN = 1, 2, 3
_SENT = np.dtype([("q", "u8"), ("s", "u4"), ("row", "i8"), ("at", "u4"), ("n", "u1"), ("dup", "u1")])
_ENTRY = np.dtype([("q", "u8"), ("s", "u4"), ("row", "i8"), ("at", "u4"), ("n", "u1"), ("dup", "u1"), ("multi", "u1")])
_RUN = np.dtype([("row", "i8"), ("at", "u4"), ("n", "u1")])
_SPAN = np.dtype([("at", "u4"), ("n", "u2")])
SCHEMA = "kind int, bucket int, blob binary"


def _sums(block: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block) + 1, U64)
    np.cumsum(BYTE[block] * _POW[: len(block)], out=out[1:])
    return out


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(v) - w + 1
    pad = -len(v) % w
    rows = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def suffixes(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, first=None, stop=None):
    """Sampled suffixes of the texts in buf: gram hash, hash of the covered bytes, text, first window in it, windows.

    first and stop: rising ranges of windows, by place in buf; else all that lie within one text.
    """
    out = []
    ends = offs[1:]
    if first is None:
        first, stop = offs[:-1], np.maximum(ends - length + 1, offs[:-1])
    for a in range(0, len(buf) - length + 1, _BLOCK):
        block = buf[a : a + _BLOCK + length - 1]
        n = len(block) - length + 1
        S = _sums(block)
        g = mix((S[gram:] - S[:-gram]) * _INV[: len(block) - gram + 1])
        least = _sliding_min((g & ~_LOCAL) | np.arange(len(g), dtype=U64), length - gram + 1)
        valid = np.zeros(n + 1, np.int64)
        lo, hi = np.searchsorted(stop, a, "right"), np.searchsorted(first, a + n, "left")
        x, y = np.maximum(first[lo:hi] - a, 0), np.minimum(stop[lo:hi] - a, n)
        full = y > x
        np.add.at(valid, x[full], 1)
        np.add.at(valid, y[full], -1)
        idx = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(idx):
            continue
        anchor = (least[idx] & _LOCAL).astype(np.int64)
        at = np.flatnonzero(np.append(True, (np.diff(idx) != 1) | (np.diff(anchor) != 0)))
        p, count, anchor = idx[at], np.diff(np.append(at, len(idx))), anchor[at]
        s = mix((S[p + count - 1 + length] - S[p]) * _INV[p] + (count * 1024 + anchor - p).astype(U64) * U64(0x9E3779B97F4A7C15))
        doc = np.searchsorted(ends, p + a, "right")
        out.append((g[anchor], s, doc, p + a - offs[doc], count))
    if not out:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(buf: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hash of the window at each place of at (rising)."""
    out = []
    for a in range(0, max(len(buf) - length + 1, 0), _BLOCK):
        i, j = np.searchsorted(at, [a, a + _BLOCK])
        if j > i:
            S = _sums(buf[a : a + _BLOCK + length - 1])
            p = at[i:j] - a
            out.append(mix((S[p + length] - S[p]) * _INV[p]))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _spans(row: np.ndarray, code: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Rows (row, code, spans), one for each row and code."""
    order = np.lexsort((at, code, row))
    row, code = row[order], code[order]
    span = np.empty(len(order), _SPAN)
    span["at"], span["n"] = at[order], n[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(order) else np.zeros(0, np.int64)
    blobs = [span[a:z].tobytes() for a, z in zip(first, [*first[1:], len(order)], strict=True)]
    return pa.array(row[first], pa.int64()), pa.array(code[first].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())


def _batch_out(g, s, row, at, n, buckets: int):
    """The blobs of one batch: settled spans (kind 1), and sorted distinct suffixes by bucket (kind 0)."""
    e = np.empty(len(g), _SENT)
    e["q"] = (g & U64(0xFFFFFFFF00000000)) | (s >> U64(32))
    e["s"], e["row"], e["at"], e["n"] = s & U64(0xFFFFFFFF), row, at, n
    bucket = ((g & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((e["s"], e["q"], bucket))
    e, bucket = e[order], bucket[order]
    same = np.append(False, (e["q"][1:] == e["q"][:-1]) & (e["s"][1:] == e["s"][:-1]) & (bucket[1:] == bucket[:-1]))
    e["dup"] = np.append(same[1:], False)
    settled = e[same]
    e, bucket = e[~same], bucket[~same]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(e) else np.zeros(0, np.int64)
    kind, where = [0] * len(first), bucket[first].tolist()
    blobs = [e[a:z].tobytes() for a, z in zip(first, [*first[1:], len(e)], strict=True)]
    if len(settled):
        kind.append(1)
        where.append(int(settled["s"][0]) % buckets)
        blobs.append(settled.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


class Family:
    """Sorted levels of distinct suffixes; each is at least twice as long as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def scan(self, batch: np.ndarray) -> np.ndarray:
        """Flags what batch (sorted by q, s) and the levels have in common; stores what is new, returns the copies."""
        gram = lambda x: x["q"] >> U64(32)
        own = gram(batch)
        shared = np.append(False, own[1:] == own[:-1])
        batch["multi"] |= shared
        batch["multi"][:-1] |= shared[1:].astype(np.uint8)
        known = np.zeros(len(batch), bool)
        for level in self.levels:
            there = gram(level)
            a, z = np.searchsorted(there, own, "left"), np.searchsorted(there, own, "right")
            hit = np.flatnonzero(z > a)
            if not len(hit):
                continue
            i = np.minimum(np.searchsorted(level["q"], batch["q"][hit]), len(level) - 1)
            equal = (level["q"][i] == batch["q"][hit]) & (level["s"][i] == batch["s"][hit])
            level["dup"][i[equal]] = 1
            known[hit[equal]] = True
            # others of the gram: more than the equal one
            other = (z - a)[hit] > equal
            batch["multi"][hit[other]] = 1
            # of the level, all of the gram but an equal one if the batch has that alone: each gram once, however many share it
            first = np.flatnonzero(np.append(True, a[hit][1:] != a[hit][:-1]))
            alone = np.diff(np.append(first, len(hit))) == 1
            start, count = a[hit][first], (z - a)[hit][first]
            level["multi"][ragged(start[~alone], count[~alone])] = 1
            touched = ragged(start[alone], count[alone])
            of = np.repeat(first[alone], count[alone])
            level["multi"][touched[~(equal[of] & (touched == i[of]))]] = 1
        new = batch[~known]
        while self.levels and len(self.levels[-1]) < 2 * len(new):
            both = np.concatenate([self.levels.pop(), new])
            new = both[np.argsort(both["q"], kind="stable")]
        if len(new):
            self.levels.append(new)
        return batch[known]


def _emit(e: np.ndarray, code: np.ndarray):
    row, c, spans = _spans(e["row"], code, e["at"], e["n"])
    return pa.RecordBatch.from_arrays([row, c, spans], names=["row", "code", "spans"])


def _index(batches):
    family = Family()
    for b in batches:
        for kind, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            sent = np.frombuffer(blob.as_buffer().to_pybytes(), _SENT)
            e = np.zeros(len(sent), _ENTRY)
            for name in _SENT.names:
                e[name] = sent[name]
            copies = e if kind else family.scan(e)
            if len(copies):
                yield _emit(copies, np.full(len(copies), SETTLED))
    for level in family.levels:
        code = np.where(level["dup"] > 0, np.where(level["multi"] > 0, BOTH, SETTLED), np.where(level["multi"] > 0, OPEN, 0))
        if (code > 0).any():
            yield _emit(level[code > 0], code[code > 0])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """row, spans: the windows (first, count) of each text that start elsewhere too."""
    buckets = partitions_for(docs, 32)

    def sample(batches):
        for b in batches:
            rows = b.column(0).to_numpy()
            for lo, _, buf, offs in chunks(b.column(1), CHUNK):
                g, s, doc, at, n = suffixes(buf, offs)
                yield _batch_out(g, s, rows[lo + doc], at, n, buckets)

    index = lambda df: df.repartitionById(buckets, F.col("bucket")).mapInArrow(_index, "row long, code int, spans binary")
    runs = materialised(index(_keyed(docs).select("row", "text").mapInArrow(sample, SCHEMA)))

    def expand(batches):
        for b in batches:
            rows, spans = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi, buf, offs in chunks(b.column(2), CHUNK):
                own = [np.concatenate([np.frombuffer(x, _SPAN) for x in spans[i]]) for i in range(lo, hi)]
                base = np.repeat(offs[:-1], [len(x) for x in own])
                first = base + np.concatenate([x["at"] for x in own]).astype(np.int64)
                stop = first + np.concatenate([x["n"] for x in own]).astype(np.int64)
                order = np.argsort(first, kind="stable")
                yield _runs_out(buf, offs, rows[lo:hi], first[order], stop[order], buckets)

    ids = materialised(runs.filter(F.col("code") > SETTLED).select("row").distinct())
    open_ = runs.filter(F.col("code") > SETTLED).groupBy("row").agg(F.collect_list("spans").alias("spans"))
    some = having(_keyed(docs).select("row", "text"), ids, "row")
    sent = some.join(open_.hint("shuffle_hash"), "row").select("row", "spans", "text").mapInArrow(expand, "bucket int, blob binary")
    single = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_compare, "row long, code int, spans binary")
    return materialised(runs.filter(F.col("code") < OPEN).select("row", "spans").union(single.select("row", "spans")))


def _runs_out(buf, offs, rows, first, stop, buckets: int):
    """Runs of windows and the windows' hashes, by bucket of their gram: (bucket, blob)."""
    g, _, doc, at, n = suffixes(buf, offs, first=first, stop=stop)
    bucket = ((g & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int64)
    start = offs[doc] + at
    where = ragged(start, n)
    rise = np.argsort(where, kind="stable")
    h = np.empty(len(where), U64)
    h[rise] = window_hashes(buf, where[rise])
    run = np.empty(len(g), _RUN)
    run["row"], run["at"], run["n"] = rows[doc], at, n
    place = np.cumsum(n) - n
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    blobs = []
    for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
        some = order[a:z]
        blobs.append(np.uint32(len(some)).tobytes() + run[some].tobytes() + h[ragged(place[some], n[some])].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cut].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _compare(batches):
    """The windows of a task's runs that are there twice."""
    runs, hashes = [], []
    for b in batches:
        for blob in b.column(1):
            raw = blob.as_buffer().to_pybytes()
            k = int(np.frombuffer(raw, np.uint32, 1)[0])
            runs.append(np.frombuffer(raw, _RUN, k, 4))
            hashes.append(np.frombuffer(raw, U64, -1, 4 + k * _RUN.itemsize))
    if not runs:
        return
    run, h = np.concatenate(runs), np.concatenate(hashes)
    n = run["n"].astype(np.int64)
    again = np.flatnonzero(repeated(h))
    of = np.repeat(np.arange(len(run)), n)[again]
    at = run["at"].astype(np.int64)[of] + again - (np.cumsum(n) - n)[of]
    if not len(again):
        return
    first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(at) != 1)))
    count = np.diff(np.append(first, len(at)))
    row, code, spans = _spans(run["row"][of[first]], np.full(len(first), SETTLED), at[first], count)
    yield pa.RecordBatch.from_arrays([row, code, spans], names=["row", "code", "spans"])


def _covered(spans: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    span = np.concatenate([np.frombuffer(x, _SPAN) for x in spans])
    a = span["at"].astype(np.int64)
    z = a + span["n"].astype(np.int64) + length - 1
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    first = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
    return list(zip(a[first].tolist(), z[np.append(first[1:] - 1, len(z) - 1)].tolist(), strict=True))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of struct of first byte and end) and kept (binary)."""
    found = repeated_windows(docs)
    ids = materialised(found.select("row").distinct())
    spans = found.groupBy("row").agg(F.collect_list("spans").alias("spans"))
    cut = having(_keyed(docs), ids, "row").join(spans.hint("shuffle_hash"), "row").select("doc_id", "text", "spans")
    whole = having(_keyed(docs), ids, "row", "left_anti").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans"))
    rows = cut.union(whole)

    def run(batches):
        for b in batches:
            own, spans = texts(b.column(1)), b.column(2).to_pylist()
            for lo in range(0, b.num_rows, 500):
                size, removed, kept = [], [], []
                for i in range(lo, min(lo + 500, b.num_rows)):
                    raw = own[i].as_buffer().to_pybytes()
                    cuts = _covered(spans[i], LENGTH) if spans[i] else []
                    left = [0, *(z for _, z in cuts)]
                    size.append(len(raw))
                    removed.append([{"start": a, "end": z} for a, z in cuts])
                    kept.append(b"".join(raw[x:y] for x, y in zip(left, [*(a for a, _ in cuts), len(raw)], strict=True)) if cuts else raw)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(size)), pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(load(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

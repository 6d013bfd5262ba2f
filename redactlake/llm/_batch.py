"""Vectorised words, shingles and hashes over Arrow text batches.

A batch is worked through in chunks of a few MB, so that memory does not
follow the number of rows in a batch; a chunk holds whole texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK = 2 << 20
BLOCK = 1 << 19
#: Words of more bytes are hashed as a whole: a polynomial says less of longer ones.
_LONG = 1 << 9


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: White space of all contracts: space and tab to carriage return.
SEP = np.zeros(256, dtype=bool)
SEP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
POW = powers(BASE, _LONG)


def texts(column) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(column, limit: int = CHUNK):
    """(first row, end row, bytes, offsets) of runs of whole texts; a null text is empty."""
    arr = texts(column)
    if not len(arr):
        return
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray):
    """Words of the texts in buf: first byte, byte length, 64-bit hash, and where each text's words begin (one more entry than texts)."""
    n = len(buf)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    starts, lens, hashes = [], [], []
    a = 0
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            cut = np.flatnonzero(SEP[buf[a:b]] | first[a:b])
            cut = cut[cut > 0]
            if len(cut):
                b = a + int(cut[-1])
            else:
                size = BLOCK
                while b < n:  # a word longer than a block
                    more = np.flatnonzero(SEP[buf[b : b + size]] | first[b : min(n, b + size)])
                    if len(more):
                        b += int(more[0])
                        break
                    b = min(n, b + size)
        block = buf[a:b]
        idx = np.flatnonzero(~SEP[block])
        if len(idx):
            st = np.empty(len(idx), dtype=bool)
            st[0] = True
            st[1:] = np.diff(idx) != 1
            st |= first[a:b][idx]
            s = np.flatnonzero(st)
            ln = np.diff(np.append(s, len(idx)))
            pos = np.arange(len(idx)) - np.repeat(s, ln)
            v = BYTE[block[idx]]
            v *= POW[pos & (_LONG - 1)]
            h = np.add.reduceat(v, s)
            for k in np.flatnonzero(ln > _LONG):
                at = int(idx[s[k]])
                h[k] = xxhash.xxh64_intdigest(block[at : at + int(ln[k])].tobytes())
            starts.append(idx[s] + a)
            lens.append(ln)
            hashes.append(mix(h + ln.astype(U64)))
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offs), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(lens), np.concatenate(hashes), np.searchsorted(start, offs)


_STEP = powers(0xD1342543DE82EF95, 256)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, text ends ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def windows(bounds: np.ndarray, k: int):
    """First word of every run of k words within one text, and its text."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(bounds[:-1], count)
    return at, doc


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int):
    """Distinct k-word shingles of each text, sorted within it; fewer words make one shingle, no words none. (hashes, bounds)"""
    _, _, h, wb = words(LOWER[buf], offs)
    at, doc = windows(wb, k)
    sh = shingles(h, k)[at] if len(at) else np.zeros(0, U64)
    count = np.diff(wb)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = count[short].astype(U64) * U64(0x9E3779B97F4A7C15)
        for j in range(k - 1):
            there = count[short] > j
            own[there] += h[wb[short[there]] + j] * _STEP[j]
        own = mix(own)
        sh, doc = np.concatenate([sh, own]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    if len(sh):
        new = np.empty(len(sh), dtype=bool)
        new[0] = True
        new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
        sh, doc = sh[new], doc[new]
    return sh, np.searchsorted(doc, np.arange(len(offs)))


def segsum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds; empty runs give 0."""
    cs = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return cs[bounds[1:]] - cs[bounds[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    out = np.zeros(len(key), dtype=bool)
    if len(key) > 1:
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, below the session's warehouse where that is unset. It goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/redactlake-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def materialised(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, mb: int) -> int:
    """Partitions of about mb MB of df's size, and no fewer than the session's shuffle partitions.

    The size is the plan's estimate (that of the files read); without one, texts are summed.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // (mb << 20)), 1 << 20))


#: Rows of one long that a join may broadcast (some 30 MB); beyond them both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def having(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows with (left_anti: without) a key of keys, which is stored and is counted first."""
    few = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key, how)

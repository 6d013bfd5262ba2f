"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit distance.

Words are lower-cased and lose punctuation at their edges. A document is
contaminated by an item if some stretch of it is within a quarter of the item's
words (rounded down) of word edits.

Windows of an item's size are embedded by the CGK random walk, which turns edit
distance into Hamming distance; a window is a candidate if it agrees with the item
on all SAMPLED places of some of the repeated samples, of which there are enough for
the target recall at the full edit budget (measured: see AGREE). Places lie before
the walks end, and the padding behind a string agrees with nothing.
Windows are laid only where the q-gram lemma allows a match (an item within e edits
keeps at least L - q + 1 - q e of its q-grams within e diagonals), which drops
nothing. Candidates are verified by exact semi-global edit distance.

Items are taken in blocks of ITEMS and of ITEM_WORDS words, so what tasks get is
bounded whatever the size of the benchmark; a longer item is a block of its own.

Nulls, ties, empties: null and wordless texts and items match nothing; equal items
are each reported; overlapping matches of one item are one, the nearest, of equals
the first; repeated rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._batch import LOWER, U64, chunks, load, mix, shingles, windows, words
from ._blobs import ragged

ITEMS, ITEM_WORDS = 10_000, 1_000_000
#: Share of places in which walks agree at the full edit budget, about: on average 0.58 for 8 words, 0.48 for 20, 0.40 for 40, 0.32 for 80.
RECALL, AGREE, SAMPLED, WALKS, STEPS = 0.9999, 0.25, 2, 8, 1.6
#: Cells of embedded windows that are held at once.
CELLS = 1 << 21
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?()[]{}\"'*_-|&%$#")] = True
_PAD = U64(0)


def edits(n: int) -> int:
    return n // 4


def repetitions() -> int:
    """Samples after which two strings that agree in AGREE of the places meet with probability RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))


def bare_words(buf: np.ndarray, offs: np.ndarray):
    low = LOWER[buf]
    return words(np.where(_EDGE[low], np.uint8(32), low), offs)


def embed(x: np.ndarray, walk: int) -> np.ndarray:
    """The first STEPS * size steps of the CGK embedding of each row of x (words, padded by _PAD)."""
    n, m = x.shape
    steps = math.ceil(STEPS * m)
    x = np.concatenate([x, np.full((n, 1), _PAD)], axis=1)
    salt = mix(np.arange(steps, dtype=U64) + U64(walk * 1_000_003 + 1))
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, steps), U64)
    for j in range(steps):
        c = x[rows, at]
        out[:, j] = c
        at = np.minimum(at + (mix(c + salt[j]) & U64(1)).astype(np.int64), m)
    return out


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between item and a stretch of text, and its first and end word (the shortest of the first ones)."""
    m = len(text)
    one = m + 2  # an edit; below it the first word, of which the later is less
    place = np.arange(m + 1, dtype=np.int64)
    row = m - place
    for w in item:
        there = row[:-1] + np.where(text == w, 0, one)
        row = np.minimum(row + one, np.append(row[0] + one, there))
        row = np.minimum.accumulate(row - place * one) + place * one
    j = int(np.argmin(row // one))
    return int(row[j] // one), int(m - row[j] % one), j


class Index:
    """Items of one block: their words, q-grams by hash, embeddings and sampled places."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids, self.words = [], []
        for key, text in items:
            raw = (text or "").encode()
            _, _, h, _ = bare_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(h):
                self.ids.append(key)
                self.words.append(h)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([edits(n) for n in self.size], np.int64)
        grams: dict[int, list] = {}
        self.least = np.zeros(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            n, e = len(w), int(self.edits[i])
            q = min(3, -(-(n - e) // (e + 1)))
            self.least[i] = max(1, n - q + 1 - q * e)
            grams.setdefault(q, []).append((shingles(w, q), i))
        self.grams = {}
        for q, found in grams.items():
            h = np.concatenate([x for x, _ in found])
            item = np.concatenate([np.full(len(x), i) for x, i in found])
            at = np.concatenate([np.arange(len(x)) for x, _ in found])
            order = np.argsort(h)
            there = np.zeros(1 << 20, bool)
            there[(h >> U64(44)).astype(np.int64)] = True
            self.grams[q] = h[order], item[order], at[order], there
        self.longest = int(self.size.max()) if len(self.size) else 0
        rng = np.random.default_rng(11)
        each = -(-repetitions() // WALKS)
        self.samples = [rng.random(each * SAMPLED) for _ in range(WALKS)]
        # of the items' walks only the sampled places are kept
        self.own = [np.zeros((len(self.words), each * SAMPLED), U64) for _ in range(WALKS)]
        for i, w in enumerate(self.words):
            for k in range(WALKS):
                self.own[k][i] = embed(w[None, :], k)[0, self._places(k, np.array([i]))[0]]

    def _places(self, walk: int, item: np.ndarray) -> np.ndarray:
        return (self.samples[walk][None, :] * np.ceil(STEPS * self.size[item])[:, None]).astype(np.int64)

    def _regions(self, h: np.ndarray, wb: np.ndarray):
        """text, item, window start of the windows that the q-gram lemma allows."""
        docs, items, starts = [], [], []
        for q, (gram, item, at, there) in self.grams.items():
            place, doc = windows(wb, q)
            if not len(place):
                continue
            sh = shingles(h, q)[place]
            some = np.flatnonzero(there[(sh >> U64(44)).astype(np.int64)])
            sh = sh[some]
            a, z = np.searchsorted(gram, sh, "left"), np.searchsorted(gram, sh, "right")
            of = np.repeat(some, z - a)
            seed = ragged(a, z - a)
            docs.append(doc[of])
            items.append(item[seed])
            starts.append(place[of] - wb[doc[of]] - at[seed])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        doc, item, start = (np.concatenate(x) for x in (docs, items, starts))
        if not len(doc):
            return doc, item, start
        _, dense = np.unique(doc, return_inverse=True)
        key = ((dense * len(self.ids) + item) << 33) + start + (1 << 31)
        order = np.argsort(key, kind="stable")
        key, doc, item, start = key[order], doc[order], item[order], start[order]
        count = np.searchsorted(key, key + self.edits[item], "right") - np.arange(len(key))
        ok = count >= self.least[item]
        # all starts within e of one that has enough
        mark = np.zeros(len(key) + 1, np.int64)
        at = np.flatnonzero(ok)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + count[at], -1)
        keep = (np.cumsum(mark[:-1]) > 0) & np.append(True, key[1:] != key[:-1])
        return doc[keep], item[keep], start[keep]

    def _meets(self, x: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Rows of x that agree with their item on all places of some sample."""
        out = np.zeros(len(x), bool)
        for k in range(WALKS):
            left = np.flatnonzero(~out)
            if not len(left):
                break
            e, own = embed(x[left], k), self.own[k][item[left]]
            same = (np.take_along_axis(e, self._places(k, item[left]), 1) == own) & (own != _PAD)
            out[left] = same.reshape(len(left), -1, SAMPLED).all(axis=2).any(axis=1)
        return out

    def matches(self, buf: np.ndarray, offs: np.ndarray):
        """(text, item, first byte, end byte, edits) of every match."""
        first, length, h, wb = bare_words(buf, offs)
        if not self.longest or not len(h):
            return []
        doc, item, start = self._regions(h, wb)
        keep = np.zeros(len(doc), bool)
        order = np.argsort(self.size[item], kind="stable")  # windows of like sizes are embedded together
        a = 0
        while a < len(order):
            # as many as fit into CELLS by the largest of them
            sizes = self.size[item[order[a:]]]
            z = a + max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), CELLS)))
            some = order[a:z]
            d, i, s = doc[some], item[some], start[some]
            cell = np.arange(int(self.size[i].max()))[None, :]
            at = s[:, None] + cell
            inside = (cell < self.size[i][:, None]) & (at >= 0) & (at < np.diff(wb)[d][:, None])
            x = np.where(inside, h[np.clip(at + wb[d][:, None], 0, len(h) - 1)], _PAD)
            keep[some] = self._meets(x, i)
            a = z
        doc, item, start = doc[keep], item[keep], start[keep]
        out, k = [], 0
        while k < len(doc):  # candidates of one item that overlap are verified together
            z = k + 1
            while z < len(doc) and doc[z] == doc[k] and item[z] == item[k] and start[z] - start[z - 1] < self.size[item[k]]:
                z += 1
            d, i = int(doc[k]), int(item[k])
            e, n = int(self.edits[i]), int(self.size[i])
            lo, hi = int(wb[d]) + max(0, int(start[k]) - e), min(int(wb[d + 1]), int(wb[d]) + int(start[z - 1]) + n + e)
            far, a, b = nearest(self.words[i], h[lo:hi])
            if far <= e and b > a:
                out.append((d, i, int(first[lo + a] - offs[d]), int(first[lo + b - 1] + length[lo + b - 1] - offs[d]), far))
            k = z
        return out


def _indexes(benchmark: DataFrame):
    """A broadcast index of each block of the items that have text."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_WORDS))
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id (of any type), start and end (bytes), edits of every match."""
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    kind = benchmark.schema["item_id"].dataType
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, start long, end long, edits int"
    arrow = to_arrow_type(kind)
    out = None
    for index in _indexes(benchmark):

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                for lo, _, buf, offs in chunks(b.column(1)):
                    got = ix.matches(buf, offs)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([lo + x[0] for x in got], pa.int64())), pa.array([ix.ids[x[1]] for x in got], arrow), *(pa.array([x[k] for x in got], pa.int64()) for k in (2, 3)), pa.array([x[4] for x in got], pa.int32())],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        part = rows.mapInArrow(run, kinds)
        out = part if out is None else out.union(part)
    return out


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a match, unchanged."""
    at = docs.columns.index("text")
    for index in _indexes(load(spark, sf_dir, "benchmark")):

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, buf, offs in chunks(b.column(at)):
                    keep[[lo + x[0] for x in ix.matches(buf, offs)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

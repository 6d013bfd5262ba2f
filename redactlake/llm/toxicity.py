"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its
hashed features, words and the beginnings of words (languages that glue words
together share those); the document's is the noisy-or of its sentences, so a document
is toxic if any sentence is. Only documents are labelled; the gradient of the
noisy-or hands the blame to sentences. The worst sentence of each document is
located by the same scores.

Learning reads a sample of labelled documents. Tasks count in how many documents of
either label each feature stands; the SCREENED features that lean most to label 1 go
on, and only their places come to the driver, which fits the noisy-or.

Nulls, ties, empties: a text without words has score 0 and no worst sentence; of
equal sentences the first is reported; null labels are not learnt from; without
labels every score is 0; an empty table gives an empty result; repeated rows are
scored each; a text of any length is scored whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import BYTE, LOWER, POW, U64, chunks, load, materialised, mix, words
from .quality_classifier import fold

#: Features are hashed into so many places (weights: a fixed 1 MB for tasks).
BITS = 18
DIMS = 1 << BITS
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Labelled documents that the fit reads at most: the first by a hash of the id.
SAMPLE = 9000
#: Features that are fitted at most: each stands in three documents of label 1 and more, by LEAN standard deviations over its share.
SCREENED, LEAN = 4096, 5.0
THRESHOLD = 0.7
_END = np.zeros(256, dtype=bool)
_END[list(b".!?\n")] = True
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?()[]{}\"'*_-|&%$#")] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters of ASCII and Latin-1 in lower case; punctuation is a space."""
    low = LOWER[buf]
    second = np.flatnonzero(low[:-1] == 0xC3) + 1
    upper = second[(low[second] >= 0x80) & (low[second] <= 0x9E) & (low[second] != 0x97)]
    low[upper] += 32
    return np.where(_EDGE[low], np.uint8(32), low)


def sentences(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None):
    """(feature, sentence) pairs of the features to keep, one once a sentence, and the first byte and text of each sentence; a sentence has words."""
    flat = lowered(buf)
    start, size, h, wb = words(flat, offs)
    ends = np.flatnonzero(_END[buf])
    # a sentence is a text and a count of ends before the word
    doc = np.repeat(np.arange(len(wb) - 1), np.diff(wb))
    nth = np.searchsorted(ends, start)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (nth[1:] != nth[:-1]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    found, of = [], []

    def add(hashes, own):
        place = (hashes >> U64(64 - BITS)).astype(np.int64)
        some = slice(None) if keep is None else keep[place]
        found.append(place[some])
        of.append(own[some])

    add(h, sent)
    begun, flat = np.zeros(len(start), U64), np.append(flat, np.zeros(max(BEGINNINGS), np.uint8))
    for j in range(max(BEGINNINGS)):
        begun += BYTE[flat[start + j]] * POW[j]
        if j + 1 in BEGINNINGS:
            longer = size > j + 1
            add(mix(begun[longer] + U64(j + 1)), sent[longer])
    key = np.unique((np.concatenate(of) << BITS) + np.concatenate(found))
    return key & (DIMS - 1), key >> BITS, start[new], doc[new]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ascend(place, sent, of, bare, y, w, b, steps, rate, l1):
    """Adam on the log likelihood of the noisy-or, less l1 times the weights' absolute values.

    place, sent: features of sentences; of: documents of those; bare: sentences without a feature of each document, which all have score b.
    """
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(sent, weights=w[place], minlength=len(of)) + b
        p, own = sigmoid(z), float(sigmoid(np.array(b)))
        clean = np.bincount(of, weights=-np.logaddexp(0, z), minlength=len(y)) - bare * np.logaddexp(0, b)
        bag = np.maximum(-np.expm1(clean), 1e-9)
        blame = np.where(y > 0, np.exp(clean) / bag, -1.0)
        pull = p * blame[of]
        g = np.bincount(place, weights=pull[sent], minlength=len(w)) / len(y) - l1 * np.sign(w)
        gb = (pull.sum() + own * (blame * bare).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        w = w + step * m / (np.sqrt(v) + 1e-7)
        b += step * mb / (np.sqrt(vb) + 1e-7)
    return w, b


def fit(bags: list[tuple[np.ndarray, np.ndarray, int, int]], l1: float = 2e-4, start: float = -6.0):
    """Weights and bias from (features, their sentences, sentences, label) of each bag.

    A first fit under an absolute-value penalty finds the features that matter; a second
    one fits their weights anew without it, so that they are not shrunk.
    """
    count = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(len(bags)), count)
    found = np.concatenate([b[0] for b in bags])
    base = np.cumsum([0, *(b[2] for b in bags[:-1])])
    names, place = np.unique(found, return_inverse=True)
    ids, sent = np.unique(np.concatenate([b[1] for b in bags]) + base[doc], return_inverse=True)
    of = np.searchsorted(base, ids, "right") - 1
    bare = np.array([b[2] for b in bags], float) - np.bincount(of, minlength=len(bags))
    y = np.array([b[3] for b in bags], float)
    w, b = _ascend(place, sent, of, bare, y, np.zeros(len(names)), start, 150, 0.15, l1)
    chosen = np.abs(w) > 0.3
    keep = chosen[place]
    w, b = _ascend(place[keep], sent[keep], of, bare, y, np.where(chosen, w, 0.0), b, 100, 0.1, 1e-5)
    out = np.zeros(DIMS, np.float32)
    out[names] = np.where(chosen, w, 0.0)
    return out, float(b)


def _screened(rows: DataFrame) -> tuple[np.ndarray, bool]:
    """Which features go on, and whether there are labels of both kinds."""

    def run(batches):
        for b in batches:
            toxic = b.column(0).to_numpy() > 0
            for lo, hi, buf, offs in chunks(b.column(1)):
                place, sent, _, doc = sentences(buf, offs)
                own = np.unique((doc[sent] << BITS) + place)
                ones = toxic[lo:hi][own >> BITS]
                place, at = np.unique(own & (DIMS - 1), return_inverse=True)
                pos = np.bincount(at, weights=ones, minlength=len(place)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(pos), pa.array(np.bincount(at, minlength=len(place)) - pos)], names=["place", "pos", "neg"])

    ones, n = rows.agg(F.count_if(F.col("toxic") > 0), F.count(F.lit(1))).first()
    keep = np.zeros(DIMS, bool)
    if not 0 < ones < n:
        return keep, False
    share = ones / n
    counts = rows.mapInArrow(run, "place long, pos long, neg long").groupBy("place").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    due = (F.col("pos") + F.col("neg")) * share
    lean = counts.withColumn("lean", (F.col("pos") - due) / F.sqrt(due * (1 - share))).filter((F.col("pos") >= 3) & (F.col("lean") >= LEAN))
    keep[[r.place for r in lean.orderBy(F.desc("lean"), "place").limit(SCREENED).select("place").collect()]] = True
    return keep, True


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Weights and bias, or None without labels. The ids of the sample (at most `sample`) are broadcast; places of screened features come to the driver."""
    y = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(fold(F.col("doc_id"), 3) != 1)
        .orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    rows = materialised(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("toxic", "text"))
    keep, both = _screened(rows)
    if not both or not keep.any():
        return None

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in chunks(b.column(1)):
                place, sent, _, doc = sentences(buf, offs, keep)
                many = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(many) - many
                of = doc[sent]
                bounds = np.searchsorted(of, np.arange(hi - lo + 1))
                parts = [(place[a:z].astype(np.uint32).tobytes(), (sent[a:z] - f).astype(np.uint32).tobytes()) for a, z, f in zip(bounds[:-1], bounds[1:], first, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in parts], pa.binary()) for i in (0, 1)), pa.array(many.astype(np.int64)), b.column(0).slice(lo, hi - lo)], names=["places", "sents", "n", "toxic"])

    got = rows.mapInArrow(run, "places binary, sents binary, n long, toxic int").collect()
    return fit([(np.frombuffer(bytes(r[0]), np.uint32).astype(np.int64), np.frombuffer(bytes(r[1]), np.uint32).astype(np.int64), r[2], int(r[3] > 0)) for r in got])


_OUT = "score double, worst_start long, worst_score double, n_sentences long"


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, and of the worst sentence its first byte and score."""
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    weights, bias = model if model is not None else (None, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        used = None if w is None else w != 0
        for b in batches:
            parts = []
            for lo, hi, buf, offs in chunks(b.column(1)):
                p, s, first, doc = sentences(buf, offs, used)
                n = hi - lo
                if w is None or not len(first):
                    parts.append((np.zeros(n), np.full(n, -1), np.zeros(n), np.bincount(doc, minlength=n)))
                    continue
                z = np.bincount(s, weights=w[p], minlength=len(first)) + bias
                bag = -np.expm1(np.bincount(doc, weights=-np.logaddexp(0, z), minlength=n))
                order = np.lexsort((-np.arange(len(z)), z, doc))
                last = np.flatnonzero(np.append(np.diff(doc[order]) != 0, True))
                worst = np.full(n, -1)
                worst[doc[order[last]]] = order[last]
                has = worst >= 0
                parts.append((bag, np.where(has, first[worst] - offs[:-1], -1), np.where(has, sigmoid(z[worst]), 0.0), np.bincount(doc, minlength=n)))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.clip(cols[0], 0, 1)), pa.array(cols[1].astype(np.int64), mask=cols[1] < 0), pa.array(cols[2]), pa.array(cols[3].astype(np.int64))],
                names=["doc_id", "score", "worst_start", "worst_score", "n_sentences"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_score", "n_sentences")

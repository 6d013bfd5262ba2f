"""Quality rules with verdicts by host.

Counts over each whole text give the base rules; a document that breaks any rule is
a failure of its host. Host failure rates are shrunk towards the corpus by a beta
prior fitted to all hosts (method of moments), and a host goes when it is nearly
sure that most of its documents fail.

Nulls, ties, empties: a null text has no words and fails; a null host is a host of
its own; rows that repeat are counted each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import SEP, U64, chunks, load, materialised, mix, repeated, segsum, shingles, windows, words

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    kept = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
    return len(kept) - len(set(kept))


def text_counts(column) -> np.ndarray:
    """COUNTS of every text of an Arrow column, a row each."""
    parts = []
    for _, _, buf, offs in chunks(column):
        _, _, h, wb = words(buf, offs)
        code_point = ~SEP[buf] & ((buf & 0xC0) != 0x80)
        at, doc = windows(wb, WINDOW)
        mark = np.zeros(len(h) + 1, dtype=np.int64)
        if len(at):
            again = at[repeated(mix(shingles(h, WINDOW)[at] + doc.astype(U64) * U64(0x9E3779B97F4A7C15)))]
            mark[again] += 1
            mark[again + WINDOW] -= 1
        raw = buf.tobytes()
        lines = np.array([_dup_lines(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], dtype=np.int64)
        parts.append(np.stack([np.diff(wb), segsum(code_point, offs), segsum(_SYMBOL[buf], offs), lines, segsum(np.cumsum(mark)[:-1] > 0, wb)], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep and COUNTS of every row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        for b in batches:
            c = text_counts(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    schema = rows.select(*keep, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def broken() -> Column:
    """Any rule: the base rules, symbols by word, mean word length, repeated lines."""
    w = F.col("n_words")
    return base_failed() | (F.col("n_symbols") * 10 > w) | (F.col("word_chars") < 2 * w) | (F.col("word_chars") > 15 * w) | (F.col("n_dup_lines") * 20 > w)


def host_verdicts(rows: DataFrame, host: str, most: float = 0.5, z: float = 2.0) -> DataFrame:
    """Hosts with documents, failures, shrunk rate and verdict; rows has host and failed.

    prior: a beta whose mean and variance are those of the host rates, weighted by
    documents. A host goes if its shrunk rate, less z posterior deviations, is over
    `most`. One row of sums joins all hosts.
    """
    hosts = rows.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    sums = hosts.agg(F.sum(n).alias("N"), F.sum(f).alias("S"), F.sum(f * f / n).alias("Q"), F.sum(n * n).alias("N2"), F.count(F.lit(1)).alias("H"))
    mean = F.least(F.greatest(F.col("S") / F.col("N"), F.lit(1e-4)), F.lit(1 - 1e-4))
    noise = mean * (1 - mean)
    # variance of rates between hosts: weighted spread less binomial noise
    spread = F.col("Q") - F.col("N") * mean * mean - (F.col("H") - 1) * noise
    between = F.greatest(spread / F.greatest(F.col("N") - F.col("N2") / F.col("N") - (F.col("H") - 1), F.lit(1.0)), F.lit(1e-9))
    prior = sums.select(mean.alias("m"), F.least(F.greatest(noise / between - 1, F.lit(1.0)), F.lit(1e6)).alias("strength"))
    rate = (f + F.col("m") * F.col("strength")) / (n + F.col("strength"))
    sd = F.sqrt(rate * (1 - rate) / (n + F.col("strength") + 1))
    return hosts.join(F.broadcast(prior)).select(host, "host_docs", "host_failed", rate.alias("host_rate"), (rate - z * sd > most).alias("host_rejected"))


def apply_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    rows = materialised(counted(docs, [key, host], text).withColumn("failed", broken()))
    hosts = host_verdicts(rows, host)
    h = hosts.select(F.col(host).alias("__host"), "host_rate", "host_rejected")
    # both sides on the host key: the engine broadcasts hosts under its threshold, splits a hot host beyond it
    out = rows.join(h, rows[host].eqNullSafe(h["__host"]), "left")
    return out.select(key, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), F.col(host).alias("host"), "host_rate")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(load(spark, sf_dir, "documents"))

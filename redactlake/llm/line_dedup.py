"""Line deduplication by winnowing over line hashes.

Lines are compared without the white space at their ends; blank ones are passed
over. Each window of RUN lines selects the line of least hash, so any RUN equal
lines in a row select the same line in both places: selected hashes seen twice name
all places that can repeat. There the matches are extended line by line in both
directions, as runs of overlapping equal windows, and every line of a run that
starts earlier (by doc_id, then position) is deleted; the first copy stays.

The stage also takes passages of fewer lines than RUN: lines in a row that together
have WORDS words and more, and texts that are shorter as a whole. Their later copies
go too. The query does not: its SQL knows runs of RUN lines alone.

Nulls, ties, empties: a null text is empty; a text with fewer than RUN lines stays in the query;
rows equal in id and text are one document here, and get one result each; a null id
comes first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import U64, load, materialised, mix, texts

RUN = 3
#: Words that make fewer lines than RUN a passage.
WORDS = 50
_BLANK = b" \t\n\r\x0b\x0c"
_STEP = np.array([1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407], dtype=U64)


def line_hashes(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for line in text.split(b"\n") if (x := line.strip(_BLANK))], dtype=U64)


def run_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of every RUN lines in a row."""
    n = len(h) - RUN + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(RUN):
        out += mix(h[j : j + n]) * _STEP[j]
    return mix(out)


def passage_hashes(h: np.ndarray, n_words: np.ndarray):
    """Hash and place of each passage of fewer lines than RUN; a place is the first line times RUN, and the number of lines."""
    keys, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for n in range(1, min(RUN - 1, len(h)) + 1):
        at = np.arange(len(h) - n + 1)
        key = sum((mix(h[at + j]) * _STEP[j] for j in range(n)), np.zeros(len(at), U64))
        long = sum(n_words[at + j] for j in range(n)) >= WORDS
        keys.append(mix(key + U64(n))[long])
        places.append(at[long] * RUN + n)
        if n == len(h):  # a whole text, whatever its words
            keys.append(mix(key + U64(RUN + n)))
            places.append(at * RUN + n)
    return np.concatenate(keys), np.concatenate(places)


def selected(h: np.ndarray) -> np.ndarray:
    """The line that each window of RUN lines selects: of least hash, of equals the last."""
    n = len(h) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    cols = np.stack([h[j : j + n] for j in range(RUN)], axis=1)[:, ::-1]
    return np.arange(n) + RUN - 1 - cols.argmin(axis=1)


def fingerprints(h: np.ndarray):
    """Hashes and positions of the lines that windows select."""
    at = np.unique(selected(h))
    return h[at].view(np.int64), at


def extended(h: np.ndarray, at: list[int]):
    """Hash and place of each window that selects one of the positions."""
    some = np.flatnonzero(np.isin(selected(h), at))
    return run_hashes(h)[some].view(np.int64), some * RUN


def _exploded(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows of f(hashes) or f(hashes, at) -> arrays, with doc_id and row in front, of lines (doc_id, row, hashes, and at if it is there)."""
    names = [x.split()[0] for x in schema.split(", ")]
    more = [c for c in ("at",) if c in df.columns]

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, x in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                cols = f(np.frombuffer(x[0], U64), *x[1:])
                ids.append(np.full(len(cols[0]), i))
                out.append(cols)
            if out:
                at = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True))], names=["doc_id", "row", *names])

    return df.select("doc_id", "row", "hashes", *more).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, row long, {schema}")


def removed_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """row, places: of each text, the lines (among those that are not blank) of runs that also start earlier; with passages, of these too.

    A place is the first line times RUN, and the number of lines (0 for RUN).
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    least = 1 if passages else RUN

    def hashes(batches):
        for b in batches:
            own = texts(b.column(2))
            keep, got, short = [], [], []
            for i in range(b.num_rows):
                raw = own[i].as_buffer().to_pybytes()
                h = line_hashes(raw)
                if len(h) < least:
                    continue
                keep.append(i)
                got.append(h.tobytes())
                if passages:
                    found = passage_hashes(h, np.array([n for line in raw.split(b"\n") if (n := len(line.split()))], np.int64))
                    short.append(found[0].tobytes() + found[1].tobytes())
                else:
                    short.append(b"")
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(got, pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "row", "hashes", "passages"])

    lines = materialised(rows.mapInArrow(hashes, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, hashes binary, passages binary"))
    prints = _exploded(lines, fingerprints, "print long, at long")
    again = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print")
    places = prints.join(again, "print", "left_semi").groupBy("row").agg(F.collect_set("at").alias("at"))
    runs = _exploded(lines.join(places, "row").dropDuplicates(["row"]), extended, "run long, place long")
    if passages:
        short = lines.select("doc_id", "row", F.col("passages").alias("hashes"))
        runs = runs.unionByName(_exploded(short, lambda x: [x[: len(x) // 2].view(np.int64), x[len(x) // 2 :].view(np.int64)], "run long, place long"))
    # one row for each hash: hot runs are combined before the shuffle
    start = F.struct("doc_id", "row", F.expr(f"place div {RUN}").alias("start"))
    first = runs.groupBy("run").agg(F.min(start).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("run", "first")
    later = runs.join(first, "run").filter(~start.eqNullSafe(F.col("first")))
    return later.groupBy("row").agg(F.collect_set("place").alias("places"))


def cut(text: bytes, places: list[int] | None):
    """What is left of text, its lines that are not blank, those removed, and the runs that they form."""
    lines = text.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.strip(_BLANK)]
    if not places:
        return text, len(full), 0, 0
    gone = sorted({i // RUN + j for i in places for j in range(i % RUN or RUN)})
    drop = {full[i] for i in gone}
    runs = 1 + sum(y != x + 1 for x, y in zip(gone, gone[1:], strict=False))
    return b"\n".join([x for i, x in enumerate(lines) if i not in drop]), len(full), len(gone), runs


def _with_places(docs: DataFrame, passages: bool = False) -> DataFrame:
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = removed_lines(docs, passages).withColumnsRenamed({"row": "__row", "places": "__places"})
    return rows.join(found.hint("shuffle_hash"), "__row", "left").drop("__row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept."""
    rows = _with_places(docs.select("doc_id", "text"))

    def run(batches):
        for b in batches:
            own, places = texts(b.column(1)), b.column(2).to_pylist()
            for lo in range(0, b.num_rows, 500):
                got = [cut(own[i].as_buffer().to_pybytes(), places[i]) for i in range(lo, min(lo + 500, b.num_rows))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(got)), *(pa.array([x[k] for x in got], pa.int64()) for k in (1, 2, 3)), pa.array([x[0] for x in got], pa.binary())], names=["doc_id", "n_lines", "n_removed", "n_runs", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_removed long, n_runs long, kept binary")


def op1_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), bare AS (
  SELECT doc_id, line, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM lines
), full_lines AS (
  SELECT doc_id, i, x, row_number() OVER w - 1 AS k, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM bare WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) > 1 AS again FROM full_lines WHERE z IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM runs, (VALUES (0), (1), (2)) AS t(d) WHERE again
), marked AS (
  SELECT b.doc_id, b.i, b.line, f.k, g.k IS NOT NULL AS removed, g.k IS NOT NULL AND h.k IS NULL AS starts
  FROM bare b LEFT JOIN full_lines f USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.k = f.k LEFT JOIN gone h ON h.doc_id = b.doc_id AND h.k = f.k - 1
)
SELECT doc_id, count(k) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (starts) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines and passages; those of which no word is left go. n_chars follows the text."""
    rows = _with_places(docs, passages=True)
    at, last = rows.columns.index("text"), len(rows.columns) - 1

    def run(batches):
        for b in batches:
            own, places = texts(b.column(at)), b.column(last).to_pylist()
            out, keep = [], []
            for i in range(b.num_rows):
                if not places[i]:
                    out.append(b.column(at)[i].as_py())
                    keep.append(True)
                else:
                    left = cut(own[i].as_buffer().to_pybytes(), places[i])[0]
                    out.append(left.decode())
                    keep.append(bool(left.strip(_BLANK)))
            cols = list(b.columns[:last])
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:last]).filter(pa.array(keep, pa.bool_()))

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

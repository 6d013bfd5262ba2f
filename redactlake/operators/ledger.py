"""An append-only ledger whose entries are chained by hashes, one chain per key.

A chain's digests need each other in turn, so a chain lives in one task; its entries
come sorted and are streamed through with the last digest carried along, so memory
does not grow with a chain. Chains run in parallel.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64
SCHEME = 3


def numbered(entries: DataFrame) -> DataFrame:
    return entries.withColumn("seq", F.row_number().over(Window.partitionBy("chain").orderBy("at", "event_id")).cast("long"))


def canonical(json: Column) -> Column:
    """JSON with the keys of every object in order and no white space; arrays keep their order. Null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def preimage(at: Column, data: Column, prev: Column, seq: Column, kind: Column) -> Column:
    """What an entry's hash is a digest of: canonical JSON, as data is."""
    return F.concat(F.lit('{"data":'), data, F.lit(',"prevHash":"'), prev, F.lit(f'","scheme":{SCHEME},"seq":'), seq.cast("string"), F.lit(',"timestamp":'), at.cast("string"), F.lit(',"type":"'), kind, F.lit('"}'))


def legacy_preimage(at: Column, data: Column, prev: Column, seq: Column, kind: Column) -> Column:
    """The same before schemes: keys as they were written."""
    return F.concat(F.lit('{"seq":'), seq.cast("string"), F.lit(',"timestamp":'), at.cast("string"), F.lit(',"type":"'), kind, F.lit('","data":'), data, F.lit(',"prevHash":"'), prev, F.lit('"}'))


def _by_chain(entries: DataFrame, *order: str) -> DataFrame:
    return entries.repartition("chain").sortWithinPartitions("chain", *order)


def chained(entries: DataFrame) -> DataFrame:
    """entries (chain, type, event_id, at, data) with seq, prev and hash. Repeated rows are entries each."""

    def run(batches):
        own, prev, seq = None, GENESIS, 0
        for b in batches:
            chains, kinds, at, data = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            seqs, prevs, hashes = [], [], []
            for c, k, t, d in zip(chains, kinds, at, data, strict=True):
                if c != own or seq == 0:
                    own, prev, seq = c, GENESIS, 0
                seq += 1
                digest = hashlib.sha256(f'{{"data":{d},"prevHash":"{prev}","scheme":{SCHEME},"seq":{seq},"timestamp":{t},"type":"{k}"}}'.encode()).hexdigest()
                seqs.append(seq)
                prevs.append(prev)
                hashes.append(digest)
                prev = digest
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.int64()), b.column(3), b.column(2), b.column(1), b.column(4), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=["chain", "seq", "at", "event_id", "type", "data", "prev", "hash"])

    rows = _by_chain(entries.select("chain", "type", "event_id", F.col("at").cast("long").alias("at"), "data"), "at", "event_id", "type", "data")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"chain {kind('chain')}, seq long, at long, event_id {kind('event_id')}, type string, data string, prev string, hash string")


def verified(ledger: DataFrame) -> DataFrame:
    """chain, n, hashes_intact, links_intact, first_bad: digests are computed anew and links compared with the entry before."""
    before = F.lag("hash").over(Window.partitionBy("chain").orderBy("seq"))
    good = F.sha2(preimage(F.col("at"), F.col("data"), F.col("prev"), F.col("seq"), F.col("type")), 256) == F.col("hash")
    rows = ledger.select("chain", "seq", good.alias("good"), (F.col("prev") == F.coalesce(before, F.lit(GENESIS))).alias("linked"))
    return rows.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.bool_and("good").alias("hashes_intact"), F.bool_and("linked").alias("links_intact"), F.min(F.when(~(F.col("good") & F.col("linked")), F.col("seq"))).alias("first_bad"))


class _Tree:
    """Merkle root of a stream of hashes: one waiting node a level."""

    def __init__(self):
        self.waiting: list[str | None] = []
        self.n = 0

    def add(self, node: str) -> None:
        self.n += 1
        self._push(0, node)

    def _push(self, level: int, node: str) -> None:
        while True:
            if level == len(self.waiting):
                self.waiting.append(None)
            left = self.waiting[level]
            if left is None:
                self.waiting[level] = node
                return
            self.waiting[level] = None
            node, level = hashlib.sha256((left + node).encode()).hexdigest(), level + 1

    def root(self) -> str:
        count, level = self.n, 0
        while count > 1:
            node = self.waiting[level]
            if node is not None:  # an odd one is paired with itself
                self.waiting[level] = None
                self._push(level + 1, hashlib.sha256((node + node).encode()).hexdigest())
            count, level = (count + 1) // 2, level + 1
        return self.waiting[level]


def merkle(ledger: DataFrame) -> DataFrame:
    """chain, root: SHA-256 of pairs of hashes, an odd one with itself, up to one."""

    def run(batches):
        own, tree, ended = None, None, object()
        for b in batches:
            chains, roots = [], []
            for c, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if tree is None or c != own:
                    if tree is not None:
                        chains.append(own)
                        roots.append(tree.root())
                    own, tree = c, _Tree()
                tree.add(h)
            yield pa.RecordBatch.from_arrays([pa.array(chains, b.column(0).type), pa.array(roots, pa.string())], names=["chain", "root"])
            ended = b.column(0).type
        if tree is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], ended), pa.array([tree.root()], pa.string())], names=["chain", "root"])

    rows = _by_chain(ledger.select("chain", "hash", "seq"), "seq")
    return rows.mapInArrow(run, f"chain {rows.schema['chain'].dataType.simpleString()}, root string")


def proofs(ledger: DataFrame, most: int = 500) -> DataFrame:
    """A row for each chain: entries kept, the root over them, the verdict over them, which part is kept, and the kept entries as JSON (at most `most`)."""
    kept = ledger.withColumn("back", F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("seq")))).filter(F.col("back") <= most)
    good = F.sha2(preimage(F.col("at"), F.col("data"), F.col("prev"), F.col("seq"), F.col("type")), 256) == F.col("hash")
    before = F.lag("hash").over(Window.partitionBy("chain").orderBy("seq"))
    # the first one kept has nothing kept before it to be held against
    rows = kept.withColumn("ok", good).withColumn("linked", F.coalesce(F.col("prev") == before, F.lit(True)))
    entry = F.to_json(F.struct("seq", F.col("at").alias("timestamp"), "type", "hash"))
    out = rows.groupBy("chain").agg(
        F.count(F.lit(1)).alias("total"), F.bool_and(F.col("ok") & F.col("linked")).alias("chain_valid"), F.bool_and("ok").alias("hashes_intact"), (F.min("seq") > 1).alias("trimmed"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"),
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"]), ","), F.lit("]")).alias("entries"))
    return out.join(merkle(kept), "chain")

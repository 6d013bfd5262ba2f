"""Similarity join on sets of word shingles, with several global token orders.

If two sets are similar, each order of all tokens puts a common token into the
prefixes of both; a prefix longer by so many tokens holds so many more. Texts with
equal sets are one class. Order A (by hash) drops the classes whose prefix, about
half a set, has too few tokens that any other class has there. Order B (rarest
first, by the counts among those left) gives the candidate pairs: an entry of its
prefix knows how large a similar set can be if the two meet there first, so a set
with many tokens of its own meets small sets only, or none. Of each candidate pair
the filters of all orders are intersected before a text moves: its prefixes under A
and under C (by a second hash) must meet too, and its parity sketches (SKETCH longs
of a set) may differ in no more bits than the tokens that only one of two similar
sets can have. Orders know tokens by 32 bits: a chance agreement makes a candidate,
not a link.

Candidates of a token are first compared with one class that has it (a star), with
another one in each round, which joins groups of near copies without listing their
pairs; then all pairs that are left between classes of different components are
compared, so no link between components is lost. Tokens of many classes are met in blocks.

Nulls, ties, empties: a null text is empty; texts without words link with nothing;
equal sets are linked; repeated rows are linked with each other; ties are broken by
the class hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import U64, chunks, having, load, materialised, mix, partitions_for, shingle_sets
from ._blobs import ragged
from ._graph import components

WORDS = 5
#: Links have num * union <= den * intersection.
NUM, DEN = 75, 100
PAIRS_OF_A_TASK = 2000
#: Star rounds before the rest is compared in full.
ROUNDS = 3
#: Entries of a token that one task meets with all the others.
ENTRIES_OF_A_BLOCK = 512
#: Longs of a set's parity sketch.
SKETCH = 8
CHUNK = 4 << 20
_HEAD = np.dtype([("class", "i8"), ("n", "u4"), ("count", "u4")])


def prefix(n):
    """Tokens of a set of n that every similar set must meet one of."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def wanted(n):
    """The longer prefix has prefix(n) - 1 + wanted(n) tokens: similar sets of n and more have so many in common there."""
    return (n + 3) // 4


def class_keys(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    cs = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sh ^ U64(0xA24BAED4963EE407)))])
    n = np.diff(bounds).astype(U64)
    key = mix(cs[bounds[1:]] - cs[bounds[:-1]] + mix(n))
    return np.where(n > 0, key, U64(0)).view(np.int64)


def _members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n_shingles, class of every document."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in chunks(b.column(2)):
                sh, bounds = shingle_sets(buf, offs, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), pa.array(class_keys(sh, bounds))], names=["doc_id", "row", "n_shingles", "class"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, n_shingles long, class long")


def _deal_tokens(rows: DataFrame, k: int, buckets: int, whole: bool) -> DataFrame:
    """Blobs of the longer A prefix, or of the whole set, of each text: classes, their sizes, tokens of each here, tokens."""

    def run(batches):
        for b in batches:
            for _, _, buf, offs in chunks(b.column(0), CHUNK):
                sh, bounds = shingle_sets(buf, offs, k)
                key, n = class_keys(sh, bounds), np.diff(bounds)
                _, one = np.unique(key, return_index=True)  # copies within the chunk count once
                one = one[n[one] > 0]
                take = n[one] if whole else prefix(n[one]) - 1 + wanted(n[one])
                tok = sh[ragged(bounds[:-1][one], take)]
                of = np.repeat(np.arange(len(one)), take)
                where = ((tok >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.lexsort((of, where))
                tok, of, where = tok[order].astype(np.uint32), of[order], where[order]
                cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
                blobs = []
                for a, z in zip(cut, [*cut[1:], len(where)], strict=True):
                    first = np.flatnonzero(np.append(True, of[a + 1 : z] != of[a : z - 1]))
                    head = np.empty(len(first), _HEAD)
                    d = of[a:z][first]
                    head["class"], head["n"], head["count"] = key[one][d], n[one][d], np.diff(np.append(first, z - a))
                    blobs.append(np.uint32(len(head)).tobytes() + head.tobytes() + tok[a:z].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(where[cut].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return rows.select("text").mapInArrow(run, "bucket int, blob binary").repartitionById(buckets, F.col("bucket"))


def _shared(batches):
    """Distinct (token, class, size) of a task whose token is in two classes or more, and the token's number of classes."""
    heads, tokens, tasks = [], [], []
    for b in batches:
        for where, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = blob.as_buffer().to_pybytes()
            m = int(np.frombuffer(raw, np.uint32, 1)[0])
            heads.append(np.frombuffer(raw, _HEAD, m, 4))
            tokens.append(np.frombuffer(raw, np.uint32, -1, 4 + m * _HEAD.itemsize))
            tasks.append(where)
    if not heads:
        return None
    # a token's full name here is its bucket and 32 bits
    h = np.concatenate([t.astype(U64) | (U64(w) << U64(32)) for t, w in zip(tokens, tasks, strict=True)])
    head = np.concatenate(heads)
    times = head["count"].astype(np.int64)
    key, n = np.repeat(head["class"], times), np.repeat(head["n"], times)
    order = np.lexsort((key, h))
    h, key, n = h[order], key[order], n[order]
    new = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))
    h, key, n = h[new], key[new], n[new]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    times = np.diff(np.append(at, len(h)))
    df = np.repeat(times, times)
    keep = df > 1
    return h[keep], key[keep], n[keep], df[keep]


def _by_class(key: np.ndarray, n: np.ndarray, columns: list[np.ndarray], buckets: int):
    """Blobs of entries (rising by class) for the task of each class: classes, sizes and counts, then the columns."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    head = np.empty(len(first), _HEAD)
    head["class"], head["n"], head["count"] = key[first], n[first], count
    where = (mix(key[first].view(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(where[order]) != 0))
    blobs = []
    for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
        some = order[a:z]
        at = ragged(first[some], count[some])
        blobs.append(np.uint32(len(some)).tobytes() + head[some].tobytes() + b"".join(c[at].tobytes() for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(where[order][cut].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _of_classes(batches, dtypes: list[str]):
    """class, size and columns of all entries of a task, rising by class; None without any."""
    parts = []
    for b in batches:
        for blob in b.column(1):
            raw = blob.as_buffer().to_pybytes()
            m = int(np.frombuffer(raw, np.uint32, 1)[0])
            head = np.frombuffer(raw, _HEAD, m, 4)
            at, total, cols = 4 + m * _HEAD.itemsize, int(head["count"].sum()), []
            for t in dtypes:
                cols.append(np.frombuffer(raw, t, total, at))
                at += cols[-1].nbytes
            parts.append((np.repeat(head["class"], head["count"]), np.repeat(head["n"], head["count"]), *cols))
    if not parts:
        return None
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def _deal_counts(buckets: int):
    def run(batches):
        got = _shared(batches)
        if got is not None and len(got[0]):
            key, first, count = np.unique(got[1], return_index=True, return_counts=True)
            yield _by_class(key, got[2][first], [count.astype(np.uint32)], buckets)

    return run


def _alive(batches):
    """Classes whose longer prefix shares enough."""
    got = _of_classes(batches, ["u4"])
    if got is None:
        return
    key, n, count = got
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = n[first].astype(np.int64)
    # the smallest similar set has the shortest prefix: what is common to both is counted by it
    enough = np.add.reduceat(count.astype(np.int64), first) >= wanted((NUM * size + DEN - 1) // DEN)
    yield pa.RecordBatch.from_arrays([pa.array(key[first][enough])], names=["class"])


def _deal_classes(buckets: int):
    def run(batches):
        got = _shared(batches)
        if got is not None and len(got[0]):
            h, key, n, df = got
            order = np.argsort(key, kind="stable")
            yield _by_class(key[order], n[order], [h[order], np.minimum(df[order], 0xFFFFFFFF).astype(np.uint32)], buckets)

    return run


def _rare_prefix(batches):
    """The B prefix of each class, less the tokens that it shares with no other: those come first in the order.

    most: the largest similar set whose first common token is this one, as nothing before it is common.
    alone: tokens in 1000 that no other has; a text that others were made from has few.
    """
    got = _of_classes(batches, ["u8", "u4"])
    if got is None:
        return
    key, n, tok, df = got
    order = np.lexsort((tok, df, key))
    key, n, tok = key[order], n[order].astype(np.int64), tok[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    alone = n[first] - count
    left = np.clip(prefix(n[first]) - alone, 0, count)
    at, share = ragged(first, left), np.repeat(1000 * alone // n[first], count)
    most = (n[at] - ragged(alone, left)) * (NUM + DEN) // NUM - n[at]
    for a in range(0, len(at), 1 << 20):
        some = at[a : a + (1 << 20)]
        yield pa.RecordBatch.from_arrays([pa.array(tok[some].view(np.int64)), pa.array(key[some]), pa.array(n[some]), pa.array(most[a : a + (1 << 20)]), pa.array(share[some])], names=["token", "class", "n", "most", "alone"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The intersection is large enough. x and y are sorted."""
    a, b = len(x), len(y)
    if min(a, b) * DEN < max(a, b) * NUM:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (a + b - both)


def parities(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SKETCH longs for each set: every token flips one bit."""
    rows, at = len(bounds) - 1, mix(sh ^ U64(0x9FB21C651E98DF25)) % U64(64 * SKETCH)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    odd = np.bincount(of * (64 * SKETCH) + at.astype(np.int64), minlength=rows * 64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(rows, SKETCH)


_SIGNS = [f"s{j}" for j in range(SKETCH)]


def _signatures(kept: DataFrame, k: int) -> DataFrame:
    """class, n, its prefixes under A and C and its sketch s0, s1, ..."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in chunks(b.column(1)):
                sh, bounds = shingle_sets(buf, offs, k)
                n, own, c = np.diff(bounds), parities(sh, bounds), mix(sh)
                at = ragged(bounds[:-1], prefix(n))
                order = np.lexsort((c, np.repeat(np.arange(len(n)), n)))
                ends = pa.array(np.append(0, np.cumsum(prefix(n))).astype(np.int32))
                both = [pa.ListArray.from_arrays(ends, pa.array((x[at] >> U64(32)).astype(np.uint32).view(np.int32))) for x in (sh, c[order])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *both, *(pa.array(own[:, j]) for j in range(SKETCH))], names=["class", "n", "pa", "pc", *_SIGNS])

    return kept.select("class", "text").mapInArrow(run, "class long, n long, pa array<int>, pc array<int>, " + ", ".join(f"{c} long" for c in _SIGNS))


def _close(an, bn, signs) -> Column:
    """Sketches differ in few enough bits: similar sets have NUM (an + bn) / (NUM + DEN) tokens in common and more."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in signs), F.lit(0))
    return apart * (NUM + DEN) <= (an + bn) * (DEN - NUM)


def _verify(k: int):
    def run(batches):
        mid, own = None, None
        for b in batches:
            a, z = [], []
            centre, other = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, _, buf, offs in chunks(b.column(4)):
                sh, bounds = shingle_sets(buf, offs, k)
                for i in range(len(offs) - 1):
                    s = sh[bounds[i] : bounds[i + 1]]
                    c, x = centre[lo + i], other[lo + i]
                    if c == x:
                        mid, own = c, s
                    elif c == mid and similar(own, s):
                        a.append(c)
                        z.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return run


def _dealt(pairs: DataFrame):
    """Pairs with the salt of their task, of which each a has enough for its pairs; and a, salt of all tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_OF_A_TASK).cast("int").alias("tasks"))
    left = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"), "b")
    return left, many.select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))


def passing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that pass the filters of all orders, stored."""
    left, tasks = _dealt(pairs)
    side = lambda s: signs.toDF(s, *(f"{s}_{c}" for c in signs.columns[1:]))
    met = left.join(side("b"), "b").join(tasks.join(side("a"), "a"), ["a", "salt"])
    meet = F.arrays_overlap("a_pa", "b_pa") & F.arrays_overlap("a_pc", "b_pc")
    return materialised(met.filter(_close(F.col("a_n"), F.col("b_n"), [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in _SIGNS]) & meet).select("a", "b"))


def verified(pairs: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """Those of pairs (a, b) that are similar, stored. Texts of b come to their a, in tasks of a bounded number of pairs."""
    own = having(kept, materialised(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "class")
    left, tasks = _dealt(pairs)
    left = left.join(own.withColumnRenamed("class", "b"), "b").select("a", "salt", "b", F.lit(1).alias("nth"), "text")
    mids = tasks.join(own.withColumnRenamed("class", "a"), "a").select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("nth"), "text")
    n = partitions_for(kept, 32)
    met = left.unionByName(mids).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "nth")
    return materialised(met.mapInArrow(_verify(k), "a long, b long"))


def _fit(x: str, y: str) -> Column:
    """Two entries of a token may be the first one that similar sets of their sizes have in common."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (n <= F.col(f"{y}most")) & (m <= F.col(f"{x}most")) & (F.least(n, m) * DEN >= F.greatest(n, m) * NUM)


def _candidates(docs: DataFrame, members: DataFrame, k: int):
    """Texts of the classes that A leaves, and the entries of their B prefixes that others can meet (token, class, n, most, alone)."""
    buckets = partitions_for(docs, 32)
    blobs = "bucket int, blob binary"
    dealt = _deal_tokens(docs, k, buckets, False).mapInArrow(_deal_counts(buckets), blobs)
    alive = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_alive, "class long")
    classes = members.filter("n_shingles > 0").groupBy("class").agg(F.min("row").alias("row"))
    reps = materialised(classes.join(alive, "class"))
    rows = having(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text"), materialised(reps.select("row").distinct()), "row")
    kept = materialised(rows.join(reps.hint("shuffle_hash"), "row").select("class", "text").dropDuplicates(["class"]))

    buckets = partitions_for(kept, 16)
    dealt = _deal_tokens(kept, k, buckets, True).mapInArrow(_deal_classes(buckets), blobs)
    cand = materialised(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_rare_prefix, "token long, class long, n long, most long, alone long"))
    sizes = cand.groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    cand = materialised(cand.join(sizes, "token").filter((F.col("most") >= F.col("lo")) & (F.col("hi") * DEN >= F.col("n") * NUM)).drop("lo", "hi"))
    return materialised(having(kept, materialised(cand.select("class").distinct()), "class")), cand


def join_classes(docs: DataFrame, k: int = WORDS):
    """Members (doc_id, row, n_shingles, class) and components (node, root) of the classes."""
    members = materialised(_members(docs, k))
    kept, cand = _candidates(docs, members, k)
    signs = materialised(_signatures(kept, k))
    comps, links, tried = None, None, None
    for r in range(ROUNDS):
        placed = _placed(cand, comps)
        # a star round each token: one class in it, first the least changed, then others, is compared with the rest; a class takes one
        nth = F.col("alone") if r == 0 else F.lit(0).cast("long")
        mid = placed.groupBy("token").agg(F.min(F.struct(nth.alias("nth"), F.xxhash64("class", F.lit(r)).alias("h"), "class", "n", "most", "root")).alias("c"))
        near = placed.join(mid, "token").filter((F.col("root") != F.col("c.root")) & _fit("", "c."))
        pairs = materialised(near.groupBy(F.col("class").alias("b")).agg(F.min("c").alias("c")).select(F.col("c.class").alias("a"), "b"))
        tried = pairs if tried is None else tried.union(pairs)
        if pairs.isEmpty():  # of this round's centres; other classes of a token may still link
            break
        found = verified(passing(pairs, signs), kept, k)
        if r and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        comps = components(links)

    rest = passing(_apart(_placed(cand, comps), signs, tried), signs)
    if rest.isEmpty():
        return members, comps
    found = verified(rest, kept, k)
    return members, components(found if links is None else links.union(found))


def _apart(placed: DataFrame, signs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of entries in different components whose sizes and sketches allow a link, stored: a has more pairs than b, so few pairs meet at one b."""
    mixed = placed.groupBy("token").agg((F.min("root") != F.max("root")).alias("mixed"), F.ceil(F.count(F.lit(1)) / ENTRIES_OF_A_BLOCK).cast("int").alias("blocks")).filter("mixed").drop("mixed")
    rows = placed.join(mixed, "token").join(signs.select("class", *_SIGNS), "class")
    rows = materialised(rows.select("token", "blocks", "class", "n", "most", "root", *_SIGNS))
    own = [c for c in rows.columns if c not in ("token", "blocks")]
    x = rows.select("token", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block"), *(F.col(c).alias(f"a_{c}") for c in own))
    y = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"b_{c}") for c in own))
    far = (F.col("a_class") < F.col("b_class")) & (F.col("a_root") != F.col("b_root")) & _fit("a_", "b_")
    met = x.join(y, ["token", "block"]).filter(far & _close(F.col("a_n"), F.col("b_n"), [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in _SIGNS]))
    pairs = met.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    pairs = materialised(pairs.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"))
    times = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("times"))
    both = pairs.join(times.toDF("a", "at"), "a").join(times.toDF("b", "bt"), "b")
    more = F.col("at") >= F.col("bt")
    return both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"))


def _placed(cand: DataFrame, comps: DataFrame | None) -> DataFrame:
    """token, class, n, most, alone, root so far."""
    if comps is None:
        return cand.withColumn("root", F.col("class"))
    return cand.join(comps, cand["class"] == comps["node"], "left").select("token", "class", "n", "most", "alone", F.coalesce("root", "class").alias("root"))


def _rooted(docs: DataFrame, k: int):
    """Members (doc_id, row, n_shingles, class) and the root of each class that has words (class, least doc_id, root)."""
    members, comps = join_classes(docs, k)
    if comps is None:
        comps = members.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0)
    least = members.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    return members, least.join(comps, least["class"] == comps["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, row, n_shingles, component_id."""
    members, rooted = _rooted(docs, k)
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").select("class", "component_id")
    out = members.join(of_class, "class", "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, unchanged: of the smallest doc_id, of equals the least row hash (a null id is last); texts without words stay."""
    members, rooted = _rooted(docs, WORDS)
    worded = members.filter("n_shingles > 0").join(rooted.select("class", "root"), "class")
    copies = worded.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("c"))
    first = materialised(first.select(F.col("c.row").alias("__row"), F.col("c.n").alias("n")))
    empty = members.filter("n_shingles = 0").select(F.col("row").alias("__row"))
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    out = having(rows, materialised(first.filter("n = 1").select("__row").union(empty).distinct()), "__row")
    # only rows that repeat are grouped, in part before they are shuffled
    again = having(rows, materialised(first.filter("n > 1").select("__row")), "__row")
    one = again.groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return out.drop("__row").unionByName(one)

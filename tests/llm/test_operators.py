"""Training-data operators against brute force on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from redactlake.llm import decontamination as DC
from redactlake.llm import line_dedup as LD
from redactlake.llm import ngram_join as NJ
from redactlake.llm import packing as PK
from redactlake.llm import quality_classifier as QC
from redactlake.llm import quality_rules as QR
from redactlake.llm import sharding as SH
from redactlake.llm import suffix_dedup as SD
from redactlake.llm import toxicity as TX
from redactlake.llm import warc as WA
from redactlake.llm._batch import load, mix

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string"
rng = random.Random(3)


def words(n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empties, ties, copies, near copies, a long text, accents, control characters."""
    base, passage = words(60), words(70)
    near = base.split()
    near[5] = "changed"
    texts = [
        None, "", " ", "\n\n", "one", "One", "a b c d", base, base, base.upper(), " ".join(near), " ".join(near[:50]), passage, words(20) + " " + passage + " " + words(20),
        passage + "\n" + words(9), "l1 a\nl2 b\nl3 c\nl4 d", "x y\nl1 a\nl2 b\nl3 c\nl5 e", "l2 b\nl3 c", words(9000), "é" * 300, "é" * 300, "a" * 450, "tab\tand\x0bvt \x85 nel", "<|endoftext|> x", "it's “quoted” — é",
    ]
    rows = [(i, t, "en", "h" if i % 3 else None, None if t is None else len(t), 1, "s") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, words(30), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(spark, docs, empty, awkward):
    rows = SH.assign(docs).collect()
    assert len(rows) == len(awkward) and SH.assign(empty).count() == 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in awkward)
    assert collections.Counter((r["size"], r.text_crc32) for r in rows) == sizes
    keys = np.arange(50_000)
    a, b = SH.jump_hash(keys, 24), SH.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.01 and np.bincount(a).min() > 1900


def test_jump_hash_is_the_published_loop():
    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, 1]
    for n in (1, 2, 24, 25, 1000):
        mixed = mix(np.array(keys).astype(np.int64).view(np.uint64) + SH._GOLDEN)
        assert SH.jump_hash(np.array(keys), n).tolist() == [one(int(k), n) for k in mixed]


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, docs, empty, awkward):
    got = {r.doc_id: r for r in QR.apply_rules(docs).collect()}
    for i, t, *_ in awkward:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert QR.apply_rules(empty).count() == 0


def test_a_bad_host_goes_and_a_small_one_does_not(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select((F.col("id") % 4).cast("string").alias("host"), ((F.col("id") % 4 == 0) & (F.col("id") % 40 != 0)).alias("failed")).union(spark.range(2).select(F.lit("tiny"), F.lit(True)))
    got = {r.host: r.host_rejected for r in QR.host_verdicts(rows, "host").collect()}
    assert got == {"0": True, "1": False, "2": False, "3": False, "tiny": False}


def test_packing(spark, docs, empty, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = PK.pack(PK.pieces(docs)).collect()
    want = collections.Counter()
    for i, t, *_ in awkward:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[i, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 4096
    assert PK.pack(PK.pieces(empty)).count() == 0


def test_the_fullest_closes_first():
    # two may be open: the third piece makes three, and the sequence with 900 closes, so the last piece of 100 goes elsewhere
    assert PK.best_fit([900, 500, 600, 100], 1000, 2) == [(0, 0), (1, 0), (2, 0), (2, 600)]
    assert PK.best_fit([900, 500, 600, 100], 1000, 3) == [(0, 0), (1, 0), (2, 0), (0, 900)]


def test_best_fit_is_tight_with_few_open():
    lengths = [rng.randrange(1, 2000) for _ in range(4000)]
    for some, most_open, waste in ((lengths, PK.OPEN, 1.02), (lengths, 64, 1.05)):
        placed = PK.best_fit(some, 4096, most_open)
        assert max(s for s, _ in placed) + 1 <= waste * sum(lengths) / 4096 + 1


def test_suffixes(spark, docs, empty, awkward):
    from pyspark.sql import functions as F

    texts = [(i, (t or "").encode()) for i, t, *_ in awkward]
    count = collections.Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in texts:
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mark[k] += 1
                mark[k + 200] -= 1
        c = np.cumsum(mark[:-1]) > 0
        want[i, len(b), int(c.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()] += 1
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    rows = SD.deduplicated(docs).select("doc_id", "n_bytes", gone.alias("n"), F.sha2("kept", 256).alias("h")).collect()
    assert collections.Counter(tuple(r) for r in rows) == want
    assert SD.deduplicated(empty).count() == 0


def test_levels_grow_with_the_logarithm():
    family = SD.Family()
    for _ in range(200):
        e = np.zeros(50, SD._ENTRY)
        e["q"] = np.sort(np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 63, 50).astype(np.uint64))
        assert not len(family.scan(e))
    assert len(family.levels) <= 15 and sum(map(len, family.levels)) == 10_000


def test_a_hot_gram_costs_no_pairs():
    """The same flags as by comparing all pairs, and a passage that very many texts share in a time that follows their number."""
    import time

    def entries(grams, seed):
        r = np.random.default_rng(seed)
        e = np.zeros(len(grams), SD._ENTRY)
        e["q"] = (np.array(grams, np.uint64) << np.uint64(32)) | r.integers(0, 4, len(grams)).astype(np.uint64)
        e["row"] = r.integers(0, 1 << 40, len(grams))
        e = e[np.lexsort((e["s"], e["q"]))]
        return e[np.append(True, e["q"][1:] != e["q"][:-1])]

    for seed in range(30):
        family, seen = SD.Family(), []
        for k in range(4):
            grams = np.random.default_rng(100 * seed + k).integers(0, 12, 20)
            batch = entries(grams, 100 * seed + k)
            seen += [int(x) for x in batch["q"]]
            family.scan(batch)
        for level in family.levels:
            for x in level:
                q = int(x["q"])
                assert bool(x["dup"]) == (seen.count(q) > 1) and bool(x["multi"]) == any(y >> 32 == q >> 32 and y != q for y in seen)
    took = []
    for n in (5_000, 20_000):
        family, began = SD.Family(), time.time()
        for k in range(4):
            e = np.zeros(n, SD._ENTRY)
            e["q"], e["row"] = (np.uint64(7) << np.uint64(32)) | np.arange(k, 4 * n, 4, dtype=np.uint64), np.arange(n)
            family.scan(e)
        took.append(time.time() - began)
    assert took[1] < 2


def brute_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(sets[k]), min(least[find(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(texts)]


def test_near_duplicates(spark, docs, empty, awkward):
    got = NJ.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_components([(i, t) for i, t, *_ in awkward]))
    assert NJ.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Many near copies of one text, in chains, beside texts that share a passage only."""
    base, passage, rows = words(80, 10**6).split(), words(20, 10**6), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, passage + " " + words(60, 10**6)) for i in range(60)]
    got = NJ.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_near_duplicates_beside_a_text_that_holds_them(spark):
    """A text of another size is every token's centre in the first star round, so that round compares nothing."""
    from pyspark.sql import functions as F

    def fresh(n):
        return " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))

    draws, classes = [], []
    for d in range(60):
        draw = random.Random(d)
        p, q = fresh(96), fresh(92)
        draws.append([p + " " + fresh(8), p + " " + fresh(8), q + " " + fresh(8), q + " " + fresh(8), p + " " + q])
        for i, t in enumerate(draws[-1]):
            raw = t.encode()
            sh, bounds = NJ.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NJ.WORDS)
            classes.append((d, i, int(NJ.class_keys(sh, bounds)[0])))
    order = spark.createDataFrame(classes, "d int, i int, class long").select("d", F.struct(F.xxhash64("class", F.lit(0)), "i").alias("h")).groupBy("d").agg(F.min("h").alias("first"))
    hidden = [r.d for r in order.filter("first.i = 4").orderBy("d").collect()]
    assert len(hidden) > 4
    for d in hidden[:4]:
        rows = list(enumerate(draws[d]))
        got = NJ.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(rows)), d
        assert [r.component_id for r in sorted(got)] == [0, 0, 2, 2, 4]


def test_the_stage_keeps_one_row_of_each_component(spark):
    base, other = words(60, 10**6), words(60, 10**6)
    near = base.split()
    near[5] = "changed"
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (1, " ".join(near), "c"), (2, base, "d"), (2, other, "e"), (None, other, "f"), (3, "", "g"), (3, "", "g"), (4, None, "h"), (None, "x y z", "i"), (None, "x y z", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in NJ.stage_near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 6 and collections.Counter(got) - collections.Counter(rows) == collections.Counter()
    assert sum(i == 1 for i, *_ in got) == 1 and {g for *_, g in got if g in "efghi"} == {"e", "g", "h", "i"}


def test_lines(spark, docs, empty):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, bytes(r.kept)) for r in LD.deduplicated(docs).collect()}
    assert got[15] == (4, 0, 0, b"l1 a\nl2 b\nl3 c\nl4 d") and got[16] == (5, 3, 1, b"x y\nl5 e") and got[17] == (2, 0, 0, b"l2 b\nl3 c")
    assert got[0] == (0, 0, 0, b"") and LD.deduplicated(empty).count() == 0


def test_the_stage_cuts_long_passages_of_few_lines(spark):
    one, x, y, less = words(60, 10**6), words(30, 10**6), words(30, 10**6), words(30, 10**6)
    rows = [
        (1, one), (2, f"intro\n {one}\nend"), (3, f"{x}\n\n{y}"), (4, f"a\n{x}\n{y}\nb"), (5, "short tale"), (6, "short tale "), (7, f"short tale\n{one}"),
        (8, less), (9, f"q\n{less}\nr"), (10, f"{one}\n{one}"), (11, None), (12, ""), (13, f"{y}\n{x}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in LD.stage_lines(spark, docs, SF).collect()}
    kept = {i: t for i, t in rows if i not in (2, 4, 6, 7, 10)} | {2: "intro\nend", 4: "a\nb", 7: "short tale"}
    assert got == kept
    assert all(r.n_removed == 0 for r in LD.deduplicated(docs).collect())


def test_archives(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    html = [None, "", "<p>a</p>", "<p>a</p>", "pre " + fake + fake + " post", fake, "é" * 5000, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"]
    rows = [(i, f"http://h/{i}", h, 1) for i, h in enumerate(html)] + [(50 + i, None, words(300), 1) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    WA.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in WA.read_archives(spark, str(tmp_path / "w")).collect()}
    assert sorted(got) == [r[0] for r in rows]
    import base64

    for i, _, h, _ in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert (got[0].record_type, got[0].refers_to, got[2].refers_to, got[3].record_type, got[4].record_type) == ("revisit", 1, 3, "response", "response")


def test_chains_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(WA, "BLOCK", 700)
    rows = [(i, "u", words(rng.randrange(200)) + "WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n") for i in range(60)]
    WA.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    raw = __import__("gzip").open(next((tmp_path / "w").glob("part-*"))).read()
    found = WA.candidates(raw, 0, len(raw))
    assert len(found) > 60
    assert WA.read_archives(spark, str(tmp_path / "w")).count() == 60


def test_archives_as_a_query(spark):
    assert WA.op7_chained_warc(spark, SF).count() == load(spark, SF, "pages").count()


def test_archives_of_long_urls(spark, tmp_path):
    rows = [(i, "data:text/plain," + "a:b" * 40_000 if i == 3 else f"http://h/{i}", f"<p>{i}</p>") for i in range(9)]
    WA.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    got = {r.page_id: r.payload_digest for r in WA.read_archives(spark, str(tmp_path / "w")).collect()}
    import base64

    assert got == {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, _, h in rows}


def test_archives_of_a_gzip_member_for_each_record(spark, tmp_path):
    import gzip

    rows = [(i, "u", f"<p>{i}</p>" * (i + 1)) for i in range(9)]
    WA.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    raw = gzip.open(next((tmp_path / "w").glob("part-*"))).read()
    cuts = [*(m.start() for m in re.finditer(rb"WARC/1\.1", raw)), len(raw)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0.gz").write_bytes(b"".join(gzip.compress(raw[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)))
    read = lambda p: sorted(map(tuple, WA.read_archives(spark, str(tmp_path / p)).collect()))
    assert read("m") == read("w") and len(read("m")) == 9
    with pytest.raises(ValueError):
        WA.plain(gzip.compress(raw)[:-20])


def test_archives_of_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, revisits int"
    WA.write_archives(spark.createDataFrame([], schema), str(tmp_path / "e"))
    assert WA.read_archives(spark, str(tmp_path / "e")).count() == 0
    rows = [(1, "u", "a", 1), (1, "u", "a", 1), (None, "u", "a", 1), (2, None, "a", 1), (2, None, "a", 1)]
    WA.write_archives(spark.createDataFrame(rows, schema), str(tmp_path / "r"))
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in WA.read_archives(spark, str(tmp_path / "r")).collect())
    assert got == {(1, "revisit", 2): 2, (None, "revisit", 2): 1, (2, "response", None): 2}


@pytest.mark.parametrize("damaged", [0, 4])
def test_a_broken_chain_is_an_error(spark, tmp_path, damaged):
    import gzip

    rows = [(i, "u", f"<p>{i}</p>") for i in range(9)]
    WA.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    raw = gzip.open(next((tmp_path / "w").glob("part-*"))).read()
    places = [m.start() for m in re.finditer(rb"WARC/1\.1", raw)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0.gz").write_bytes(gzip.compress(raw[: places[damaged]] + b"XARC" + raw[places[damaged] + 4 :]))
    with pytest.raises(ValueError, match="does not reach its end"):
        WA.read_archives(spark, str(tmp_path / "d"))


def test_toxicity_learns_from_documents_which_sentences_offend(spark):
    rows = [(i, ". ".join([words(8), words(8) + (" vile" if i % 4 == 0 else ""), words(8)])) for i in range(800)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in TX.score(docs, TX.train(docs, labels)).collect()}
    assert sum((got[i].score >= 0.7) == (i % 4 == 0) for i in range(800)) > 780
    assert got[9000].score == 0 and got[9001].worst_start is None
    assert " vile" in rows[0][1][got[0].worst_start :].split(".")[0]
    assert {r.score for r in TX.score(docs.limit(5), TX.train(docs, labels.limit(0))).collect()} == {0.0}


def test_noisy_or_against_plain_loops():
    """Scores of documents from the scores of their sentences, by the definition."""
    texts = ["vile words here. fine words. VILE!", "fine", "", "É vile\nvile vile"]
    w = np.zeros(TX.DIMS, np.float32)
    for t in ("vile",):
        place = TX.sentences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
        w[place] = 2.0
    raw = [t.encode() for t in texts]
    p, s, first, doc = TX.sentences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), w != 0)
    z = np.bincount(s, weights=w[p], minlength=len(first)) - 3
    for d, t in enumerate(texts):
        clean = 1.0
        for part in re.split(r"[.!?\n]", t):
            if re.search(r"\w", part):
                # a feature counts once a sentence: the word and its beginning of three letters
                clean *= 1 - 1 / (1 + np.exp(-(4.0 * bool(re.search("(?i)vile", part)) - 3)))
        assert abs(-np.expm1(-np.logaddexp(0, z[doc == d]).sum()) - (1 - clean)) < 1e-9


def test_toxicity_of_odd_tables(spark, empty):
    from pyspark.sql import functions as F

    rows = [(i, f"{words(5)}. {'vile' if i % 4 == 0 else 'fine'} {words(3)}. {words(4)}", i, "s", 1) for i in range(300)]
    rows += [rows[0], (900, "vile. vile. vile", 1, "s", 1), (901, "word " * 40_000, 1, "s", 1), (None, "vile", 1, "s", 1), (902, None, 1, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, places string, toxic int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = TX.train(docs, labels)
    got = TX.score(docs, model).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 0 for r in got) == 2 and len({r.score for r in got if r.doc_id == 0}) == 1
    assert next(r for r in got if r.doc_id == 900).worst_start == 0  # of equal sentences the first
    assert TX.score(empty, model).count() == 0
    assert TX.train(empty, labels) is None and TX.train(docs, labels.filter(F.col("toxic") == 1)) is None


def test_quality_of_odd_tables(spark, docs, empty, awkward):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(awkward))] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = QC.classify(spark, docs, labels).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert QC.classify(spark, empty, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in QC.classify(spark, docs, labels.filter("quality = 1")).collect())
    assert all(0 <= r.score <= 1 for r in QC.classify(spark, docs, labels.limit(0)).collect())


def test_quality_on_held_out_rows(spark):
    got = QC.classify(spark, load(spark, SF, "documents"), load(spark, SF, "labels")).join(load(spark, SF, "labels"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85
    assert list(QC.pool(np.array([1.0, 0.0, 2.0]), np.ones(3))) == [0.5, 0.5, 2.0]


def test_decontamination_recall(spark, docs, empty):
    items = [(i, words(20 + i, 10**6)) for i in range(30)] + [(90, None), (91, "")]
    rows = []
    for i, t in items[:30]:
        w = t.split()
        for _ in range(DC.edits(len(w)) * (i % 3) // 2):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, words(30, 10**6) + " " + " ".join(w).upper() + ", " + words(30, 10**6)))
    rows += [(100 + i, words(200, 10**6)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = DC.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(30)}
    assert DC.contaminated(empty, bench).count() == 0 and DC.contaminated(docs, bench.limit(0)).count() == 0


def test_edit_search_is_exact():
    near = lambda a, b: DC.nearest(np.array(a, np.uint64), np.array(b, np.uint64))
    assert near([1, 2, 3], [9, 1, 2, 3, 9]) == (0, 1, 4)
    assert near([1, 2, 3, 4], [9, 1, 3, 4, 9])[0] == 1

    def plain(item, text):
        prev = [(0, -j) for j in range(len(text) + 1)]
        for i, w in enumerate(item, 1):
            row = [(i, prev[0][1])]
            for j, v in enumerate(text, 1):
                row.append(min((prev[j - 1][0] + (w != v), prev[j - 1][1]), (prev[j][0] + 1, prev[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
            prev = row
        j = min(range(len(prev)), key=lambda j: (prev[j][0], j))
        return prev[j][0], -prev[j][1], j

    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        assert near(a, b) == plain(a, b)


def edited(w, n):
    """w with n substitutions, insertions and deletions."""
    w = list(w)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            w.insert(at, f"x{rng.randrange(10**6)}")
        else:
            del w[at]
    return w


@pytest.mark.parametrize("size", [3, 8, 20, 40, 80])
def test_recall_with_insertions_and_deletions(size):
    """Against brute force: every item that is within its budget of some stretch, at each count of edits."""
    items = [(i, words(size, 10**6)) for i in range(40)]
    ix = DC.Index(items)
    budget = DC.edits(size)
    for n in sorted({0, 1, budget // 2, budget}):
        if n > budget:
            continue
        texts = [words(30, 10**6) + " " + " ".join(edited(t.split(), n)) + " " + words(30, 10**6) for _, t in items] + [words(90, 10**6) for _ in range(40)]
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, raw)])
        got = {(d, ix.ids[i]) for d, i, *_ in ix.matches(np.frombuffer(b"".join(raw), np.uint8), offs)}
        hashes = [DC.bare_words(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[2] for x in raw]
        want = {(d, ix.ids[i]) for i in range(40) for d in (*range(40, 44), i) if DC.nearest(ix.words[i], hashes[d])[0] <= budget}
        assert got <= {(d, i) for d in range(80) for i in range(40) if d == i or (d, i) in want} and len(got & want) >= 0.99 * len(want), (size, n)


def test_sampling_selects(spark):
    """Windows without a common word are no candidates."""
    ix = DC.Index([(i, words(20, 10**6)) for i in range(50)])
    x = np.array([[rng.randrange(1, 1 << 60) for _ in range(20)] for _ in range(500)], np.uint64)
    assert ix._meets(x, np.arange(500) % 50).sum() == 0


def test_items_of_any_type_and_length(spark):
    long = words(3000, 10**6)
    bench = spark.createDataFrame([("a", words(20, 10**6)), ("long", long), (None, "zz yy xx")], "item_id string, text string")
    rows = [(1, words(50, 10**6) + " " + long), (2, "pre zz yy xx post"), (3, None)]
    got = {(r.doc_id, r.item_id) for r in DC.contaminated(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    assert got == {(1, "long"), (2, None)}


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as cp

    docs = load(spark, SF, "documents")
    cols = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = cp.materialised(stage(spark, docs, SF))
        assert docs.columns == cols and 0 < docs.count() <= before, name
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()

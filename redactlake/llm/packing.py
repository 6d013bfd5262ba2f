"""Best-fit packing of tokenised documents into sequences.

Tokens: a public tokenizer's ids and one closing id. Pieces are dealt by hash into
groups large enough that unfilled ends do not matter, and come in an order that has
nothing to do with their length. They are packed by a bounded-space online best fit: a
fixed number of open sequences, in a bitset keyed by free space. A piece goes to the
fullest open sequence it fits in; when too many are open, the fullest closes first.

Nulls, ties, empties: a null text is empty and has the closing id alone; a text
longer than a sequence is cut into full pieces and a rest; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, materialised, texts

CAPACITY = 4096
CLOSING = 1
#: Open sequences at most. On 63 M tokens 32 make 0.50 % more sequences than the tokens fill, 128 and more 0.47 %.
OPEN = 256
#: Tokens and pieces of a group at most, about: one task sorts and packs a group.
GROUP_TOKENS, GROUP_PIECES = 24_000_000, 400_000


class Encoder:
    """Ids of the named tokenizer as little-endian bytes.

    The tokenizer encodes the matches of its split pattern one by one, and none spans
    white space: the ids of a text are those of its parts in a row, kept in a memo of
    bounded size. Texts of ASCII and Latin letters are split here by that pattern;
    others are split at white space and the tokenizer does the rest.
    """

    MEMO = 500_000
    OTHER = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
    PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9\\s]+")
    WORD = re.compile("[^\t-\r ]+")
    #: Byte-level vocabularies write a byte that cannot be shown as a character from 256 on.
    PRINTABLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b))}

    def __init__(self, name: str = "word_bpe_49k.json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}

    def _learn(self, parts: list[str], split: bool) -> None:
        memo = self.memo
        new = {w for w in parts if w not in memo}
        if len(memo) + len(new) > self.MEMO:
            memo.clear()
            new = set(parts)
        for w in new:
            if split:  # normalised and split: the model alone is left, which knows bytes by printable characters
                found = [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.PRINTABLE))]
            else:
                found = self.tokenizer.encode(w, add_special_tokens=False).ids
            memo[w] = struct.pack(f"<{len(found)}I", *found)

    def ids(self, text: str) -> bytes:
        split = not self.OTHER.search(text) and "<|" not in text  # "<|": the tokenizer's special tokens
        parts = self.PART.findall(text.lower()) if split else self.WORD.findall(text)
        try:
            return b"".join([self.memo[w] for w in parts])
        except KeyError:
            self._learn(parts, split)
            return b"".join([self.memo[w] for w in parts])


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of every piece."""
    rows = docs.select("doc_id", F.col(text).alias("__text"))

    def run(batches):
        encoder = Encoder(tokenizer)
        closing = struct.pack("<I", CLOSING)
        step = 4 * capacity
        for b in batches:
            src, piece, start, length, crc = [], [], [], [], []
            own = texts(b.column(1))
            for i in range(b.num_rows):
                ids = encoder.ids(own[i].as_py()) + closing
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    src.append(i)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths, capacity: int = CAPACITY, most_open: int = OPEN):
    """(sequence, offset) of each length, in order: bounded-space online best fit."""
    free: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    bits, n_open, made, out = 0, 0, 0, []
    for length in lengths:
        fits = bits >> length
        if fits:
            space = ((fits & -fits).bit_length() - 1) + length
            at = free[space].popleft()
            if not free[space]:
                bits &= ~(1 << space)
        else:
            space, at = capacity, made
            made += 1
            n_open += 1
        out.append((at, capacity - space))
        left = space - length
        if left:
            free[left].append(at)
            bits |= 1 << left
            if n_open > most_open:  # the fullest closes
                tight = (bits & -bits).bit_length() - 1
                free[tight].popleft()
                if not free[tight]:
                    bits &= ~(1 << tight)
                n_open -= 1
        else:
            n_open -= 1
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN) -> DataFrame:
    """found and, for each piece, sequence_id and offset. found must be stored: it is counted first."""
    t, n = found.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-t // GROUP_TOKENS), -(-n // GROUP_PIECES))
    cols = found.columns
    dealt = (
        found.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
        .repartitionById(groups, F.col("__group"))
        .sortWithinPartitions("__group", F.xxhash64("ids_crc32", "doc_id", "piece"), "doc_id", "piece")
    )

    def run(batches):
        rows = []
        for b in batches:
            rows.append(b)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        own = table.column("__group").to_numpy()
        bounds = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for a, z in zip(bounds, [*bounds[1:], len(own)], strict=True):
            placed = best_fit(table.column("length")[a:z].to_pylist(), capacity, most_open)
            out = table.slice(a, z - a).select(cols).append_column("sequence_id", pa.array([(int(own[a]) << 40) + s for s, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    schema = found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialised(pieces(load(spark, sf_dir, "documents"))))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return pack(materialised(pieces(docs)))

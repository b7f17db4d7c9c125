"""Sum-of-squares packing of documents into sequences.

Documents become token ids plus an end id; only those longer than a sequence are cut.  Whole
sequences need no packing.  The other pieces are dealt into shards of about :data:`SHARD_PIECES`
pieces; inside a shard each piece goes where the sum over residual gaps g of N(g)^2 becomes
smallest, N(g) being the number of open sequences with gap g.  Moving a sequence from gap g to
g - s changes that sum by 2 (N(g - s) - N(g)) + 2, closing one by 1 - 2 N(g), opening one by
2 N(capacity - s) + 1, so one vector operation over the gaps finds the place.  Ties go to the smallest gap.

Scale: tokenising is a narrow pass; the shards are independent and of bounded size, and the waste of
sum-of-squares does not grow in proportion to a shard, so more input means more shards, not longer ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .common import Scratch, text_of

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 250_000
CACHE = 1 << 19
#: Printable stand-ins of the 256 bytes in byte-level vocabularies, by byte.
BYTES = {b: c for c, b in byte_alphabet().items()}
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's split pattern (fixed value), for the characters that SIMPLE admits.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class PartIds(dict):
    """lower-case pre-token in Latin letters, digits or ASCII signs -> ids as bytes, straight from the merges."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.shown = {c: "".join(BYTES[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.translate(self.shown))]
        self[part] = x = np.array(ids, "<u4").tobytes()
        return x


class WordIds(dict):
    """piece of text without white space -> ids as bytes.

    Pieces of ASCII signs and Latin-1 letters, where normalising is lower-casing alone, are cut by
    the vocabulary's pattern and each part is merged once; all others, and special tokens, go
    through the tokenizers library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.parts = PartIds(self.tok.model)

    def __missing__(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word) and "<|" not in word:
            x = b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        else:
            x = np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = x
        return x

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; white space parts words for this vocabulary, so words are looked up one by one."""
        if len(self) > CACHE:
            self.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """The cache of this Python worker, kept from task to task."""
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (binary, if asked for), salt of every piece of every row.

    A null or empty text gives one piece that holds the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    fields = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {})
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer)
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column(1)):
                ids = own.encode(text.as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((n, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(fields)])
                    of.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            arrays = [pa.array(c, kinds[k]) for c, k in zip(columns, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *arrays], ["doc_id", *fields])

    # not a UDF under inline(): Spark would infer a filter from it and encode every text twice
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text_"))
    rows = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in fields.items()))
    return rows.withColumn("salt", F.monotonically_increasing_id())


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order.

    Once there are as many bins as the items fill at least, another is opened only for an item that fits no open one.
    """
    enough = -(-int(lengths.sum()) // capacity)
    open_at = np.zeros(capacity + 1, np.int64)  # N(g) for gaps 1 .. capacity - 1
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        counts = open_at[s:capacity]  # gaps s .. capacity - 1
        best, gap = (2 * open_at[capacity - s] + 1 if s < capacity else 0), capacity
        if len(counts):
            # N(g - s) for gap s is 0 with no cost of its own: the sequence closes
            change = 2 * (open_at[: capacity - s] - counts) + 2
            change[0] = 1 - 2 * counts[0]
            change[counts == 0] = never
            g = int(change.argmin())
            if counts[g] and (change[g] <= best or n >= enough):
                gap = g + s
        if gap == capacity:
            b, n = n, n + 1
        else:
            b = stacks[gap].pop()
            open_at[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        left = gap - s
        if left:
            stacks[left].append(b)
            open_at[left] += 1
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of salt; n_pieces: their number.

    Long pieces go first, which leaves fewer gaps.  Pieces of one length are alike, so the number of
    sequences does not depend on how ties are broken; repeated rows are pieces of their own.
    """
    shards = -(-max(1, n_pieces) // shard_pieces)
    columns = [c for c in pieces.columns if c != "salt"]
    kept = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("order", "ascending")])  # long pieces first
        bins, offsets = sum_of_squares(t["length"].to_numpy(), capacity)
        shard = t["shard"][0].as_py()
        return t.select(columns).append_column("sequence_id", pa.array(bins + (shard << 40))).append_column("offset", pa.array(offsets))

    return (
        pieces.withColumn("order", F.xxhash64("doc_id", "piece", "salt", "ids_crc32"))
        .withColumn("shard", F.pmod("order", F.lit(shards)))
        .drop("salt")
        .groupBy("shard")
        .applyInArrow(place, f"{kept}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: all rows of ``docs``, packed.

    Null ids pass through; extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut_pieces(docs, tokenizer, capacity, with_ids=with_ids))
    return pack(pieces, pieces.count(), capacity)

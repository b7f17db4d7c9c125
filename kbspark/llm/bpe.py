"""BPE encoding by backtracking, decoding by an offset table.

Encoder: at each byte the longest token that matches is found by an Aho-Corasick automaton; a token
is accepted if it is compatible with the token before it, that is if the merges, run over the two
tokens' bytes, would leave exactly these two.  An incompatible token is replaced by its next shorter
match; where none is left, the step before is taken back.  A position that failed once is never
tried again, so the time is linear in the text, and the only sequence whose neighbours are all
compatible is the one that the merges give.

Decoder: all token bytes lie in one table; a token's offset and length select its bytes.

The texts are cut by the vocabulary's own pre-tokenisation, which merges never cross.  Results of
recurring words are kept in a cache of bounded size per task.  Every row is independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

CACHE = 1 << 19
#: The public split pattern of byte-level BPE vocabularies (fixed value).
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces that are one pre-token, or a word and signs, whatever follows; a shortcut for SPLIT.
WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)")
#: Any character that may count as white space somewhere, but for the plain space.
SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabulary files, as character -> byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file (the json form of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        token = lambda s: bytes(of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {token(s): i for s, i in vocab.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            table[i] = b
        for s, i in self.special.items():
            table[i] = s.encode()
        self.bytes_of = table
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(table), np.uint8)
        # merge of two ids -> (rank, id); and for each id the pair of its last merge
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = (token(x) for x in (m if isinstance(m, list) else m.split(" ")))
            ids = self.id_of[left], self.id_of[right]
            whole = self.id_of[left + right]
            self.pair.setdefault(ids, (rank, whole))
            self.halves.setdefault(whole, ids)
        self.rank = {i: self.pair[h][0] for i, h in self.halves.items()}
        # a token that its own merges never give takes no part; ids of parts are settled before wholes
        self.reachable = {i for i in self.id_of.values() if i not in self.halves}
        for i in sorted(self.halves, key=self.rank.__getitem__):
            a, b = self.halves[i]
            if a in self.reachable and b in self.reachable and self._compatible(a, b, self.rank[i]):
                self.reachable.add(i)
        # latin-1 strings stand for bytes in the automaton
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            if i in self.reachable:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.compatible = lru_cache(1 << 19)(self._compatible)

    def _compatible(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether the merges that come before ``limit`` leave token ``a`` before token ``b`` as they are.

        Undoes the later of the two last merges again and again; a merge across the border that
        comes before the merge which was undone would have happened first.
        """
        while True:
            across = self.pair.get((a, b))
            if across is not None and across[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of merges of equal rank the left one comes first
            if ra > rb:
                limit, a = min(limit, ra), self.halves[a][1]
            else:
                limit, b = min(limit, rb + 1), self.halves[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.id_of.get(word)
        if whole is not None and whole in self.reachable:
            return [whole]
        n, text = len(word), word.decode("latin-1")
        longest = [i for _, (_, i) in self.automaton.iter_long(text)]
        if all(map(self.compatible, longest, longest[1:])):  # no step has to be taken back
            return longest
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.automaton.iter(text):
            ends[end - length + 1].append((length, i))  # by end, so shorter ones first
        failed = bytearray(n + 1)
        ids: list[int] = []
        at, tries = [0], [list(ends[0])]
        while at[-1] < n:
            start, options = at[-1], tries[-1]
            while options:
                length, i = options.pop()
                if not failed[start + length] and (not ids or self.compatible(ids[-1], i)):
                    ids.append(i)
                    at.append(start + length)
                    tries.append(list(ends[start + length]) if start + length < n else [])
                    break
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of the text")
                failed[start] = 1
                at.pop(), tries.pop(), ids.pop()
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        index = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + lengths, lengths)
        return self.table[index].tobytes()


def words_of(text: str) -> list[str]:
    """``text`` cut at borders of pre-tokens; pieces recur often.

    A space before a character that is no white space always begins a pre-token, so plain texts
    are cut there; others are cut by the split pattern.
    """
    parts = text.split(" ")
    if "" in parts or not SPACES.isdisjoint(p[0] for p in parts):
        return SPLIT.findall(text)
    return [parts[0], *(" " + p for p in parts[1:])]


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.v = v = Vocabulary(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = x = np.array(v.encode_word(word.encode()), "<u4").tobytes() if word else b""
                return x

        self.words = words = Words()

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                m = WORD.fullmatch(piece)
                parts = m.groups() if m else SPLIT.findall(piece)
                self[piece] = x = b"".join(map(words.__getitem__, parts))
                return x

        self.cache = Pieces()

    def encode(self, text: str) -> bytes:
        for cache in (self.cache, self.words):
            if len(cache) > CACHE:
                cache.clear()
        get = self.cache.__getitem__
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(get, words_of(text))) if text else b""
        out = []
        for n, part in enumerate(self.cut.split(text)):
            if n % 2:
                out.append(np.array([self.v.special[part]], "<u4").tobytes())
            elif part:
                out += map(get, words_of(part))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per row of ``docs``; ids is binary, little-endian unsigned 32-bit.

    A null text counts as empty and has no ids; strings of special tokens inside a text become
    their ids.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pa.array([own.encode(t.as_py()) for t in batch], pa.binary())

    ids = F.arrow_udf(run, "binary")(text_of(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids"))


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); bytes that are no UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = encoder(vocabulary).v
        for batch in batches:
            yield pa.array([v.decode(np.frombuffer(b.as_py() or b"", "<u4")).decode("utf-8", "replace") for b in batch], pa.string())

    return encoded.select("doc_id", F.arrow_udf(run, "string")("ids").alias("text"))


def round_trip_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded, and decoded from its ids, in one pass.

    Null texts count as empty; null and repeated ids pass through (only texts go to Python); other columns are ignored; an empty table
    gives an empty result.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(vocabulary)
        decimal = np.array([str(i) + "," for i in range(len(own.v.bytes_of))], dtype=object)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch:
                ids = np.frombuffer(own.encode(t.as_py()), "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256("".join(decimal[ids].tolist())[:-1].encode()).hexdigest())
                text = own.v.decode(ids).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [f.name for f in kind])

    r = F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text_of("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), r.alias("r")).select("doc_id", "r.*")

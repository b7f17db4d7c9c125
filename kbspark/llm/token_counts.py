"""Token counts of a sentencepiece BPE vocabulary, with a shortcut for words that are one token.

Two facts are proved from the vocabulary alone, before any text is read:

* *Borders.*  A merge across the border of two characters gives a piece that holds both side by side.  Characters that can
  join directly or by way of others form an alphabet (Latin letters, signs, Cyrillic letters ...); nothing ever merges
  across the border of two alphabets, nor before a space sign, if no piece has one behind another character.
* *Whole tokens.*  Merges are run over every vocabulary string by itself; those that end as one token are whole.

A text is cut at proven borders into pre-tokens: runs of one alphabet, with the spaces before them.  A pre-token that is a
whole token counts one at once; only the rest is merged.  Merging takes the pair whose joint piece scores best, leftmost
first; a character outside the vocabulary counts one token for each of its UTF-8 bytes.

Every row is independent: no shuffle, and only texts go to Python.  Counts of short pre-tokens are kept per Python worker, in tables
of bounded size; a long pre-token (a text without spaces) is merged with a heap in n log n steps and not kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import text_of

SPACE = "▁"  # the library's sign for a space
#: Kinds of vocabulary entries in the public model format (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHE, KEPT, SHORT = 1 << 19, 64, 64
NONE = float("inf")


class Pieces:
    """The vocabulary of a model file and what is proved of it."""

    def __init__(self, path: str):
        spec = model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        how = spec.normalizer_spec
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for spaces, are counted")
        if spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix or {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces are counted")
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.bytes = sum(p.type == BYTE for p in spec.pieces) == 256
        self.prefix = SPACE if how.add_dummy_prefix else ""
        pairs = {p[i : i + 2] for p in self.cost for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            raise ValueError("no border before a space can be proved")
        self.pre_token = re.compile("|".join(f"{SPACE}*[{re.escape(''.join(a))}]+" for a in alphabets(pairs)) + f"|{SPACE}*[^{SPACE}]|{SPACE}+")
        self.whole = {p for p in self.cost if self.merged(p) == 1}
        self.counts = _Kept(self._pre_token)

    def merged(self, part: str) -> int:
        """Tokens of ``part`` after all merges."""
        left = self._merge_short(part) if len(part) <= SHORT else self._merge_long(part)
        return sum(1 if s in self.cost else self._spelled(s) for s in left)

    def _spelled(self, character: str) -> int:
        return len(character.encode()) if self.bytes else 1

    def _merge_short(self, part: str) -> list[str]:
        s, cost = list(part), self.cost.get
        at = [cost(a + b, NONE) for a, b in zip(s, s[1:])]
        while at and (best := min(at)) < NONE:
            i = at.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del at[i]
            if i:
                at[i - 1] = cost(s[i - 1] + s[i], NONE)
            if i < len(at):
                at[i] = cost(s[i] + s[i + 1], NONE)
        return s

    def _merge_long(self, part: str) -> list[str]:
        n, cost = len(part), self.cost.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            c = cost(part[i : end[j]])
            if c is not None:
                heapq.heappush(heap, (c, i, end[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j < 0 or end[j] != stop:  # one of the two has been merged since
                continue
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [part[i : end[i]] for i in range(n) if end[i] > 0]

    def _pre_token(self, word: str) -> int:
        return 1 if word in self.whole else self.merged(word)

    def count(self, text: str) -> int:
        """Tokens of one text, as the library's ``encode`` gives them."""
        if not text:
            return 0
        self.counts.trim()
        return sum(map(self.counts.__getitem__, self.pre_token.findall(self.prefix + text.replace(" ", SPACE))))


def alphabets(pairs: set[str]) -> list[list[str]]:
    """The characters of ``pairs`` in sets such that no pair has its halves in two of them; space signs aside."""
    of: dict[str, list[str]] = {}
    for a, b in pairs:
        if SPACE not in (a, b):
            x, y = of.setdefault(a, [a]), of.setdefault(b, [b])
            if x is not y:
                x, y = sorted((x, y), key=len)
                y += x
                of.update(dict.fromkeys(x, y))
    return sorted({id(x): x for x in of.values()}.values(), key=len, reverse=True)


class _Kept(dict):
    """Counts of strings, filled on demand; long strings are counted anew each time."""

    def __init__(self, count):
        self.of = count

    def __missing__(self, s: str) -> int:
        n = self.of(s)
        if len(s) <= KEPT:
            self[s] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The vocabulary of this Python worker, kept from task to task."""
    return Pieces(path)


def token_count(text: Column, model: str) -> Column:
    """The number of tokens of a text column (null: 0), without begin, end or other added tokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pieces(model)
        for batch in batches:
            yield pa.array([own.count(t.as_py() or "") for t in batch], pa.int64())

    return F.arrow_udf(run, "long")(text)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens): one row per row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens.  Strings of special tokens inside a text are ordinary text.  Null and repeated
    ids pass through; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, model).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

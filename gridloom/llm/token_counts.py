"""Token counts by byte-pair merging with a heap over a linked list, without emitting ids.

Each piece of the pre-tokenizer starts as single bytes. The adjacent pair of lowest rank is popped
from a heap and merged in a doubly linked list until no ranked pair is left; the count is the
number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import importable

# The published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
_SLOW = -(1 << 60)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of a text. Chunks and pieces already counted are kept up to ``CACHE`` entries each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.first = [vocabulary[letter] for letter in byte_letters()]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = (rank, vocabulary[left + right])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.of_piece: dict[str, int] = {}
        self.of_chunk: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        symbols = [self.first[b] for b in piece.encode("utf-8")]
        left = n = len(symbols)
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = merged, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = ranks.get(merged << 32 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
            p = before[i]
            if p >= 0:
                found = ranks.get(symbols[p] << 32 | merged)
                if found:
                    heapq.heappush(heap, (found[0], p, symbols[p], merged, found[1]))
        return left

    def run(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.of_piece
        for piece in self.pieces.findall(text):
            count = known.get(piece)
            if count is None:
                if len(known) >= CACHE:
                    known.clear()
                count = known[piece] = self.piece(piece)
            total += count
        return total

    def whole(self, text: str) -> int:
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            return sum(map(self.run, parts)) + len(parts) - 1
        return self.run(text)

    def batch(self, texts: list[str]) -> list[int]:
        """A space between two non-space characters always begins a piece, so texts are cut there.

        A chunk that is empty or has white space at an end marks its text as one to be cut by the
        pattern as a whole.
        """
        chunks = [text.split(" ") for text in texts]
        new = set().union(*chunks).difference(self.of_chunk)
        if len(self.of_chunk) + len(new) > CACHE:
            self.of_chunk = {}
            new = set().union(*chunks)
        for c in new:
            self.of_chunk[c] = self.whole(" " + c) if c and not c[0].isspace() and not c[-1].isspace() else _SLOW
        get, out = self.of_chunk.__getitem__, []
        for text, own in zip(texts, chunks):
            first = own[0]
            if len(own) > 1 and (not first or first[-1].isspace()):
                out.append(self.whole(text))
                continue
            total = sum(map(get, own[1:])) if len(own) > 1 else 0
            out.append(self.whole(text) if total < 0 else total + self.whole(first))
        return out


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter per worker process, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of ``text`` under the byte-level BPE file at ``vocabulary``; NULL counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            values, counts = texts.tolist(), []
            for i in range(0, len(values), 256):
                counts += own.batch(values[i : i + 256])
            yield pd.Series(counts, dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, UTF-8 bytes, tokens, whether tokens exceed ``limit``.

    NULL and empty texts have no bytes and no tokens; repeated rows are counted each. Special
    strings inside a text are one token each, as the tokenizer's default has it. There is no
    shuffle: a text is counted where it is read.
    """
    importable(docs.sparkSession)
    return docs.select(
        id,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text), vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

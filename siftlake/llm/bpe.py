"""Token ids of a corpus by a public byte-level vocabulary, merged with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and pre-tokens whose ids a worker keeps.
FOLDER, KEPT = "/opt/tokenizers", 400_000
# Fixed value: the published pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BITS = 6
_LOW = (1 << _BITS) - 1


class RankQueue:
    """Buckets of positions by merge rank under three levels of 64-bit bitmaps; find-first-set gives the least rank.

    Entries are never taken out when they go stale; the reader skips them.
    """

    def __init__(self) -> None:
        self.top = 0
        self.mid: dict[int, int] = {}
        self.leaf: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        b = self.bucket.get(rank)
        if b is None:
            self.bucket[rank] = [position]
            word, group = rank >> _BITS, rank >> 2 * _BITS
            self.leaf[word] = self.leaf.get(word, 0) | 1 << (rank & _LOW)
            self.mid[group] = self.mid.get(group, 0) | 1 << (word & _LOW)
            self.top |= 1 << group
        else:
            heappush(b, position)

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its least position, taken out; None if there is none."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        m = self.mid[group]
        word = group << _BITS | (m & -m).bit_length() - 1
        x = self.leaf[word]
        rank = word << _BITS | (x & -x).bit_length() - 1
        b = self.bucket[rank]
        position = heappop(b)
        if not b:
            del self.bucket[rank]
            self.leaf[word] = x = x & (x - 1)
            if not x:
                self.mid[group] = m = m & (m - 1)
                if not m:
                    self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the least-ranked neighbouring pair, the leftmost of equals, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    queue = RankQueue()
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            queue.push(r, i)
    while (got := queue.pop()) is not None:
        rank, i = got
        j = after[i]
        if not alive[i] or j >= n or ranks.get(piece[i : end[j]]) != rank:
            continue
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                queue.push(r, i)
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k : end[i]])) is not None:
            queue.push(r, k)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Ids of pre-tokens by their text; those met for the first time are merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        ids = merge(piece.encode(), self.ranks)
        if len(piece) < 64:
            if len(self) >= KEPT:  # forgets, so that memory stays bounded
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or an empty one. What looks like a special token is ordinary text."""
        out: list[int] = []
        for piece in self.split(text) if text else ():
            out += self[piece]
        return out


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


_ENCODERS: dict[int, Encoder] = {}


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, *keep: str) -> DataFrame:
    """doc_id, ids (array of integers) and the columns to keep of every document by a vocabulary of the folder, without special tokens.

    A null text has no ids, as has an empty one: both give an empty array. The vocabulary, under a megabyte whatever the
    corpus, is read by the driver and broadcast; one pass without a shuffle encodes whole texts.
    """
    data = (Path(folder) / f"{vocabulary}.tiktoken").read_bytes()
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(sent.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(parse_ranks(sent.value))
        encoder = _ENCODERS[key]
        for pdf in batches:
            yield pdf.assign(ids=[encoder.encode(t) for t in pdf.pop("text")])

    rows = documents.select("doc_id", *keep, "text")
    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInPandas(run, f"doc_id bigint{fields}, ids array<int>").select("doc_id", *keep, "ids")


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """lang, documents and tokens: the size of the corpus in tokens by its language labels."""
    return encode(documents, vocabulary, folder, "lang").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))
